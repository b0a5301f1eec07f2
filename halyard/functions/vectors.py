"""Vector functions as Spark expressions, in strict float32: every step rounds, from left to right."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from halyard.config import LARGEST

def _float(x: float) -> Column:
    return F.lit(x).cast("float")


def _checked(a: Column, b: Column, value: Column) -> Column:
    """``zip_with`` pads the shorter array, so lengths are compared first."""
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("float"))


def _total(values: Column) -> Column:
    return F.aggregate(values, _float(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _checked(a, b, _total(F.zip_with(a, b, lambda x, y: x * y)))


def l2sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return _checked(a, b, _total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def norm2(a: Column) -> Column:
    return F.aggregate(a, _float(0.0), lambda s, x: s + x * x)


def inverse_norm(a: Column) -> Column:
    """1 / norm as float32, from a float32 sum of squares; null where the norm is zero or not finite."""
    scale = (F.lit(1.0) / F.sqrt(norm2(a).cast("double"))).cast("float")
    n = norm2(a)
    return F.when((n > 0) & (n < float("inf")) & (scale < float("inf")), scale)


def normalize(a: Column) -> Column:
    """``a`` at unit length; null where that is impossible."""
    scale = inverse_norm(a)
    return F.when(scale.isNotNull(), F.transform(a, lambda x: x * scale))


def distance(metric: str, a: Column, b: Column) -> Column:
    """Distance of raw vectors. Cosine is computed in double from the float32 sums, and not clamped."""
    if metric == "l2":
        return l2sq(a, b)
    if metric == "ip":
        return -dot(a, b) + _float(0.0)
    product = dot(a, b).cast("double") / (F.sqrt(norm2(a).cast("double")) * F.sqrt(norm2(b).cast("double")))
    return (F.lit(1.0) - product).cast("float")


def score(mode: str, query: Column, inverse: Column, stored: Column) -> Column:
    """Distance of a query to a stored vector; unit modes scale by the query's inverse norm instead of copying it."""
    if mode == "l2":
        return l2sq(query, stored)
    if mode == "ip":
        return -dot(query, stored) + _float(0.0)
    scaled = dot(query, stored) * inverse
    if mode == "cosine_unit":
        return F.greatest(_float(0.0), _float(1.0) - scaled)
    if mode == "l2_unit":
        return F.greatest(_float(0.0), _float(2.0) - _float(2.0) * scaled)
    return -scaled + _float(0.0)


def invalid_component(a: Column) -> Column:
    """Place (from 0) of the first component that is null, not finite or too large; null if there is none."""
    good = F.transform(a, lambda x: F.coalesce(F.abs(x) <= F.lit(LARGEST).cast("float"), F.lit(False)))
    at = F.array_position(good, False)
    return F.when(at > 0, (at - 1).cast("int"))


_DOT = "aggregate(zip_with(a, b, (x, y) -> x * y), CAST(0 AS FLOAT), (s, x) -> s + x)"
_NORM2 = "aggregate({0}, CAST(0 AS FLOAT), (s, x) -> s + x * x)"
SQL_FUNCTIONS = {
    "vector_ip_distance": f"(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS FLOAT RETURN -{_DOT} + CAST(0 AS FLOAT)",
    "vector_cosine_distance": f"(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS FLOAT RETURN CAST(1D - CAST({_DOT} AS DOUBLE) / (sqrt(CAST({_NORM2.format('a')} AS DOUBLE)) * sqrt(CAST({_NORM2.format('b')} AS DOUBLE))) AS FLOAT)",
    "vector_normalize": f"(a ARRAY<FLOAT>) RETURNS ARRAY<FLOAT> RETURN transform(a, x -> x * CAST(1D / sqrt(CAST({_NORM2.format('a')} AS DOUBLE)) AS FLOAT))",
    "vector_dot": "(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS FLOAT RETURN aggregate(zip_with(a, b, (x, y) -> x * y), CAST(0 AS FLOAT), (s, x) -> s + x)",
    "vector_l2sq": "(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS FLOAT RETURN aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), CAST(0 AS FLOAT), (s, x) -> s + x)",
    "vector_norm2": "(a ARRAY<FLOAT>) RETURNS FLOAT RETURN aggregate(a, CAST(0 AS FLOAT), (s, x) -> s + x * x)",
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to SQL as temporary functions."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
