"""Checks of vectors, ids and queries, as reports that Spark computes before anything changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.config import LARGEST, MAX_ROWS, NO_ID, CollectionConfig
from halyard.errors import CapacityExceeded, DuplicateId, InvalidInput
from halyard.functions import vectors


def _judged(rows: DataFrame, vector: str, config: CollectionConfig) -> DataFrame:
    """``rows`` with ``code`` (null if sound), ``position`` and ``problem`` of its vector."""
    x = F.get(F.col(vector), F.col("position"))
    size = F.size(vector) != config.dim
    code = F.when(F.col(vector).isNull() | size, 1).when(F.col("position").isNotNull(), 2)
    if config.normalize:
        code = code.when(vectors.inverse_norm(F.col(vector)).isNull(), 3)
    what = F.when(F.col("code") == 1, F.lit(f"vector does not have {config.dim} components")).when(F.col("code") == 3, F.lit("vector cannot be normalized"))
    what = what.when(x.isNull(), "component is null").when(F.isnan(x), "component is NaN").when(F.abs(x) == float("inf"), "component is infinite")
    df = rows.withColumn("position", vectors.invalid_component(F.col(vector))).withColumn("code", code)
    return df.withColumn("problem", what.otherwise(F.lit(f"component is larger than {LARGEST:g}")))


def vector_report(rows: DataFrame, key: str, vector: str, config: CollectionConfig) -> DataFrame:
    """(key, code, position, problem) of each vector that breaks a rule: length, then components, then norm."""
    return _judged(rows, vector, config).where("code is not null").select(key, "code", "position", "problem")


def duplicate_ids(rows: DataFrame) -> DataFrame:
    """(id, n) of ids that stand in ``rows`` more than once."""
    return rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def existing_ids(rows: DataFrame, live: DataFrame) -> DataFrame:
    """Rows whose id is live already."""
    return rows.join(live.select("id").distinct(), "id", "left_semi")


def check_queries(queries: DataFrame, config: CollectionConfig) -> None:
    worst = vector_report(queries, "qid", "query", config).orderBy("qid").first()
    if worst:
        raise InvalidInput(f"query {worst['qid']}: {worst['problem']}")


def check_batch(rows: DataFrame, live: DataFrame | None, config: CollectionConfig, upsert: bool, held: int = 0) -> tuple[int, int]:
    """(number of rows, largest id) of a batch (position_in_batch, id, vector), or raises for the first broken rule.

    In the order of the rules: lengths and components, ids that stand twice in the batch, null, reserved and negative
    ids, norms, ids that are live already, then the capacity of a collection that ``held`` rows. One aggregate
    sees all but the ids that are live; ``live`` is None where nothing is.
    """
    bad = F.when(F.col("code").isNotNull(), F.struct((F.col("code") == 3).alias("norm"), "position_in_batch", "problem"))
    s = _judged(rows, "vector", config).agg(F.count("*").alias("n"), F.max("id").alias("most"), F.min("id").alias("lowest"), F.count_if(F.col("id").isNull()).alias("nulls"), F.count_distinct("id").alias("ids"), F.min(bad).alias("bad")).first()
    if s["bad"] and not s["bad"]["norm"]:
        raise InvalidInput(f"row {s['bad']['position_in_batch']}: {s['bad']['problem']}")
    if s["ids"] + s["nulls"] < s["n"]:
        twice = duplicate_ids(rows.where("id is not null")).orderBy("id").first()
        raise InvalidInput(f"id {twice['id']} stands {twice['n']} times in the batch")
    if s["nulls"]:
        raise InvalidInput("an id is null")
    if s["n"] and s["lowest"] < 0:
        raise InvalidInput(f"id {NO_ID} is reserved" if s["lowest"] == NO_ID else f"id {s['lowest']} is below 0")
    if s["bad"]:
        raise InvalidInput(f"row {s['bad']['position_in_batch']}: {s['bad']['problem']}")
    if s["n"] and not upsert and live is not None:
        known = existing_ids(rows, live).orderBy("position_in_batch").first()
        if known:
            raise DuplicateId(f"id {known['id']} exists already")
    if held + s["n"] > MAX_ROWS:
        raise CapacityExceeded(f"{s['n']} rows more than the {MAX_ROWS} that a collection can hold")
    return s["n"], s["most"]
