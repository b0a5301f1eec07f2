"""Recall of search results against the truth, and percentiles of measured times."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.errors import InvalidInput
from halyard.operators.numbering import numbered


def recall_by_query(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(qid, recall) of ``found`` (qid, rank, id, distance) for each query of ``truth``, padding allowed.

    A found id counts if it is among the first k true ids, or as near as the k-th, within a millionth;
    repeated and padded ids do not. A query without true results has recall 1.
    """
    if k < 1:
        raise InvalidInput("k must be at least 1")
    true = truth.where((F.col("rank") <= k) & (F.col("id") >= 0))
    farthest = true.groupBy("qid").agg(F.count("*").alias("n"), F.max_by("distance", "rank").cast("double").alias("kth"))
    limit = F.col("kth") + 1e-6 * F.greatest(F.lit(1.0), F.abs("kth"))
    got = found.where((F.col("rank") <= k) & (F.col("id") >= 0)).groupBy("qid", "id").agg(F.min_by("distance", "rank").cast("double").alias("distance"))
    got = got.join(true.select("qid", "id", F.lit(True).alias("true")).distinct(), ["qid", "id"], "left").join(farthest, "qid")
    hits = got.where(F.col("true") | (F.col("distance") <= limit)).groupBy("qid").agg(F.count("*").alias("hits"))
    every = truth.select("qid").distinct().join(farthest, "qid", "left").join(hits, "qid", "left")
    recall = F.when(F.col("n").isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.coalesce("hits", F.lit(0)) / F.col("n")))
    return every.select("qid", recall.alias("recall"))


def recall_summary(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row (queries, mean_recall, min_recall); zeros without queries."""
    r = recall_by_query(found, truth, k)
    return r.agg(F.count("*").alias("queries"), F.coalesce(F.avg("recall"), F.lit(0.0)).alias("mean_recall"), F.coalesce(F.min("recall"), F.lit(0.0)).alias("min_recall"))


def id_overlap(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(qid, recall): shared distinct ids of the first k, divided by k, whatever the distances."""
    first = lambda df: df.where((F.col("rank") <= k) & (F.col("id") >= 0)).select("qid", "id").distinct()
    hits = first(found).join(first(truth), ["qid", "id"], "left_semi").groupBy("qid").agg(F.count("*").alias("hits"))
    every = truth.select("qid").distinct().join(hits, "qid", "left")
    return every.select("qid", (F.coalesce("hits", F.lit(0)) / k).alias("recall"))


def floor_percentile(percent: float) -> Callable[[int], int]:
    """The rank of the value at place floor(percent / 100 * (n - 1)) of n in order, from 0."""
    return lambda n: math.floor(percent / 100 * (n - 1)) + 1


def nearest_rank(percent: float) -> Callable[[int], int]:
    """The rank ceil(percent / 100 * n) of n values."""
    return lambda n: max(1, math.ceil(percent / 100 * n))


def at_ranks(df: DataFrame, column: str, ranks: dict[str, Callable[[int], int]]) -> DataFrame:
    """One row with the values of ``column`` at ``ranks``, which are functions of the number of values; null without any.

    Values are sorted by range and numbered, so no task holds them all.
    """
    values = df.select(F.col(column).alias("value")).where("value is not null")
    placed = numbered(values, ["value"], "rank", 1)
    n = placed.count()
    wanted = {name: rank(n) for name, rank in ranks.items()}
    found = {r["rank"]: r["value"] for r in placed.where(F.col("rank").isin(sorted(set(wanted.values())))).collect()}  # one row for each rank
    type_ = values.schema["value"].dataType.simpleString()
    return df.sparkSession.createDataFrame([tuple(found.get(wanted[name]) for name in ranks)], ", ".join(f"{name} {type_}" for name in ranks))


def first_beam_reaching(sweep: DataFrame, least_recall: float) -> DataFrame:
    """The row of (ef, recall, qps) with the smallest beam that reaches a recall; none if no beam does."""
    return sweep.where(F.col("recall") >= least_recall).orderBy("ef").limit(1)


def pareto_front(sweep: DataFrame) -> DataFrame:
    """Rows of (recall, qps) that no other row beats in both: those with the highest qps of all that have their recall or more."""
    best = sweep.groupBy("recall").agg(F.max("qps").alias("best"))
    above = Window.orderBy(F.desc("recall")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each recall of a sweep
    best = best.withColumn("above", F.max("best").over(above)).where("above is null or best > above")
    return sweep.join(best, "recall").where("qps = best").select(*sweep.columns)


def upper_median(values: list[float]) -> float:
    return sorted(values)[len(values) // 2] if values else math.nan
