import pytest

from halyard.errors import InvalidInput
from halyard.operators import evaluation

SCHEMA = "qid long, rank int, id long, distance float"


def results(spark, *queries):
    return spark.createDataFrame([(q, r + 1, i, float(d)) for q, x in enumerate(queries) for r, (i, d) in enumerate(x)], SCHEMA)


def recall(spark, found, truth, k):
    r = evaluation.recall_by_query(results(spark, found), results(spark, truth), k).collect()
    return r[0]["recall"]


def test_recall_counts_ids_and_ties(spark):
    truth = [(1, 1.0), (2, 2.0), (3, 3.0)]
    assert recall(spark, truth, truth, 3) == 1
    assert recall(spark, [(1, 1.0), (9, 4.0), (8, 5.0)], truth, 3) == pytest.approx(1 / 3)
    assert recall(spark, [(1, 1.0), (2, 2.0), (9, 3.0)], truth, 3) == 1  # as near as the last
    assert recall(spark, [(1, 1.0), (1, 1.0), (1, 1.0)], truth, 3) == pytest.approx(1 / 3)
    assert recall(spark, [(-1, float("inf"))], truth, 3) == 0
    assert recall(spark, [(5, 1.0)], [(-1, float("inf"))], 1) == 1
    with pytest.raises(InvalidInput):
        recall(spark, truth, truth, 0)


def test_summary_of_no_queries_is_zero(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert evaluation.recall_summary(empty, empty, 3).first().asDict() == {"queries": 0, "mean_recall": 0.0, "min_recall": 0.0}


def test_overlap_has_no_tie_tolerance(spark):
    truth, found = [(1, 1.0), (2, 2.0)], [(1, 1.0), (9, 2.0)]
    assert evaluation.id_overlap(results(spark, found), results(spark, truth), 2).first()["recall"] == 0.5


def test_percentiles_and_sweeps(spark):
    df = spark.createDataFrame([(float(i),) for i in (5, 1, 4, 2, 3)], "x double")
    ranks = {"a": evaluation.floor_percentile(50), "b": evaluation.floor_percentile(99), "c": evaluation.nearest_rank(50), "d": evaluation.nearest_rank(0)}
    assert tuple(evaluation.at_ranks(df.union(spark.createDataFrame([(None,)], "x double")), "x", ranks).first()) == (3, 4, 3, 1)
    assert tuple(evaluation.at_ranks(df.limit(0), "x", ranks).first()) == (None,) * 4
    sweep = spark.createDataFrame([(16, 0.8, 9.0), (32, 0.95, 7.0), (64, 0.95, 5.0), (128, 0.99, 2.0)], "ef int, recall double, qps double")
    assert evaluation.first_beam_reaching(sweep, 0.9).first()["ef"] == 32
    assert {r["ef"] for r in evaluation.pareto_front(sweep).collect()} == {16, 32, 128}
    assert evaluation.upper_median([1, 2, 3, 4]) == 3
