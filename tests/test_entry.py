import os

import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@needs_data
def test_searches_match_sql(spark):
    import duckdb

    from halyard.plans import queries as q

    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{SMALL}/embeddings.parquet'")
    for name in ("knn_l2", "knn_ip", "knn_cosine", "knn_l2_normalized", "knn_ip_normalized", "knn_expression", "knn_counts", "knn_after_upsert", "validate_batch_report", "recall_tie_tolerant", "vector_distance_cosine"):
        got = q.QUERIES[name](spark, SMALL).toPandas()
        expected = db.execute(q.ORACLE_SQL[name]).df()[list(got.columns)]
        key = list(got.columns)[:2]
        a, b = (df.sort_values(key).reset_index(drop=True).astype(object) for df in (got, expected))
        assert a.values.tolist() == b.values.tolist(), name
