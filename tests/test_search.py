import numpy as np
import pytest

from halyard.config import CollectionConfig, SearchParams
from halyard.operators.search import exact_search, search_lateral


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_the_lateral_search_never_sorts_by_vectors(spark, metric):
    config, rng = CollectionConfig(4, metric), np.random.default_rng(1)
    v = rng.normal(size=(60, 4)).astype(np.float32)
    unit = v / np.linalg.norm(v, axis=1)[:, None] if metric == "cosine" else v
    rows = spark.createDataFrame([(i, 100 + i, x.tolist(), i % 7 == 0) for i, x in enumerate(unit)], "row_id long, id long, vector array<float>, deleted boolean")
    # an id that stands twice with one vector, and once more with another; a vector with two ids
    queries = spark.createDataFrame([(1, v[1].tolist()), (1, v[1].tolist()), (1, v[2].tolist()), (2, v[2].tolist()), (3, v[30].tolist())], "qid long, query array<float>")
    found = search_lateral(rows, queries, config, 5)
    assert sorted(found.collect()) == sorted(exact_search(rows, queries, config, SearchParams(5)).collect())
    windows = [x.split("],")[1] for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in x]
    assert len(windows) == 2 and not any("query" in x for x in windows)
