import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from halyard.catalog import VectorCatalog
from halyard.config import CollectionConfig, GraphParams, SearchParams
from halyard.errors import AlreadyExists, Corrupt, DuplicateId, InvalidInput, NotFound
from halyard.operators.collection import VectorCollection
from halyard.streaming.ingest import Ingest


def frame(spark, rows):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in rows], "id long, vector array<float>")


def asked(spark, queries):
    return spark.createDataFrame([(i, [float(x) for x in q]) for i, q in enumerate(queries)], "qid long, query array<float>")


@pytest.fixture
def line(spark):
    c = VectorCollection(spark, CollectionConfig(1))
    c.add_batch(frame(spark, [(100 + i, [i]) for i in range(10)]))
    return c


def test_ties_go_to_the_older_row(line):
    assert line.search_one([5], 3) == [(105, 0.0), (104, 1.0), (106, 1.0)]


def test_an_upserted_row_is_newest(spark, line):
    line.add_batch(frame(spark, [(104, [4])]), upsert=True)
    assert line.search_one([5], 3) == [(105, 0.0), (106, 1.0), (104, 1.0)]
    assert line.stats().first().asDict() == {"live": 10, "deleted": 1, "rows": 11}


def test_fewer_rows_than_asked(spark, line):
    q = asked(spark, [[0], [9]])
    assert line.search(q, 20).count() == 20
    every, n = line.search_padded(q, 12)
    assert every.where("id = -1 and distance = double('inf')").count() == 4
    assert {r["n"] for r in n.collect()} == {10}


def test_empty_collection(spark):
    c = VectorCollection(spark, CollectionConfig(2))
    assert c.search_one([1, 2], 5) == [] and c.size() == 0
    assert c.add_batch(frame(spark, [])) == 0
    assert VectorCollection(spark, CollectionConfig(2, index="hnsw")).search_one([1, 2], 5) == []


@pytest.mark.parametrize(
    "rows, error, text",
    [
        ([(1, [1, 2])], InvalidInput, "components"),
        ([(1, [float("nan")])], InvalidInput, "NaN"),
        ([(1, [float("inf")])], InvalidInput, "infinite"),
        ([(1, [1e17])], InvalidInput, "larger"),
        ([(1, [1]), (1, [2])], InvalidInput, "2 times"),
        ([(-1, [1])], InvalidInput, "reserved"),
        ([(-5, [1])], InvalidInput, "below 0"),
        ([(7, [1]), (100, [2])], DuplicateId, "100 exists"),
    ],
)
def test_a_bad_batch_changes_nothing(spark, line, rows, error, text):
    with pytest.raises(error, match=text):
        line.add_batch(frame(spark, rows))
    assert line.size() == 10 and line.next_row == 10


def test_cosine_stores_unit_rows_and_rejects_zero(spark):
    c = VectorCollection(spark, CollectionConfig(2, "cosine"))
    c.add(1, [3, 4])
    assert c.get(1) == pytest.approx([0.6, 0.8])
    with pytest.raises(InvalidInput, match="normalized"):
        c.add(2, [0, 0])
    with pytest.raises(InvalidInput, match="query 0"):
        c.search_one([0, 0])


def test_remove_get_contains_compact(spark, line):
    line.remove([100, 103])
    with pytest.raises(NotFound):
        line.get(100)
    with pytest.raises(NotFound):
        line.remove([101, 103])
    assert line.get(101) == [1.0]
    found = {r["id"]: r["found"] for r in line.contains(frame(spark, [(100, [0]), (101, [0])])).collect()}
    assert found == {100: False, 101: True}
    before = line.search_one([5], 8)
    assert line.compact() == {"rows_before": 10, "removed_rows": 2, "rows_after": 8}
    assert line.search_one([5], 8) == before
    assert line.compact()["removed_rows"] == 0
    line.add(100, [0])
    assert line.size() == 9


def test_automatic_ids_never_collide(spark):
    c = VectorCollection(spark, CollectionConfig(1))
    c.add_batch(spark.createDataFrame([([float(i)],) for i in range(5)], "vector array<float>"))
    c.remove([1])
    c.compact()
    c.add_batch(spark.createDataFrame([([9.0],)], "vector array<float>"))
    assert c.get(5) == [9.0]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["upsert", "remove", "compact"]), st.lists(st.integers(0, 30), min_size=1, max_size=12, unique=True)), min_size=1, max_size=4), st.sampled_from(["l2", "ip"]))
def test_random_operations_match_a_model(spark, steps, metric):
    """Whole-number vectors, so that distances are exact and ties are real."""
    c, model, rng = VectorCollection(spark, CollectionConfig(4, metric)), [], np.random.default_rng(1)
    for what, ids in steps:
        if what == "upsert":
            rows = [(i, rng.integers(-8, 9, 4)) for i in sorted(ids)]
            c.add_batch(frame(spark, rows), upsert=True)
            model = [r for r in model if r[0] not in ids] + rows
        elif what == "remove":
            live = [i for i in ids if any(i == r[0] for r in model)]
            if live:
                c.remove(live)
                model = [r for r in model if r[0] not in live]
        else:
            c.compact()
    q = rng.integers(-8, 9, (3, 4))
    d = [[(float(((v - x) ** 2).sum()) if metric == "l2" else -float((v * x).sum()), k, i) for k, (i, v) in enumerate(model)] for x in q]
    expected = [(a, b[2], b[0]) for a, x in enumerate(d) for b in sorted(x)[:5]]
    got = [(r["qid"], r["id"], r["distance"]) for r in c.search(asked(spark, q), 5).orderBy("qid", "rank").collect()]
    assert got == expected


def test_config_ranges():
    for bad in ({"dim": 0}, {"dim": 3, "metric": "L2"}, {"dim": 3, "index": "x"}):
        with pytest.raises(InvalidInput):
            CollectionConfig(**bad)
    for bad in ({"m": 1}, {"ef_construction": 2}, {"max_level": 0}):
        with pytest.raises(InvalidInput):
            GraphParams(**bad)
    with pytest.raises(InvalidInput):
        SearchParams(0)
    assert CollectionConfig(3, "inner_product").metric == "ip" and CollectionConfig(3, "cosine").normalize
    config = CollectionConfig(3, "cosine", index="hnsw")
    assert CollectionConfig.from_json(config.to_json()) == config


def test_catalog(spark, tmp_path):
    root = f"file://{tmp_path}/catalog"
    catalog = VectorCatalog(spark, root)
    c = catalog.create("a-1", CollectionConfig(1))
    c.add_batch(frame(spark, [(1, [1]), (2, [2])]))
    assert catalog.save("a-1") == 1
    catalog.get("a-1").remove([1])
    assert catalog.save("a-1") == 2
    for bad in ("", "a/b", "x" * 65):
        with pytest.raises(InvalidInput):
            catalog.create(bad, CollectionConfig(1))
    with pytest.raises(AlreadyExists):
        catalog.create("a-1", CollectionConfig(1))
    (tmp_path / "catalog/half").mkdir()  # a creation that stopped
    (tmp_path / "catalog/a-1/generation.000003").mkdir()  # a save that stopped
    again = VectorCatalog(spark, root)
    assert again.names() == ["a-1"] and not (tmp_path / "catalog/half").exists()
    assert again.get("a-1").search_one([0], 5) == [(2, 4.0)]
    assert [tuple(r) for r in again.entries().collect()] == [("a-1", 1, "l2", "flat", 2, 2, 1)]
    (tmp_path / "catalog/a-1/MANIFEST").write_text("{}")
    with pytest.raises(Corrupt):
        VectorCatalog(spark, root)
    (tmp_path / "catalog/a-1/MANIFEST").unlink()
    catalog.drop("a-1")
    with pytest.raises(NotFound):
        catalog.get("a-1")


def test_a_replayed_micro_batch_counts_once(spark):
    c = VectorCollection(spark, CollectionConfig(1))
    ingest = Ingest(c)
    ingest(frame(spark, [(1, [1]), (2, [2])]), 0)
    ingest(frame(spark, [(1, [1]), (2, [2])]), 0)
    ingest(frame(spark, [(2, [5])]), 1)
    assert c.stats().first().asDict() == {"live": 2, "deleted": 1, "rows": 3}
