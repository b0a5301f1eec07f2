import heapq

import numpy as np
import pytest

from halyard.config import CollectionConfig, GraphParams, SearchParams
from halyard.functions import kernels, random
from halyard.operators import evaluation, graph
from halyard.operators.collection import VectorCollection
from halyard.operators.search import exact_search

POINTS = [(1.0, 0.0), (1.1, 0.1), (0.0, 1.2), (-1.3, 0.0)]


def choose(points, most, **options):
    far = lambda a, b: float((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2)
    near = sorted((far(p, (0, 0)), i) for i, p in enumerate(points))
    return [i for _, i in graph.select_neighbours(near, most, lambda a, b: far(points[a], points[b]), **options)]


def test_neighbour_selection():
    assert choose(POINTS, 3, keep_pruned=False) == [0, 2, 3]
    assert choose(POINTS, 4, keep_pruned=False) == [0, 2, 3]
    assert choose(POINTS, 4) == [0, 2, 3, 1]
    assert choose(POINTS, 2) == [0, 2]
    assert choose(POINTS, 3, heuristic=False) == [0, 1, 2]
    assert choose([], 4) == []
    assert choose([(1.0, 0.0)] * 3, 3, keep_pruned=False) == [0]


def clustered(n, dim, seed):
    centres = np.random.default_rng(7).uniform(-1, 1, (20, dim))
    rng = np.random.default_rng(seed)
    return (centres[rng.integers(0, 20, n)] + rng.uniform(-0.25, 0.25, (n, dim))).astype(np.float32)


def rows(spark, v, deleted=()):
    return spark.createDataFrame([(i, i, x.tolist(), i in deleted) for i, x in enumerate(v)], "row_id long, id long, vector array<float>, deleted boolean")


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_recall_and_soundness(spark, metric):
    config = CollectionConfig(16, metric, index="hnsw", graph=GraphParams(m=8, ef_construction=60, shards=2))
    v, q = clustered(600, 16, 1), clustered(30, 16, 2)
    c = VectorCollection(spark, config)
    c.add_batch(rows(spark, v).select("id", "vector"))
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "qid long, query array<float>")
    truth = exact_search(c.rows, asked, config, SearchParams(10)).cache()
    recalls = [evaluation.recall_summary(c.search(asked, 10, ef), truth, 10).first()["mean_recall"] for ef in (16, 64, 600)]
    assert recalls[0] <= recalls[1] + 0.01 and recalls[1] >= 0.97 and recalls[2] == 1.0
    assert graph.violations(c.graph(), config.graph).count() == 0
    assert {r["n"] for r in graph.unreachable(c.graph()).collect()} == {0}


def test_deleted_nodes_lead_on_but_are_not_found(spark):
    config = CollectionConfig(16, index="hnsw", graph=GraphParams(m=8, ef_construction=40, shards=1))
    g = graph.build(rows(spark, clustered(200, 16, 3), set(range(0, 200, 2))), config)
    asked = spark.createDataFrame([(0, clustered(1, 16, 4)[0].tolist())], "qid long, query array<float>")
    found = [r["id"] for r in graph.graph_search(g, asked, config, SearchParams(20, 200)).collect()]
    assert len(found) == 20 and all(i % 2 for i in found)


def test_equal_vectors_stay_reachable(spark):
    config = CollectionConfig(4, index="hnsw", graph=GraphParams(m=16, ef_construction=100, shards=1))
    g = graph.build(rows(spark, np.array([[0.25, -1.0, 3.0, 0.5]] * 150, np.float32)), config)
    assert {r["n"] for r in graph.unreachable(g).collect()} == {0}


def test_a_broken_graph_is_reported(spark):
    bad = spark.createDataFrame([(0, 0, 0, 0, [0.0], False, 0, [[0, 1, 1]], 1, 0, 0), (0, 1, 1, 1, [0.0], False, 0, [[7]], None, None, None)], graph.NODE)
    found = {r["problem"] for r in graph.violations(bad, GraphParams()).collect()}
    assert found == {"repeated link", "link to itself", "link to a node that is not on the level"}


def test_beams_find_what_a_search_one_by_one_finds():
    """Against a best-first search with heaps, with and without deleted nodes."""
    v, q = clustered(500, 16, 5), clustered(40, 16, 6)
    p = GraphParams(m=6, ef_construction=40)
    g = graph.Graph(v, random.levels(np.arange(500), p.seed, p.m, p.max_level), "l2", p).grow()
    far = lambda x, nodes: kernels.scores("l2", x[None], np.ones(1, np.float32), v[nodes])[0].tolist()
    for gone in (None, np.random.default_rng(1).random(500) < 0.4):
        nodes, d = g.search(q, np.ones(40, np.float32), 10, 25, gone)
        for x, got, near in zip(q, nodes, d):
            current = (far(x, [g.entry])[0], g.entry)
            for at in range(int(g.levels[g.entry]), 0, -1):
                while (links := [n for n in g.of(at, np.array([current[1]]))[0].tolist() if n >= 0]) and min(zip(far(x, links), links)) < current:
                    current = min(zip(far(x, links), links))
            todo, seen, best = [current], {current[1]}, [] if gone is not None and gone[current[1]] else [current]
            while todo:
                node = heapq.heappop(todo)
                if len(best) == 25 and node > best[-1]:
                    break
                for y in [n for n in g.of(0, np.array([node[1]]))[0].tolist() if n >= 0 and n not in seen]:
                    seen.add(y)
                    item = (far(x, [y])[0], y)
                    if len(best) < 25 or item < best[-1]:
                        heapq.heappush(todo, item)
                        if gone is None or not gone[y]:
                            best = sorted([*best, item])[:25]
            assert [n for _, n in best[:10]] == got.tolist() and [x for x, _ in best[:10]] == near.tolist()


def test_chosen_links_are_those_of_the_plain_rule():
    v = clustered(120, 8, 9)
    for options in ({}, {"keep_pruned": False}, {"heuristic": False}):
        g = graph.Graph(v, np.zeros(120, np.int64), "l2", GraphParams(m=6, **options))
        far = lambda a, b: float(kernels.scores("l2", v[a : a + 1], np.ones(1, np.float32), v[b : b + 1])[0, 0])
        for base in range(20):
            near = sorted((far(base, i), i) for i in range(40, 110))
            want = [n for _, n in graph.select_neighbours(near, 6, far, options.get("heuristic", True), options.get("keep_pruned", True))]
            got = g._select(graph.keys_of(np.array([[d for d, _ in near]], np.float32), np.array([[n for _, n in near]])), 6)[0]
            assert [n for n in got.tolist() if n >= 0] == want


def test_level_histogram_has_zeros(spark):
    g = graph.build(rows(spark, clustered(100, 16, 1)), CollectionConfig(16, index="hnsw", graph=GraphParams(shards=1)))
    got = {r["level"]: r["n"] for r in graph.level_histogram(g, 16).collect()}
    expected = np.bincount(random.levels(np.arange(100), GraphParams().seed, 16, 16), minlength=17)
    assert [got[i] for i in range(17)] == expected.tolist()


@pytest.mark.parametrize("v", [clustered(400, 16, 8), np.repeat(clustered(20, 16, 8), 30, 0)])
def test_every_node_is_linked_where_candidates_are_full(v):
    p = GraphParams(m=2, ef_construction=4)
    g = graph.Graph(v, random.levels(np.arange(len(v)), p.seed, 4, p.max_level), "l2", p).grow()
    assert g.unrepaired == 0
    for at, (place, links) in enumerate(zip(g.place, g.links)):
        members = np.flatnonzero(place >= 0)
        linked = np.bincount(links[links >= 0], minlength=len(v))
        assert set(members[linked[members] == 0].tolist()) <= {g.entry}
        assert (g.linked[at] == linked[members]).all() and (place[links[links >= 0]] >= 0).all()
        assert all(len(set(own)) == len(own) and node not in own for node, own in zip(members.tolist(), ([x for x in own if x >= 0] for own in links.tolist())))


def test_a_beam_with_room_for_all_finds_what_is_in_reach(monkeypatch):
    """The beam itself finds the same, from any start, also where links lead one way and nodes are deleted."""
    v, q = clustered(300, 16, 10), clustered(50, 16, 11)
    p = GraphParams(m=2, ef_construction=4)
    g = graph.Graph(v, random.levels(np.arange(300), p.seed, 4, p.max_level), "l2", p).grow()
    g.links[0][np.random.default_rng(2).random(g.links[0].shape) < 0.5] = -1
    one = np.ones(50, np.float32)
    for gone in (None, np.random.default_rng(1).random(300) < 0.4):
        current = g.far(q, one, np.full((50, 1), g.entry))[:, 0]
        for at in range(int(g.levels[g.entry]), 0, -1):
            g.descend(q, one, current, at, np.ones(50, bool))
        keys = g.beam(q, one, current[:, None], 301, 0, gone)
        keys = np.sort(np.where((graph.nodes_of(keys) >= 0) & ~(np.zeros(300, bool) if gone is None else gone)[graph.nodes_of(keys)], keys, graph.NONE), 1)[:, :20]
        nodes, d = graph.nodes_of(keys), graph.distances_of(keys)
        assert len({tuple(x) for x in nodes}) > 1 and (nodes < 0).any()
        with monkeypatch.context() as m:
            m.setattr(graph.Graph, "beam", lambda *_: pytest.fail("a step for each node"))
            got = g.search(q, one, 20, 300, gone)
        assert (got[0][:, : nodes.shape[1]] == nodes).all() and (got[1][:, : nodes.shape[1]] == d).all()


def test_a_search_that_names_no_beam_has_one_that_fits_the_shards(spark):
    config = CollectionConfig(16, index="hnsw", graph=GraphParams(m=8, ef_construction=40, ef_search=10, shards=2))
    v, q = (np.random.default_rng(i).normal(size=(n, 16)).astype(np.float32) for i, n in ((1, 3000), (2, 60)))
    base = rows(spark, v)
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "qid long, query array<float>")
    truth = exact_search(base, asked, config, SearchParams(10)).cache()
    shards = graph.packed(graph.build(base, config), config)
    recall = lambda params: evaluation.recall_summary(graph.graph_search(shards, asked, config, params), truth, 10).first()["mean_recall"]
    assert recall(SearchParams(10)) >= 0.95
    assert recall(SearchParams(10, 10)) < 0.95  # a beam that is named is kept
    assert graph.graph_search(shards, asked, config, SearchParams(20)).count() == 20 * 60
    beams = [r["beam"] for r in shards.collect()]
    assert all(10 < b < 1500 for b in beams)
    # it depends on the rows alone
    assert sorted(beams) == sorted(r["beam"] for r in graph.packed(graph.build(base.repartition(3), config), config).collect())
