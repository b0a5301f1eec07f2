import random

import numpy as np
import pytest

from halyard.llm import ngram_join
from halyard.llm.components import components
from halyard.llm.ngram_join import keep_one_of_each, link, near_duplicates

from .conftest import words


def grams(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, n, percent):
    sets = [grams(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), d), d)
    return sorted((d, len(s), best[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def varied(seed=1):
    """Groups of near copies at all distances, a passage and a line that many documents share, and short texts."""
    rng, rows = random.Random(seed), []
    passage = words(60, "passage")
    for g in range(12):
        base = words(rng.choice([8, 30, 120]), f"g{g}")
        for _ in range(rng.choice([1, 3, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = f"new{rng.random()}"
            rows.append(w)
    for k in range(90):
        rows.append(words(rng.choice([3, 20, 40]), f"p{k}") + passage)
    big = words(100, "big")
    for k in range(90):
        w = list(big)
        w[k] = f"own{k}"
        rows.append(w)
    rows += [words(k % 5, f"s{k % 7}") for k in range(20)]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return [(i, " ".join(w)) for i, w in zip(ids, rows)]


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_matches_brute_force(make, n, percent):
    rows = varied()
    got = near_duplicates(make([(i, t, "a") for i, t in rows]), n, percent)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute(rows, n, percent)


def test_tiles_and_small_buckets(make, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 2500)
    monkeypatch.setattr(ngram_join, "KEYS", 200)
    monkeypatch.setattr(ngram_join, "SHORT", 4)
    monkeypatch.setattr(ngram_join, "DEALT", 300)
    rows = varied(2)
    got = near_duplicates(make([(i, t, "a") for i, t in rows]))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute(rows, 4, 85)


def test_block_search_joins_all_linked_sets(monkeypatch):
    monkeypatch.setattr(ngram_join, "LARGE", 5)
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(12):
        base = rng.choice(3000, 60, replace=False)
        for _ in range(int(rng.integers(1, 25))):
            s = base.copy()
            k = int(rng.integers(0, 9))
            s[:k] = rng.choice(10_000, k) + 3000
            sets.append(np.unique(s).astype(np.uint64))
    rng.shuffle(order := np.arange(len(sets)))
    sets = [sets[i] for i in order]
    roots = lambda pairs: (lambda f: ([f.join(a, b) for a, b in pairs], [f.find(i) for i in range(len(sets))])[1])(ngram_join.Forest())
    every = [(i, j) for i in range(len(sets)) for j in range(i) if 185 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (len(sets[i]) + len(sets[j])) and c]
    links = link(sets)
    assert set(map(frozenset, links)) <= set(map(frozenset, every))
    assert roots(links) == roots(every)


def test_one_of_each_group_stays(make):
    rows = varied(3)
    docs = make([(i, t, "a") for i, t in rows])
    kept = {r["doc_id"] for r in keep_one_of_each(docs).collect()}
    assert kept == {d if n == 0 else c for d, n, c in brute(rows, 5, 80)}


def test_links_across_sides_join_all_linked_sets():
    rng, sets = np.random.default_rng(5), []
    for _ in range(15):
        base = rng.choice(3000, 50, replace=False)
        for _ in range(int(rng.integers(1, 9))):
            s = base.copy()
            k = int(rng.integers(0, 6))
            s[:k] = rng.choice(10_000, k) + 3000
            sets.append(np.unique(s).astype(np.uint64))
    side = [bool(x) for x in rng.integers(0, 2, len(sets))]
    every = [(i, j) for i in range(len(sets)) for j in range(i) if side[i] != side[j] and 185 * len(np.intersect1d(sets[i], sets[j])) >= 85 * (len(sets[i]) + len(sets[j]))]
    links = link(sets, 85, side)
    roots = lambda pairs: (lambda f: ([f.join(a, b) for a, b in pairs], [f.find(i) for i in range(len(sets))])[1])(ngram_join.Forest())
    assert set(map(frozenset, links)) <= set(map(frozenset, every)) and roots(links) == roots(every)


def test_one_stays_of_equal_rows_and_of_texts_without_ids(make):
    a, b, c = (" ".join(words(30, k)) for k in "abc")
    rows = [(1, a, "x")] * 3 + [(None, b, "x")] * 4 + [(None, b + " more", "x"), (None, c, "x"), (7, c, "x"), (7, c + " end", "x"), (8, "", "x"), (8, "", "x"), (None, None, "x")]
    kept = sorted(((r["doc_id"], r["text"]) for r in keep_one_of_each(make(rows).repartition(3)).collect()), key=repr)
    assert len(kept) == 6 and (1, a) in kept and kept.count((8, "")) == 2 and (None, None) in kept
    assert sum(t in (b, b + " more") for _, t in kept) == 1 and [d for d, t in kept if t in (c, c + " end")] == [7]


def test_components_of_a_long_path(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1002), (5, 5)], "a long, b long").repartition(4)
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000, 1002: 1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_awkward_documents(awkward, empty):
    got = near_duplicates(awkward).collect()
    assert len(got) == awkward.count()
    assert sorted(r["component_id"] for r in got if r["doc_id"] in (1, 2)) == [1, 1, 1]
    assert all(r["component_id"] == r["doc_id"] for r in got if r["n_shingles"] == 0)
    assert near_duplicates(empty).count() == 0
    assert keep_one_of_each(awkward).columns == awkward.columns
