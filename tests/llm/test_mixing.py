from collections import defaultdict

import pytest

from halyard.llm.mixing import mix, mix_texts, schedule

from .conftest import words


def water_fill(sizes, weights=(5.0, 2.0, 1.0), most=3.0):
    """Share all words by weight; hand on what passes a limit, until nothing does."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > most * sizes[s] + 1e-9}
        if not over:
            return target | {s: most * sizes[s] for s in full}
        full |= over


def test_targets_and_taken_words(make):
    rows = [(i, " ".join(words(10 + i % 50, i)), s) for i, s in enumerate(["b"] * 40 + ["a"] * 3 + [None] * 25 + ["é"] * 30 + ["Z"] * 1)]
    got = mix(make(rows), block=64).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    target = water_fill(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1
    assert len(got) == len(rows)
    again = {(r["doc_id"], r["taken"]) for r in mix(make(rows).repartition(3), block=64).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}


def test_every_stretch_follows_the_shares(spark):
    targets = spark.createDataFrame([("0a", 3000, 6000.0, 6000), ("0b", 3000, 3000.0, 3000), ("0c", 900, 1000.0, 1000)], "source string, source_size long, target double, words long")
    got = schedule(targets, 10_000, 10).orderBy("slot").collect()
    assert sum(r["take"] for r in got) == 10_000
    for n in (50, 200, 700):
        share = sum(r["source"] == "0a" for r in got[:n]) / n
        assert abs(share - 0.6) < 4 / n
    for s in ("0a", "0b", "0c"):
        ranks = sorted(r["rank"] for r in got if r["source"] == s)
        assert ranks == list(range(len(ranks)))


def test_awkward_documents(awkward, empty):
    got = mix(awkward).collect()
    assert len(got) == awkward.count()
    assert sorted(r["size"] for r in got) == sorted(len((r["text"] or "").encode().split()) for r in awkward.collect())
    assert mix(empty).count() == 0
    out = mix_texts(awkward)
    assert out.columns == awkward.columns
    assert mix_texts(empty).count() == 0


def test_mixed_texts_hold_the_taken_words(make):
    docs = make([(i, "  ".join(words(30, i)), "a" if i % 3 else "b") for i in range(40)])
    taken, texts = mix(docs, block=16).collect(), mix_texts(docs, block=16).collect()
    held = defaultdict(int)
    for r in texts:
        held[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert held == {r["doc_id"]: r["taken"] for r in taken if r["taken"]}


def test_repeated_rows_share_what_is_taken(make):
    """Equal rows, without ids too: together they hold the words that the mix takes of them."""
    rows = [(None, " ".join(words(20, 1)), "a")] * 25 + [(3, " ".join(words(15, 2)), "b")] * 3 + [(10 + i, " ".join(words(30, i)), "c") for i in range(9)]
    docs = make(rows).repartition(4)
    want, held = defaultdict(int), defaultdict(int)
    for r in mix(docs, block=16).collect():
        want[r["doc_id"]] += r["taken"]
    for r in mix_texts(docs, block=16).collect():
        held[r["doc_id"]] += len(r["text"].split())
    assert dict(held) == {k: v for k, v in want.items() if v}
