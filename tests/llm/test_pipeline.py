import os
import random

import pytest

import corpus_pipeline
from halyard.llm.common import stored

from halyard.llm.packing import default_path, encoder

from .conftest import words
from .test_line_templates import by_hand
from .test_ngram_join import brute

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_the_clean_documents(spark, awkward, make):
    rng = random.Random(1)
    line = lambda seed: " the ".join(" ".join("".join(rng.choices("abdeklmnorst", k=5)) for _ in range(6)) for j in range(4))
    clean = [(1000 + i, ".\n".join(line(f"{i}-{k}") for k in range(6)) + ".", f"s{i % 3}") for i in range(40)]
    copies = [(2000 + i, clean[i][1] + " more", "s1") for i in range(3)]
    junk = [(3000, "!! ".join(x.upper() for x in words(90, 1)), "s1")]
    docs = stored(make(clean + copies + junk))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, ""))
        if name != "packing":
            assert out.columns == docs.columns, name
        docs = out
        seen.append({r["doc_id"] for r in out.select("doc_id").collect()})
    ids = {c[0] for c in clean}
    assert seen[0] == ids | {c[0] for c in copies}
    assert seen[2] == ids
    assert seen[3] <= ids and seen[4] == seen[3]


def test_nothing_remains_of_a_group_of_copies_with_a_short_line(spark, make):
    text = "\n".join([" ".join(words(60, 1)) + ".", "Eauouon.", " ".join(words(30, 2)) + "."])
    docs = make([(i, text, "a") for i in range(4)] + [(9, " ".join(words(80, 3)), "a")])
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.near_copies):
        docs = stored(stage(spark, docs, ""))
    assert {(r["doc_id"], r["text"]) for r in docs.collect()} == {(0, text), (9, " ".join(words(80, 3)))}


def test_passages_go_and_leave_nothing_of_near_copies(spark, make):
    passage, own = " ".join(words(60, 1)), [" ".join(words(40, k)) for k in (2, 3)]
    near = "\n".join([" ".join(words(300, 4)), "A short line of it.", " ".join(words(70, 5))])
    docs = make([(0, f"{passage}\n{own[0]}", "a"), (1, f"{own[1]}\n{passage}", "a"), (2, near, "a"), (3, near + " more", "a")])
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.near_copies):
        docs = stored(stage(spark, docs, ""))
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in docs.collect()}
    assert got == {i: (t, len(t)) for i, t in ((0, f"{passage}\n{own[0]}"), (1, own[1]), (2, near))}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_awkward_documents(spark, awkward, empty, name, stage):
    """Nulls, clashing columns and empty tables; other columns come through as they were."""
    for docs in (awkward, empty):
        out = stage(spark, docs, "")
        rows = out.collect()
        if name != "packing":
            assert out.columns == docs.columns
            assert all(r["dropped"] == r["kept"] == r["n"] == r["mix_size"] == r["n_lines"] == r["copy"] == "clash" for r in rows)
        if docs is empty:
            assert not rows
        elif name != "quality":  # which may reject all of so few
            assert rows


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_run_over_small_tables(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.count() > 0 and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)


def test_stages_as_by_plain_loops(spark, make):
    """Line, near-copy and passage decisions against loops over the definitions, words of the mix, tokens of the packing."""
    rng = random.Random(11)
    foot, passage = "Printed by the office of {} on request of readers", " ".join(words(60, "passage"))
    rows = []
    for i in range(36):
        own = [" ".join(words(25, f"{i}-{k}")) for k in range(5)]
        if i % 3 == 0:
            own.insert(rng.randrange(5), foot.format(words(1, i)[0]))
        if i in (7, 20):
            own.insert(2, passage)
        if i % 5 == 0:
            own.append("Read more")
        rows.append((i, "\n".join(own), f"s{i % 3}"))
    rows += [(100 + i, rows[i][1] + " tail", "s1") for i in range(6)] + [(200, rows[8][1], "s2"), (201, rows[8][1], None)]
    docs = make(rows)
    lined = {r["doc_id"]: r["text"] for r in stored(corpus_pipeline.line_dedup(spark, docs, "")).collect()}
    gone = {p for p in by_hand(rows, passages=False)}
    want = {}
    for r, (doc, text, *_) in enumerate(rows):
        left = [x for k, x in enumerate(text.split("\n")) if (r, k) not in gone]
        if left:
            want[doc] = "\n".join(left)
    assert lined == want
    docs = make([(d, t, "s") for d, t in sorted(lined.items())])
    near = {r["doc_id"]: r["text"] for r in stored(corpus_pipeline.near_copies(spark, docs, "")).collect()}
    ones = [(d, t, "s") for d, t in sorted(lined.items()) if d in {c for _, _, c in brute(sorted(lined.items()), 5, 80)}]
    gone = {(r, p) for r, p in by_hand(ones, templates=False)}
    want = {}
    for r, (doc, text, *_) in enumerate(ones):
        left = [x for k, x in enumerate(text.split("\n")) if (r, k) not in gone]
        if left:
            want[doc] = "\n".join(left)
    assert near == want and 7 in near and passage in near[7] and passage not in near[20]
    docs = make([(d, t, f"s{d % 3}") for d, t in sorted(near.items())])
    mixed = corpus_pipeline.source_mix(spark, docs, "").collect()
    n = {d: len(t.split()) for d, t in near.items()}
    total, size = sum(n.values()), {s: sum(k for d, k in n.items() if d % 3 == s) for s in range(3)}
    taken = {s: sum(len(r["text"].split()) for r in mixed if r["doc_id"] % 3 == s) for s in range(3)}
    assert all(abs(taken[s] - min(3 * size[s], total * w / 8)) <= 1 for s, w in ((0, 5), (1, 2), (2, 1)))
    pieces = corpus_pipeline.packing(spark, make([(r["doc_id"], r["text"], r["source"]) for r in mixed]), "").collect()
    assert sum(r["length"] for r in pieces) == sum(len(encoder(default_path()).encode(r["text"])) // 4 + 1 for r in mixed)
