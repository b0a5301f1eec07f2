import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from halyard.llm.line_templates import drop_templates

from .conftest import words


def lines(k, seed):
    return [" ".join(words(12, f"{seed}-{i}")) for i in range(k)]


def test_recurring_templates_go_but_for_the_first(make):
    rows = []
    for i in range(12):
        own = lines(4, i)
        own.insert(1, f"Page {i} of 12 printed by the office of {words(1, i)[0]} on request")
        own.append("All rights reserved.")
        if i in (3, 4):
            own.append("a line that two documents have in common here")
        rows.append((i, "\n".join(own), "a"))
    got = {r["doc_id"]: r for r in drop_templates(make(rows)).collect()}
    assert got[0]["text"] == rows[0][1] and got[0]["dropped"] is None
    for i in range(1, 12):
        kept = got[i]["text"].split("\n")
        assert kept[:4] == lines(4, i)  # a document's own lines stay
        assert not any(x.startswith("Page") or "reserved" in x for x in kept)
    assert "a line that two documents have in common here" in got[3]["text"] and "a line that two" in got[4]["text"]
    assert got[5]["n_lines"] == 6 and got[5]["dropped"] == [1, 5]


def test_unlike_lines_with_a_common_opening_stay(make):
    docs = make([(i, "once upon a " + " ".join(words(20, i)), "a") for i in range(30)])
    assert drop_templates(docs).where("dropped is not null").count() == 0


def test_awkward_documents(awkward, empty):
    got = drop_templates(awkward).collect()
    assert len(got) == awkward.count()
    texts = sorted(r["text"] or "-" for r in awkward.collect())
    assert sum(r["text"] is None for r in got) == 2
    assert Counter(r["text"] or "-" for r in got if r["dropped"] is None) <= Counter(texts)
    assert drop_templates(empty).count() == 0


@pytest.mark.parametrize("size", [100, 1000, 4000])
def test_a_template_goes_however_often_its_fields_repeat(make, size):
    rng = random.Random(size)
    line = lambda: f"This article was written by {words(1, rng.randrange(208))[0]}n{rng.choice('abcdefgh')} from the desk in {words(1, rng.randrange(208))[0]}c{rng.choice('abcdefgh')} for all readers of m{rng.choice('abcdefghijkl')} edition"
    got = drop_templates(make([(i, f"{lines(1, i)[0]}\n{line()}", "a") for i in range(size)]))
    assert got.where("array_contains(dropped, 1)").count() == size - 1
    assert got.where("doc_id = 0 and not coalesce(array_contains(dropped, 1), false)").count() == 1


def test_short_lines_that_recur_go(make):
    rows = [(i, "\n".join(["Read more", lines(1, i)[0], f"Own{'abcdef'[i]}", " Of."]), "a") for i in range(6)]
    got = {r["doc_id"]: r["text"].split("\n") for r in drop_templates(make(rows)).collect()}
    assert got[0] == rows[0][1].split("\n")
    assert all(got[i] == rows[i][1].split("\n")[1:3] for i in range(1, 6))


def test_a_passage_of_two_documents_goes(make):
    passage = " ".join(words(60, "passage"))
    rows = [(i, "\n".join([lines(1, i)[0], passage, f"Own{'ab'[i]} end"]), "a") for i in range(2)]
    got = {r["doc_id"]: r for r in drop_templates(make(rows)).collect()}
    assert got[0]["text"] == rows[0][1] and got[0]["dropped"] is None
    assert got[1]["dropped"] == [1]


def by_hand(rows, min_docs=3, fixed=0.6, templates=True, passages=True):
    """Dropped (row, line) pairs, by plain loops over the definitions. Ids are not null."""
    parsed = []  # (row, doc, pos, tokens, raw tokens)
    for r, (doc, text, *_) in enumerate(rows):
        for pos, line in enumerate((text or "").split("\n")):
            raw = line.split()
            if raw:
                parsed.append((r, doc, pos, tuple(re.sub("[0-9]+", "0", line).split()), tuple(raw)))
    leaf = lambda w: (len(w), w[:3])
    support, first, groups = defaultdict(set), {}, defaultdict(list)
    for r, doc, pos, w, _ in parsed:
        for at, t in enumerate(w):
            support[leaf(w), at, t].add(doc)
    letter = lambda t: any(c.isalpha() for c in t)
    for r, doc, pos, w, raw in parsed:
        names = [("whole", w)] if templates and len(w) < 3 and any(map(letter, w)) else []
        if templates and len(w) >= 3:
            n = {at: len(support[leaf(w), at, t]) for at, t in enumerate(w)}
            for s in {x for x in n.values() if x >= min_docs}:
                at = [a for a in n if n[a] >= s]
                if len(at) >= fixed * len(w) and any(letter(w[a]) for a in at):
                    names.append(("template", leaf(w), tuple((a, w[a]) for a in at)))
        if passages and len(raw) >= 50 and any(map(letter, raw)):
            names.append(("passage", raw))
        for name in names:
            groups[name].append((doc, r, pos))
    for name, members in groups.items():
        if len({d for d, _, _ in members}) >= (2 if name[0] == "passage" else min_docs):
            for _, r, pos in members:
                line = next(p[3] for p in parsed if p[:1] == (r,) and p[2] == pos)
                first.setdefault(("raw", next(p[4] for p in parsed if p[0] == r and p[2] == pos)) if name[0] == "passage" else line, set()).add(min(members)[0])
    out = set()
    for r, doc, pos, w, raw in parsed:
        # a line kept as a first of its templates and as a passage goes if either is another document's
        for key in (w, ("raw", raw)):
            if key in first and doc != min(first[key]):
                out.add((r, pos))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_as_by_plain_loops(make, seed):
    """Rare words, numeric rows, many lines of a leaf in one document, tabs and double spaces."""
    rng = random.Random(seed)
    pool = ["alpha", "beta", "gamma", "7", "12.5"]
    some = lambda k: [rng.choice(pool) for _ in range(k)]

    def line():
        kind = rng.randrange(7)
        if kind == 0:
            return "\t".join(some(rng.randrange(1, 3)))
        if kind == 1:
            return f"Item one  costs {rng.choice(['red', 'blue'])} {rng.choice(['apples', 'pears', 'plums', 'figs'])}"
        if kind == 2:
            return " ".join(f"{rng.randrange(100)}.{rng.randrange(9)}" for _ in range(4))
        if kind == 3:
            return " ".join(words(55, rng.randrange(6))) + (f" {rng.randrange(2)}" if rng.random() < 0.5 else "")
        if kind == 4:
            return "Read more"
        if kind == 5:
            return " ".join(words(6, rng.random()))
        return " ".join(["one", "two", *some(3), *words(1, rng.random())])

    rows = [(i, "\n".join(line() for _ in range(rng.randrange(1, 9))), "a") for i in range(25)]
    got = {(r["doc_id"], p) for r in drop_templates(make(rows)).collect() for p in r["dropped"] or ()}
    assert got == {(rows[r][0], p) for r, p in by_hand(rows)}


def test_lines_of_one_document_are_one_document(make):
    rows = [(1, "Item one costs red apples\nItem one costs red pears", "a"), (2, "Item one costs red plums", "a")]
    assert drop_templates(make(rows)).where("dropped is not null").count() == 0
    assert drop_templates(make([*rows, (3, "Item one costs red figs", "a")])).where("dropped is not null").count() == 2


def test_rows_of_numbers_stay(make):
    rows = [(i, f"{i}.5 3.{i} 7.7\n{i} {i}", "a") for i in range(6)]
    assert drop_templates(make(rows)).where("dropped is not null").count() == 0


def test_null_and_repeated_ids(make):
    """Null ids are told apart by text; of an id with two texts a line stays in one that has it; equal rows are one document."""
    line = "Sign up for our weekly letter"
    rows = [(None, f"{line}\nown {k} text here", "a") for k in "abc"] + [(5, f"{line}\nfirst", "a"), (5, f"{line}\nsecond", "a"), (5, "nothing else of it", "a")]
    got = drop_templates(make(rows)).collect()
    assert sum(line in r["text"] for r in got) == 1 and [r["doc_id"] for r in got if line in r["text"]] == [5]
    assert drop_templates(make([(1, line, "a")] * 4 + [(2, line, "a")])).where("dropped is not null").count() == 0
    own = make(rows).withColumn("n_lines", F.lit("own")).withColumn("dropped", F.lit("own"))
    assert {(r["n_lines_before"], r["dropped_before"]) for r in drop_templates(own).collect()} == {("own", "own")}
