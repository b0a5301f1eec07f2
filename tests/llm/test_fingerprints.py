import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from halyard.llm import fingerprints
from halyard.llm.fingerprints import LEVELS, SETS, fingerprint, with_next

from .conftest import words


def order(rows):
    return sorted(rows, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0)))


def edited(a, b):
    half = len(a) // 2
    return a[: len(a) - half] + b[:half]


def test_edited_texts_and_equal_texts(make):
    rows = [(i, " ".join(words(30 + i % 40, i % 50)), "a") for i in range(120)]
    docs = make(rows).repartition(5)
    got = {r["doc_id"]: r for r in fingerprint(docs).collect()}
    ordered = sorted(rows, reverse=True)
    for k, (i, text, _) in enumerate(ordered):
        other = ordered[(k + 1) % len(ordered)][1]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited(text, other).encode()).hexdigest()
        assert got[i]["n_chars"] == len(text)
        assert 0 <= got[i]["near_next"] <= 1 and 0 <= got[i]["near_edited"] <= 1
    same = {}
    for i, text, _ in rows:
        assert same.setdefault(text, got[i]["fingerprint"]) == got[i]["fingerprint"]
    assert len(set(same.values())) == len(same)
    mean = lambda c: sum(r[c] for r in got.values()) / len(got)
    assert mean("near_edited") > mean("near_next") + 0.1


def test_awkward_documents(awkward, empty):
    got = fingerprint(awkward).collect()
    assert len(got) == awkward.count()
    by_text = {}
    for r in got:
        by_text.setdefault((r["doc_id"], r["n_chars"]), set()).add(r["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    assert fingerprint(empty).count() == 0


def test_one_document_is_its_own_next(make):
    r = fingerprint(make([(1, "alpha beta gamma delta", "a")])).first()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(b"alpha beta galpha beta g"[:11] + b"alpha beta ").hexdigest()


def test_texts_without_terms_of_the_lexicon_differ(make):
    hot = " ".join(f"hot{k}" for k in range(40))
    rows = [(i, f"{hot} near{'a' if i % 2 else 'b'}", "a") for i in range(40)] + [(40 + i, " ".join(f"w{i}x{k}" for k in range(40)), "a") for i in range(40)]
    rows += [(80, "!!!", "a"), (81, "???", "a"), (82, "", "a"), (83, None, "a")]
    got = {r["doc_id"]: r for r in fingerprint(make(rows)).collect()}
    blank = got[82]["fingerprint"]
    assert got[83]["fingerprint"] == blank and got[83]["near_next"] == 1.0
    assert len({got[i]["fingerprint"] for i in (0, 1, 40, 80, 81, 82)}) == 6
    assert got[81]["near_next"] < 1.0 and got[40]["near_next"] < 0.5
    assert got[10]["near_edited"] > 0 and got[10]["near_next"] > 0.5 and got[40]["near_edited"] > 0


def by_hand(rows, least, most):
    """Fingerprint sets as tuples of terms instead of hashes, and likenesses, by plain loops; {(id, text): [(near_edited, near_next, n sets)]}."""
    terms = lambda t: frozenset(re.findall(r"[^\W_]+", t.lower())) or (frozenset([t]) if t else frozenset())
    distinct = {t or "" for _, t, _ in rows}
    df = Counter(w for t in distinct for w in terms(t))
    lexicon = {w for w, n in df.items() if least * len(distinct) <= n <= max(most * len(distinct), 1)}
    return terms, lexicon


def sets_by_hand(words, h):
    out = []
    for level in range(LEVELS):
        for k in range(SETS):
            out.append(frozenset(w for w in words if not h[w] & ((1 << 2 * level) - 1) and h[w] >> 60 & 15 == k) or None)
    return out


def like(a, b):
    best = 0.0
    for level in range(LEVELS):
        pairs = [(x, y) for x, y in zip(a[level * SETS : (level + 1) * SETS], b[level * SETS : (level + 1) * SETS]) if x or y]
        if len(pairs) >= (4 if level else 1):
            best = max(best, sum(x == y for x, y in pairs) / len(pairs))
    return best


@pytest.mark.parametrize("seed", range(2))
def test_as_by_plain_loops(spark, make, seed):
    """Rare words, common words, texts without terms of the lexicon, copies, repeated and null ids."""
    rng = random.Random(seed)
    pool = words(60, seed)
    text = lambda: rng.choice([" ".join(rng.choices(pool, k=rng.randrange(1, 40))), " ".join(words(30, rng.random())), "...", "", None, "common words of all"])
    rows = [(rng.choice([i, i, i, 7, None]), text(), "a") for i in range(80)]
    rows += [rows[3]] * 3
    terms, lexicon = by_hand(rows, 0.05, 0.4)
    every = sorted({w for _, t, _ in rows for w in terms(t or "")} | {w for _, t, _ in rows for _, u, _ in rows for w in terms(edited(t or "", u or ""))})
    h = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in every], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    tie = {r["w"]: r["h"] for r in spark.createDataFrame([(t or "",) for _, t, _ in rows], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    ordered = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (-(1 << 63) if r[0] is None else r[0], tie[r[1]]), reverse=True)

    def near(a, b):
        if a == b:
            return 1.0
        x, y = terms(a) & lexicon, terms(b) & lexicon
        x, y = (x, y) if x and y else (terms(a), terms(b))
        return like(sets_by_hand(x, h), sets_by_hand(y, h))

    want = Counter()
    for k, (i, t) in enumerate(ordered):
        u = ordered[(k + 1) % len(ordered)][1]
        e = edited(t, u)
        want[i, len(t), hashlib.sha256(e.encode()).hexdigest(), round(near(t, e), 6), round(near(t, u), 6)] += 1
    got = fingerprint(make(rows).repartition(3), 0.05, 0.4).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 6), round(r["near_next"], 6)) for r in got) == want
    name = {}  # texts agree in a fingerprint exactly if they agree in their sets
    for k, (i, t) in enumerate(ordered):
        own = terms(t) & lexicon or terms(t)
        name.setdefault(hashlib.sha256(edited(t, ordered[(k + 1) % len(ordered)][1]).encode()).hexdigest(), set()).add(tuple(sets_by_hand(own, h)))
    prints = {}
    for r in got:
        if len(name[r["edited_sha256"]]) == 1:
            assert prints.setdefault(r["fingerprint"], next(iter(name[r["edited_sha256"]]))) == next(iter(name[r["edited_sha256"]]))
    assert len(set(prints.values())) == len(prints)


def test_unrelated_texts_of_rare_words_differ(make):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(60)), "a") for i in range(300)]
    got = fingerprint(make(rows), 0.05, 0.4).collect()
    assert len({r["fingerprint"] for r in got}) == 300 and max(r["near_next"] for r in got) == 0.0


def test_a_frequent_id_and_equal_rows_are_parted(make):
    """Most rows have no id, and most of those the same text: buckets stay small and each row is followed as it should."""
    rows = [(None, "the same text of all", "a")] * 300 + [(None, " ".join(words(20, k)), "a") for k in range(150)] + [(i, " ".join(words(20, -i)), "a") for i in range(50)]
    docs = make(rows).select("doc_id", F.coalesce("text", F.lit("")).alias("t")).repartition(4)
    dealt = with_next(docs, 32).collect()
    assert max(Counter(r["bucket"] for r in dealt).values()) < 60 and sum(r["copies"] for r in dealt if r["own"]) == 500
    got = fingerprint(make(rows)).collect()
    assert len(got) == 500 and sum(r["near_next"] == 1.0 for r in got) >= 299


def test_buckets_and_their_first_texts_have_the_same_bounds(make, monkeypatch):
    """Percentiles of many rows are approximate: each reckoning may give others."""
    asked = []

    def moving(light, buckets):
        asked.append(buckets)
        return [(o + len(asked), fingerprints._LOWEST) for o in range(10, 110, 20)]

    monkeypatch.setattr(fingerprints, "_bounds", moving)
    rows = [(i, " ".join(words(20 + i % 30, i)), "a") for i in range(120)]
    got = {r["doc_id"]: r["next_t"] for r in with_next(make(rows).select("doc_id", F.col("text").alias("t"))).where("own").collect()}
    assert got == {i: rows[i - 1][1] for i in range(120)}
