import math
import zlib
from collections import Counter

import numpy as np
import pytest

from halyard.llm.subword_lm import MARK, Lattice, default_path, in_parts, load, score_documents, train

from .conftest import words


def brute(lattice, word, logp):
    """Sum over all segmentations, one by one."""
    def total(s):
        if not s:
            return 1.0
        out, single = 0.0, s[0] in lattice.ids
        for e in range(1, len(s) + 1):
            if s[:e] in lattice.ids:
                out += math.exp(logp[lattice.ids[s[:e]]]) * total(s[e:])
        if not single:
            out += math.exp(logp[lattice.spell(s[0])].sum()) * total(s[1:])
        return out

    return math.log(total(word))


def test_forward_recursion_sums_all_segmentations():
    lattice, logp = load(default_path())
    items = [MARK + w for w in ("the", "thouble", "naïve", "日x", "a" * 70, "zqxj")]
    got = lattice.score(items, logp)
    for w, x in zip(items, got):
        if len(w) < 20:
            assert x == pytest.approx(brute(lattice, w, logp))
    codes = items[4]
    assert got[4] == pytest.approx(lattice._long(codes, logp, None))


def test_expected_uses_spell_the_words():
    bytes_ = {b: b for b in range(256)}
    lattice = Lattice([f"<{b}>" for b in range(256)] + ["a", "b", "ab"], bytes_)
    logp = np.full(260, math.log(1 / 260))
    uses = lattice.expect(["ab", "é"], np.array([2.0, 1.0]), logp)
    p, q = 1 / 260, 1 / 260**2
    assert uses[258] == pytest.approx(2 * p / (p + q)) and uses[256] == pytest.approx(2 * q / (p + q))
    assert uses[[0xC3, 0xA9]].tolist() == [1, 1]


def test_scores(make):
    rows = [(i, "  ".join(words(40, i % 37)).upper() + "\n", "a") for i in range(150)]
    got = {r["doc_id"]: r for r in score_documents(make(rows), share=0.02).collect()}
    counts = Counter()
    for i, text, _ in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(text.lower().split() + [None])
    n, v = sum(counts.values()), len(counts)
    for i, text, _ in rows:
        tokens = text.lower().split() + [None]
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens))
        assert r["score"] < 0
    other = {r["doc_id"]: r["score"] for r in score_documents(make(rows), share=1.0).collect()}
    assert all(other[i] == pytest.approx(got[i]["score"], rel=1e-9) for i in other)  # joined or broadcast counts


def test_scores_sum_all_segmentations_of_all_words(spark, make):
    """The score by plain recursion over segmentations, under weights that expectation-maximisation learned by hand."""
    rows = [(i, " ".join(words(6, i % 9)) + " é日", "a") for i in range(30)]
    lattice, logp = load(default_path())
    counts, ends = Counter(), 0
    for i, text, _ in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(text.split())
            ends += 1

    def paths(s):
        if not s:
            yield []
        for e in range(1, len(s) + 1):
            if s[:e] in lattice.ids:
                yield from ([lattice.ids[s[:e]], *rest] for rest in paths(s[e:]))
        if s and s[0] not in lattice.ids:
            yield from ([*lattice.spell(s[0]), *rest] for rest in paths(s[1:]))

    for _ in range(3):
        uses = np.full(lattice.n + 1, 0.1)
        uses[-1] += ends
        for w, n in counts.items():
            every = [(path, math.exp(sum(logp[i] for i in path))) for path in paths(MARK + w)]
            total = sum(p for _, p in every)
            for path, p in every:
                for i in path:
                    uses[i] += n * p / total
        logp = np.log(uses / uses.sum())
    learned = train(spark.createDataFrame([(w.encode(), n) for w, n in counts.items()], "word binary, n long"), ends)
    assert np.abs(learned - logp).max() < 1e-6
    for r in score_documents(make(rows)).collect():
        text = rows[r["doc_id"]][1]
        assert r["score"] == pytest.approx(sum(brute(lattice, MARK + w, logp) for w in text.split()) / math.log(10) + logp[-1] / math.log(10), rel=1e-6)


def test_texts_go_in_parts_by_bytes():
    assert [len(x) for x in in_parts([b"a"] * 600)] == [256, 256, 88]
    assert [len(x) for x in in_parts([b"a" * 600_000] * 3)] == [2, 1]
    assert list(in_parts([])) == []


def test_awkward_documents(awkward, empty):
    got = score_documents(awkward).collect()
    assert len(got) == awkward.count()
    assert sorted(r["n_tokens"] for r in got) == sorted(len((r["text"] or "").encode().split()) + 1 for r in awkward.collect())
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    assert score_documents(empty).count() == 0


def test_a_long_word_scores_the_same_by_the_join(make):
    rows = [(i, " ".join(words(20, i)) + (" " + "日本語テスト" * 40 + "qzxj" * 100 if i % 3 == 0 else ""), "a") for i in range(40)]
    direct, joined = ({r["doc_id"]: r["score"] for r in score_documents(make(rows), share=share).collect()} for share in (1e-6, 1.0))
    assert all(math.isfinite(x) for x in joined.values())
    assert all(abs(direct[i] - joined[i]) < 1e-6 for i in direct)
