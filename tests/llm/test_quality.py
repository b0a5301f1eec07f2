import re
import time
from collections import Counter

import numpy as np

from halyard.llm import quality
from halyard.llm.quality import RULES, fit, judge, measure

from .conftest import words


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + j for i, t in enumerate(zip(w, w[1:], w[2:])) if windows[t] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rows():
    prose = lambda seed: " the ".join(" ".join(words(6, f"{seed}-{k}")) for k in range(12)) + "."
    good = [(i, prose(i) + "\n" + prose(i + 500), "a") for i in range(60)]
    shout = [(100 + i, "!! ".join(x.upper() for x in words(80, i)), "a") for i in range(6)]
    marks = [(200 + i, "*** ".join(words(90, i + 50)), "a") for i in range(6)]
    again = [(300 + i, "\n".join([" ".join(words(9, i))] * 12), "a") for i in range(6)]
    return good + shout + marks + again


def test_counts_match_brute_force(make, awkward):
    docs = make(rows() + [(900, "a b c a b c d a b", "x"), (901, "a a a a", "x"), (902, "\n a \n a \n\n", "x")])
    for df in (docs, awkward):
        got = sorted(tuple(r[c] for c in COUNTS) for r in measure(df, ["doc_id"]).collect())
        assert got == sorted(brute(r["text"] or "") for r in df.collect())


def test_the_longer_way_counts_the_same(make, monkeypatch):
    monkeypatch.setattr(quality, "_MOST_WINDOWS", 1)
    docs = make(rows()[:5] + [(900, "a b c a b c d a b", "x"), (901, "a a a a", "x")])
    got = sorted(tuple(r[c] for c in COUNTS) for r in measure(docs, ["doc_id"]).collect())
    assert got == sorted(brute(r["text"]) for r in docs.collect())


def test_junk_goes_and_clean_documents_stay(make):
    got = {r["doc_id"]: r for r in judge(make(rows()), ["doc_id"]).collect()}
    assert all(r["kept"] for i, r in got.items() if i < 100)
    assert not any(r["kept"] for i, r in got.items() if i >= 100)


def votes_by_hand(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, chars, symbols, dup, repeat = brute(text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    upper, shouts = sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text), text.count("!")
    ended = sum(bool(re.search(r"[.!?\"\u201d][\x20\x09-\x0D]*$", x)) for x in lines)
    stop = sum(x.lower() in quality.STOP_WORDS.split() for x in w)
    say = lambda bad, good: -1 if bad else 1 if good else 0
    return n, repeat, (
        say(symbols > 0.1 * n, symbols == 0), say(chars < 3 * n or chars > 10 * n, 3.5 * n <= chars <= 8 * n), say(dup > 0.3 * len(lines), dup == 0),
        say(repeat > 0.3 * n, repeat <= 0.1 * n), say(upper > 0.3 * chars, upper <= 0.1 * chars), say(ended < 0.5 * len(lines), ended >= 0.9 * len(lines)),
        say(False, stop >= 0.05 * n), say(len(set(w)) < 0.3 * n, len(set(w)) >= 0.5 * n), say(shouts > 0.3 * n, False),
    )


def test_kept_as_by_plain_loops(make):
    """Votes from the texts, expectation-maximisation in arrays over documents instead of patterns."""
    docs = rows() + [(400 + i, " ".join(words(70, i)) + (" !! " * (i % 3)), "a") for i in range(20)] + [(500, "few words", "a"), (501, "", "a")]
    found = {d: votes_by_hand(t) for d, t, _ in docs}
    v = np.array([x for n, _, x in found.values() if n])
    prior = np.array(quality.PRIOR)
    share, p, weight = quality.GOOD_SHARE, np.repeat(prior[:, None, :], len(RULES), 1), max(1.0, quality.PRIOR_WEIGHT * len(v))
    likely = lambda v: np.log(share / (1 - share)) + sum(np.log(p[1, j, v[:, j] + 1] / p[0, j, v[:, j] + 1]) for j in range(len(RULES)))
    for _ in range(quality.ROUNDS):
        q = 1 / (1 + np.exp(-likely(v)))
        share = (q.sum() + weight * quality.GOOD_SHARE) / (len(v) + weight)
        counts = np.array([[[(own * (v[:, j] == k - 1)).sum() + weight * prior[y, k] for k in range(3)] for j in range(len(RULES))] for y, own in ((0, 1 - q), (1, q))])
        p = counts / counts.sum(2, keepdims=True)
        for row in p[1]:
            if row[0] > quality.MOST_WRONG:
                row[1:] *= (1 - quality.MOST_WRONG) / row[1:].sum()
                row[0] = quality.MOST_WRONG
    for r in judge(make(docs), ["doc_id"]).collect():
        n, repeat, votes = found[r["doc_id"]]
        failed = n < 50 or 100 * repeat > 50 * n
        assert tuple(r[f"vote_{name}"] for name, _, _ in RULES) == votes or not n
        assert r["base_failed"] == failed and r["kept"] == (not failed and bool(likely(np.array([votes]))[0] >= 0)), r["doc_id"]


def test_a_text_of_many_words_with_colliding_hashes_takes_seconds(make, monkeypatch):
    monkeypatch.setattr(quality, "_MOST_WINDOWS", 1)  # the way that collisions take
    text = " ".join(words(200_000, 1))
    began = time.time()
    r = measure(make([(1, text, "a")]), ["doc_id"]).first()
    assert tuple(r[c] for c in COUNTS) == brute(text) and time.time() - began < 60


def test_one_broken_rule_is_outvoted():
    keep, junk = (1,) * len(RULES), (-1, 1, 1, -1, -1, -1, -1, -1, 0)
    one = (1, 1, 1, 1, 1, -1, 1, 1, 0)
    prior, p = fit([(keep[:-1] + (0,), 900), (junk, 90), (one, 10)])
    odds = lambda votes: prior + sum(p[1][j][v + 1] - p[0][j][v + 1] for j, v in enumerate(votes))
    assert odds(one) > 0 > odds(junk)


def test_awkward_documents(awkward, empty):
    got = judge(awkward, ["doc_id", "n", "kept"][:2]).collect()
    assert len(got) == awkward.count() and all(r["base_failed"] for r in got if r["n_words"] < 50)
    assert judge(empty, ["doc_id"]).count() == 0
