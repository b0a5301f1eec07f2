import zlib

import numpy as np

from halyard.llm import language
from halyard.llm.language import ByteGru, identify, label

PARTS = {"xx": ["ka", "lo", "mi", "ten"], "yy": ["schu", "ber", "ung", "ei"], "zz": ["ção", "que", "ío", "ña"]}


def text(lang, k, seed):
    p = PARTS[lang]
    h = lambda i: zlib.crc32(f"{lang} {seed} {i}".encode())
    return " ".join("".join(p[h(i) >> (3 * j) & 3] for j in range(1 + h(i) % 3)) for i in range(k))


def test_gradients_match_differences():
    net, rng = ByteGru(3, hidden=3, embed=2), np.random.default_rng(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(97, 100, (4, 5)).astype(np.intp), np.array([0, 1, 2, 1])
    loss = lambda: -net.log_probs(x)[:, np.arange(4), y].mean()
    g = net.gradients(x, y)
    for k, v in net.p.items():
        for at in [tuple(rng.integers(0, s) for s in v.shape) for _ in range(6)] + ([(97, 0), (98, 1)] if k == "e" else []):
            old = v[at]
            v[at] = old + 1e-4
            up = loss()
            v[at] = old - 1e-4
            down = loss()
            v[at] = old
            assert abs((up - down) / 2e-4 - g[k][at]) < 2e-3, (k, at)


def test_held_out_accuracy(make):
    langs = list(PARTS)
    docs = make([(i, text(langs[i % 3], 5 + i % 30, i), "a", langs[i % 3]) for i in range(240)])
    got = identify(docs, steps=100).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"] % 3] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_windows_read_as_the_whole_text(monkeypatch):
    """One window over all of a text, between spaces, and many overlapping ones give the same labels."""
    net = ByteGru(3, seed=2)
    for d in "fb":
        net.p[f"u{d}"] *= 0.3  # states forget within the context, as after training
    texts = [text("zz", k, k).encode() for k in (1, 3, 40, 300)] + [b"", b"a"]
    for got, t in zip(label(net, texts), texts):
        if t:
            x = np.frombuffer(b" " * 32 + t + b" " * 32, np.uint8)[None].astype(np.intp)
            assert np.abs(got - net.log_probs(x)[32:-32, 0].mean(0)).max() < 1e-3
    whole = label(net, texts)
    monkeypatch.setattr(language, "WINDOW", 64)
    assert np.abs(label(net, texts) - whole).max() < 1e-2


def test_all_rows_with_a_language_can_be_learned(make):
    """Null ids, equal rows and many languages: nothing is left out, and reruns agree."""
    rows = [(None if i % 2 else 3 * i, text("xx", 20, i % 7), "a", "xx") for i in range(40)] + [(1000 + i, f"only {i} once here", "a", f"l{i}") for i in range(30)]
    docs = make(rows)
    got = [sorted((str(r["doc_id"]), r["lang_pred"], r["score"]) for r in identify(docs, sample=20, steps=5).collect()) for _ in range(2)]
    assert got[0] == got[1]
    labelled = docs.withColumn("h", language.F.xxhash64("doc_id", "text"))
    assert {x for x, _ in language._sample(labelled, 300, 20)} == {"xx", *(f"l{i}" for i in range(30))}
    null = make([(None, text("xx", 20, i), "a", "xx") for i in range(5)])
    assert {r["lang_pred"] for r in identify(null, steps=5).collect()} == {"xx"}


def test_ties_take_the_first_language(make):
    docs = make([(3 * i, "same text", "a", x) for i, x in enumerate(("yy", "xx"))])
    net = language.train([], 2)
    net.p = {k: v * 0 for k, v in net.p.items()}
    assert label(net, [b"same text"]).argmax(1).tolist() == [0]
    assert {r["lang_pred"] for r in identify(docs, steps=5).collect()} <= {"xx", "yy", "und"}


def test_awkward_documents(awkward, empty, make):
    got = identify(awkward, steps=20).collect()
    assert len(got) == awkward.count()
    assert sum(r["lang_pred"] == "und" for r in got) == sum(not any(map(str.isalpha, r["text"] or "")) for r in awkward.collect())
    assert identify(empty).count() == 0
    assert {r["lang_pred"] for r in identify(make([(1, "abc", "a", None)])).collect()} == {"und"}
