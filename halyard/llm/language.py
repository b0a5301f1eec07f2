"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a text in both directions and gives every position a distribution over
languages; a document's is the geometric mean of its positions', so whole texts count. Long texts are
read in windows that overlap: a position's states have read at least CONTEXT bytes on either side, or up
to the end of the text, wherever words or windows end, so texts of any length take bounded memory and
many windows are read at once. Texts are taken as if between spaces, and with A-Z lower-cased.

Gates and candidates use x / (1 + |x|) in place of the sigmoid and the hyperbolic tangent, and the reset
gate acts on the recurrent product, so a step is one product of matrices and plain arithmetic. Training
is backpropagation through time in numpy, on the driver, on windows of a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halyard.llm.common import crc_of_id, small_batches, stored, table

#: Training sample: rows of a language, rows of all languages (one of each language at least), windows of a row, their bytes.
DOCS, SAMPLE, PIECES, PIECE = 300, 20_000, 8, 64
HIDDEN, EMBED, STEPS, BATCH, RATE = 16, 12, 250, 192, 0.02
#: Positions that a window labels at most, bytes read beside them on either side, and the steps that window sizes are rounded to.
WINDOW, CONTEXT, GRAIN = 448, 32, 32
#: Windows read at once, for few languages; bytes of texts gathered before they are read.
AT_ONCE, GATHERED = 2048, 8 << 20


def _soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


class ByteGru:
    """Two gated recurrent units, one for each direction, over byte embeddings, and a softmax."""

    def __init__(self, languages: int, hidden: int = HIDDEN, embed: int = EMBED, seed: int = 5):
        rng = np.random.default_rng(seed)
        small = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.h = hidden
        self.p = {"e": small(256, embed) * 4, "o": small(2 * hidden, languages), "ob": np.zeros(languages, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": small(embed, 3 * hidden), f"u{d}": small(hidden, 3 * hidden), f"b{d}": np.zeros(3 * hidden, np.float32)}

    def _steps(self, x: np.ndarray, d: str) -> Iterator[tuple]:
        """(t, state before, gate inputs, gates, candidate input, candidate, recurrent part, state) along the positions ``x`` (length, n)."""
        length, n = x.shape
        k, u = self.h, self.p[f"u{d}"]
        table = self.p["e"] @ self.p[f"w{d}"] + self.p[f"b{d}"]  # the input's part, for each byte
        h = np.zeros((n, k), table.dtype)
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            i, v = table[x[t]], h @ u
            a = i[:, : 2 * k] + v[:, : 2 * k]
            g = 0.5 + 0.5 * _soft(a)
            b = i[:, 2 * k :] + g[:, k:] * v[:, 2 * k :]
            c = _soft(b)
            after = c + g[:, :k] * (h - c)
            yield t, h, a, g, b, c, v[:, 2 * k :], after
            h = after

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        """(length, n, languages): the log distribution at each position of the windows ``x`` (n, length)."""
        x = np.ascontiguousarray(x.T)
        both = np.concatenate([np.stack([s[-1] for s in sorted(self._steps(x, d), key=lambda s: s[0])]) for d in "fb"], 2)
        s = both @ self.p["o"] + self.p["ob"]
        s -= s.max(2, keepdims=True)
        return s - np.log(np.exp(s).sum(2, keepdims=True))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy of all positions of the windows ``x`` (n, length), by backpropagation through time."""
        x = np.ascontiguousarray(x.T)
        kept = {d: list(self._steps(x, d)) for d in "fb"}
        both = np.concatenate([np.stack([s[-1] for s in sorted(kept[d], key=lambda s: s[0])]) for d in "fb"], 2)
        s = both @ self.p["o"] + self.p["ob"]
        s = np.exp(s - s.max(2, keepdims=True))
        s /= s.sum(2, keepdims=True)
        s[:, np.arange(len(y)), y] -= 1
        s /= s.shape[0] * s.shape[1]
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["o"], g["ob"] = np.tensordot(both, s, ((0, 1), (0, 1))), s.sum((0, 1))
        back, k = s @ self.p["o"].T, self.h
        for j, d in enumerate("fb"):
            u, dh = self.p[f"u{d}"], np.zeros((len(y), k), s.dtype)
            inputs, read = [], []
            for t, h, a, gates, b, c, v, _ in reversed(kept[d]):
                dh = dh + back[t][:, j * k : (j + 1) * k]
                z, r = gates[:, :k], gates[:, k:]
                db = dh * (1 - z) / (1 + np.abs(b)) ** 2
                da = np.concatenate([dh * (h - c), db * v], 1) * 0.5 / (1 + np.abs(a)) ** 2
                du = np.concatenate([da, db * r], 1)
                g[f"u{d}"] += h.T @ du
                inputs.append(np.concatenate([da, db], 1))
                read.append(x[t])
                dh = dh * z + du @ u.T
            every = np.concatenate(read)
            order = np.argsort(every, kind="stable")
            first = np.flatnonzero(np.diff(every[order], prepend=-1))
            by_byte = np.zeros((256, 3 * k), s.dtype)  # of the table of inputs
            by_byte[every[order][first]] = np.add.reduceat(np.concatenate(inputs)[order], first)
            g[f"b{d}"] += by_byte.sum(0)
            g[f"w{d}"] += self.p["e"].T @ by_byte
            g["e"] += by_byte @ self.p[f"w{d}"].T
        return g

    def pooled(self, x: np.ndarray, labelled: np.ndarray) -> np.ndarray:
        """Sums of log distributions over the positions CONTEXT, ..., CONTEXT + labelled - 1 of each window of ``x`` (n, length)."""
        x = np.ascontiguousarray(x.T, np.intp)
        length, n = x.shape
        k, o = self.h, self.p["o"]
        logits = np.empty((length - 2 * CONTEXT, n, o.shape[1]), np.float32)
        i, v, a, c = (np.empty((n, m * k), np.float32) for m in (3, 3, 2, 1))
        total = np.zeros((n, o.shape[1]))
        for j, d in enumerate("fb"):
            table, u, own = self.p["e"] @ self.p[f"w{d}"] + self.p[f"b{d}"], self.p[f"u{d}"], o[j * k : (j + 1) * k]
            h = np.zeros((n, k), np.float32)
            # behind the labelled positions there is nothing left to label
            for t in range(length - CONTEXT) if d == "f" else range(length - 1, CONTEXT - 1, -1):
                np.take(table, x[t], axis=0, out=i, mode="clip")
                np.matmul(h, u, out=v)
                np.add(i[:, : 2 * k], v[:, : 2 * k], out=a)
                g = np.abs(a)
                g += 1
                np.divide(a, g, out=a)
                a *= 0.5
                a += 0.5
                np.multiply(a[:, k:], v[:, 2 * k :], out=c)
                c += i[:, 2 * k :]
                c /= 1 + np.abs(c)
                h -= c
                h *= a[:, :k]
                h += c
                at = t - CONTEXT
                if not 0 <= at < len(logits):
                    continue
                if d == "f":
                    np.matmul(h, own, out=logits[at])
                    continue
                s = logits[at] + h @ own + self.p["ob"]
                s -= s.max(1, keepdims=True)
                s -= np.log(np.exp(s).sum(1, keepdims=True))
                total += s * (at < labelled)[:, None]
        return total


def pieces(text: bytes, key: int) -> list[bytes]:
    """PIECES stretches of PIECE bytes of a text at places that ``key`` decides, all of a short one."""
    text = text.ljust(PIECE)
    rng, last = np.random.default_rng(key & ((1 << 63) - 1)), len(text) - PIECE
    starts = sorted(set(rng.integers(0, last + 1, PIECES).tolist())) if last else [0]
    return [text[s : s + PIECE] for s in starts]


def train(windows: list[tuple[bytes, int]], languages: int, steps: int = STEPS, seed: int = 5) -> ByteGru:
    """A network trained on (window of PIECE bytes, language number); each language weighs the same."""
    net, rng = ByteGru(languages, seed=seed), np.random.default_rng(seed)
    if not windows:
        return net
    x = np.frombuffer(b"".join(w for w, _ in windows), np.uint8).reshape(len(windows), PIECE).astype(np.intp)
    y = np.array([n for _, n in windows])
    share = 1 / np.bincount(y, minlength=languages)[y]
    weight = np.cumsum(share) / share.sum()
    m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        at = np.minimum(np.searchsorted(weight, rng.random(BATCH)), len(y) - 1)
        for k, g in net.gradients(x[at], y[at]).items():
            a, b = m[k]
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            rate = RATE * (1 - step / (steps + 1))
            net.p[k] -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def label(net: ByteGru, texts: list[bytes]) -> np.ndarray:
    """For each text the mean over its positions of the log distribution that the network gives them."""
    languages = net.p["o"].shape[1]
    total = np.zeros((len(texts), languages))
    cut: dict[int, list[tuple[int, int, int]]] = {}  # by positions, rounded up: (text, start, positions)
    for i, text in enumerate(texts):
        for s in range(0, len(text), WINDOW):
            n = min(WINDOW, len(text) - s)
            cut.setdefault(-(-n // GRAIN) * GRAIN, []).append((i, s, n))
    most = max(64, AT_ONCE * 8 // (8 + languages))
    space = b" " * CONTEXT
    for n, places in cut.items():
        for k in range(0, len(places), most):
            some = places[k : k + most]
            rows = b"".join((space[: max(0, CONTEXT - s)] + texts[i][max(0, s - CONTEXT) : s + n + CONTEXT]).ljust(n + 2 * CONTEXT) for i, s, _ in some)
            x = np.frombuffer(rows, np.uint8).reshape(len(some), -1)
            np.add.at(total, [i for i, _, _ in some], net.pooled(x, np.array([v for _, _, v in some])))
    return total / np.maximum([len(t) for t in texts], 1)[:, None]


def _sample(labelled: DataFrame, per_language: int, sample: int) -> list[tuple[str, bytes]]:
    """(language, window) of at most ``per_language`` rows of each language and ``sample`` rows in all, by lowest hash of id and text.

    Hashes are first cut at a share of their range that leaves a few times the rows wanted, so no task
    ranks a language. Equal rows count once.
    """
    known = labelled.select("lang", "h").distinct()
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    counts = stored(counts)
    per = max(1, min(per_language, sample // max(counts.count(), 1)))
    low = F.col("h").bitwiseAND(F.lit((1 << 63) - 1)) <= F.least(F.lit(1.0), F.lit(8.0 * per) / F.col("n")) * float(1 << 63)
    order = Window.partitionBy("lang").orderBy("h")
    few = known.join(counts, "lang").where(low).withColumn("place", F.row_number().over(order)).where(F.col("place") <= per)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(lang, h, p) for lang, h, text in zip(*(c.to_pylist() for c in batch.columns)) for p in pieces(text.encode("utf-8", "surrogatepass").lower(), h)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary()))], ["lang", "h", "piece"])

    # at most ``sample`` rows, or one of each language
    chosen = labelled.join(F.broadcast(few.select("lang", "h")), ["lang", "h"])
    found = chosen.select("lang", "h", "text").mapInArrow(cut, "lang string, h long, piece binary").distinct()
    return [(r["lang"], bytes(r["piece"])) for r in found.orderBy("lang", "h", "piece").collect()]


def identify(docs: DataFrame, held_out: int = 1, folds: int = 3, per_language: int = DOCS, sample: int = SAMPLE, steps: int = STEPS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs``.

    Learns from at most ``per_language`` rows of each language, those of the lowest hashes of id and text, and
    from at most ``sample`` rows in all, but one of each language at least; of those with text and language
    whose crc32 of the id modulo ``folds`` is not ``held_out``. From each, PIECES stretches of PIECE bytes at
    random places of the whole text are learned. Predictions read the text alone, all of it; of
    languages that are equally likely the first by name is taken. Texts that are null or have no letter, and
    all texts if nothing could be learned, are ``und`` with score 0. Null ids (crc32 of the empty text) and
    repeated rows are learned and predicted like others, equal rows learned once; an empty table gives no
    rows; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", (crc_of_id(F.col("doc_id")) % folds == held_out).alias("held_out"))
    labelled = base.where("not held_out and lang is not null and text is not null").withColumn("h", F.xxhash64("doc_id", "text"))
    windows = _sample(labelled, per_language, sample)
    names = sorted({lang for lang, _ in windows})
    net = spark.sparkContext.broadcast(train([(w, names.index(lang)) for lang, w in windows], max(len(names), 1), steps))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, texts, size = [], [], [], 0

        def answer() -> pa.RecordBatch:
            given = [i for i, t in enumerate(texts) if t is not None]
            mean = label(net.value, [texts[i] for i in given])
            p = np.exp(mean - mean.max(1, keepdims=True))
            name, score = ["und"] * len(texts), [0.0] * len(texts)
            for i, best, own in zip(given, p.argmax(1).tolist(), (p.max(1) / p.sum(1)).tolist()):
                name[i], score[i] = names[best], own
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(name, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

        for batch in batches:
            for id_, text, out in zip(*(c.to_pylist() for c in batch.columns)):
                known = names and text and any(map(str.isalpha, text))
                ids.append(id_)
                held.append(out)
                texts.append(text.encode("utf-8", "surrogatepass").lower() if known else None)
                size += len(texts[-1] or b"") + 100
                if size >= GATHERED:
                    yield answer()
                    ids, held, texts, size = [], [], [], 0
        if ids:
            yield answer()

    return base.select("doc_id", "text", "held_out").mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
