"""Language-model scores from a lattice of subwords.

The pieces of an existing vocabulary are a unigram model: their own scores are its first weights, and a few
rounds of expectation-maximisation over the words of the training documents, each as often as it stands
there, set their probabilities. A word's probability is the sum over all its segmentations into pieces, by
a forward recursion in log space, and a text's that of its words and one end, which is a piece of its own. Characters
outside the vocabulary are spelt in bytes, so every text has a positive probability, and all of them
together at most one. Nothing but the lattice is in the score: a word that training has seen is
known by its pieces alone.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm.common import crc_of_id, small_batches, stored, table

MARK = "▁"
#: Words with at least this share of all training tokens are broadcast: at most 1 / SHARE of them.
SHARE = 1e-6
ROUNDS, SMOOTH, LONGEST = 3, 0.1, 64
#: Words kept in a worker's memory, beyond which it starts afresh, and their longest in bytes; characters of words read at once.
MEMORY, KEPT, AT_ONCE = 700_000, 64, 1_000_000
_MIX, _SLOTS, _SHIFT, _LOW = np.uint64(0x9E3779B97F4A7C15), 1 << 20, 64 - 20, 18


class Lattice:
    """Segmentations of words into ``pieces``; ``logp`` has a log probability for each piece, and last the end's."""

    def __init__(self, pieces: list[str], bytes_: dict[int, int]):
        self.ids = {p: i for i, p in enumerate(pieces) if p and i not in set(bytes_.values())}
        self.bytes, self.n = bytes_, len(pieces)
        self.most = max(map(len, self.ids))
        # a slot says whether a string is a piece, and whether longer pieces begin with it
        longer = {p[:i] for p in self.ids for i in range(1, len(p))}
        left = [(self._hash(p), 2 * (self.ids.get(p, -1) + 1) + (p in longer)) for p in longer | set(self.ids)]
        self.tables: list[np.ndarray] = []
        while left:  # a slot holds one string; those that meet a taken slot go to the next table
            table, next_ = np.zeros(_SLOTS, np.uint64), []
            for h, x in left:
                slot = (h * int(_MIX) % (1 << 64)) >> _SHIFT
                if not table[slot]:
                    table[slot] = h >> _LOW << _LOW | x
                else:
                    next_.append((h, x))
            self.tables.append(table)
            left = next_

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * 0x100000001B3 + ord(c) + 1) % (1 << 64)
        return h

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece or -1, whether longer pieces begin so) for hashes of strings."""
        slot = (h * _MIX) >> np.uint64(_SHIFT)
        own = self.tables[0][slot]
        hit = (own ^ h) >> np.uint64(_LOW) == 0
        for table in self.tables[1:]:
            at = np.flatnonzero(~hit & (own > 0))  # the slot is another's
            if not len(at):
                break
            own[at] = table[slot[at]]
            hit[at] = (own[at] ^ h[at]) >> np.uint64(_LOW) == 0
        x = np.where(hit & (own > 0), own & np.uint64((1 << _LOW) - 1), 0).astype(np.int64)
        return (x >> 1) - 1, (x & 1).astype(bool)

    def spell(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")]

    def _edges(self, codes: np.ndarray, logp: np.ndarray) -> Iterator[tuple]:
        """(start, end, rows, log probabilities, piece ids or None where spelt) of each span with a piece."""
        n, length = codes.shape
        for s in range(length):
            live, h = np.arange(n), np.zeros(n, np.uint64)
            for e in range(s + 1, min(length, s + self.most) + 1):
                h = h * np.uint64(0x100000001B3) + codes[live, e - 1] + np.uint64(1)
                ids, longer = self.find(h)
                hit = ids >= 0
                if hit.any():
                    yield s, e, live[hit], logp[ids[hit]], ids[hit]
                if e == s + 1 and not hit.all():
                    rows = live[~hit]
                    chars, at = np.unique(codes[rows, s], return_inverse=True)
                    cost = np.array([logp[self.spell(chr(int(c)))].sum() for c in chars])
                    yield s, e, rows, cost[at.ravel()], None
                live, h = live[longer], h[longer]
                if not len(live):
                    break

    def _groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for length, at in by_length.items():
            if length <= LONGEST:
                for k in range(0, len(at), 8192):
                    part = at[k : k + 8192]
                    codes = np.frombuffer("".join(words[i] for i in part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, length)
                    yield np.array(part), codes.astype(np.uint64)
            else:
                for i in at:
                    yield np.array([i]), None

    def score(self, words: list[str], logp: np.ndarray) -> np.ndarray:
        """The natural log probability of each word, over all its segmentations."""
        out = np.empty(len(words))
        for at, codes in self._groups(words):
            if codes is None:
                out[at] = self._long(words[at[0]], logp, None)
                continue
            a = np.full((codes.shape[1] + 1, len(at)), -np.inf)
            a[0] = 0
            for s, e, rows, p, _ in self._edges(codes, logp):
                a[e, rows] = np.logaddexp(a[e, rows], a[s, rows] + p)
            out[at] = a[-1]
        return out

    def expect(self, words: list[str], weights: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in ``weights`` copies of the words."""
        total = np.zeros(self.n)
        for at, codes in self._groups(words):
            if codes is None:
                self._long(words[at[0]], logp, (total, weights[at[0]]))
                continue
            length, n = codes.shape[1], len(at)
            a, b = np.full((length + 1, n), -np.inf), np.full((length + 1, n), -np.inf)
            a[0] = b[-1] = 0
            edges = list(self._edges(codes, logp))
            for s, e, rows, p, _ in edges:
                a[e, rows] = np.logaddexp(a[e, rows], a[s, rows] + p)
            for s, e, rows, p, _ in reversed(edges):
                b[s, rows] = np.logaddexp(b[s, rows], b[e, rows] + p)
            w, pieces, uses = weights[at], [], []
            for s, e, rows, p, ids in edges:
                use = w[rows] * np.exp(a[s, rows] + p + b[e, rows] - a[-1, rows])
                if ids is not None:
                    pieces.append(ids)
                    uses.append(use)
                else:
                    for c, u in zip(codes[rows, s], use):
                        for i in self.spell(chr(int(c))):
                            total[i] += u
            if pieces:
                total += np.bincount(np.concatenate(pieces), np.concatenate(uses), self.n)
        return total

    def _long(self, word: str, logp: np.ndarray, gather: tuple | None) -> float:
        """As above for one word of any length, span by span."""
        n = len(word)
        edges: list[list[tuple[int, float, list[int]]]] = []
        for s in range(n):
            own = [(e, float(logp[i]), [i]) for e in range(s + 1, min(n, s + self.most) + 1) if (i := self.ids.get(word[s:e])) is not None]
            if not own or own[0][0] > s + 1:
                own.append((s + 1, float(logp[self.spell(word[s])].sum()), self.spell(word[s])))
            edges.append(own)
        a = [-math.inf] * (n + 1)
        a[0] = 0.0
        for s in range(n):
            for e, p, _ in edges[s]:
                a[e] = float(np.logaddexp(a[e], a[s] + p))
        if gather:
            total, weight = gather
            b = [-math.inf] * (n + 1)
            b[n] = 0.0
            for s in reversed(range(n)):
                for e, p, ids in edges[s]:
                    b[s] = float(np.logaddexp(b[s], b[e] + p))
            for s in range(n):
                for e, p, ids in edges[s]:
                    for i in ids:
                        total[i] += weight * math.exp(a[s] + p + b[e] - a[n])
        return a[n]


@lru_cache(maxsize=2)
def load(path: str) -> tuple[Lattice, np.ndarray]:
    """(lattice, first log probabilities) of a sentencepiece model's pieces, best scores first.

    Scores that are log probabilities, as a unigram model has them, are taken as they are. Those of a byte-pair
    model count merges from 0 down, and are taken as Zipf weights: 1 / (10 - score). Byte pieces and
    the end have the weight of the last piece.
    """
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    kept = sorted((i for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i))), key=lambda i: (not sp.is_byte(i), -sp.get_score(i)))
    pieces = [sp.id_to_piece(i) for i in kept]
    bytes_ = {int(sp.id_to_piece(i)[3:5], 16): k for k, i in enumerate(kept) if sp.is_byte(i)}
    scores = np.array([sp.get_score(i) for i in kept[len(bytes_) :]])
    first = scores if abs(np.exp(scores).sum() - 1) < 0.2 else -np.log(10.0 - scores)
    first = np.r_[np.full(len(bytes_), first.min()), first, first.min()]  # and the end
    return Lattice(pieces, bytes_), first - np.log(np.exp(first).sum())


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def words_of(text: bytes) -> list[bytes]:
    """Words of a text with A-Z lower-cased; bytes' own split and lower know ASCII only, as asked."""
    return text.lower().split()


def key_of(word: bytes) -> int:
    import xxhash

    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    counts, size = Counter(), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                words = words_of(text)
                counts.update(words)
                size += sum(len(w) for w in words if len(w) > KEPT)
            if len(counts) > MEMORY or size > MEMORY * KEPT:
                yield rows(counts)
                counts, size = Counter(), 0
    yield rows(counts)


def train(words: DataFrame, ends: int, path: str | None = None, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces and the end, from the words (word, n) of training and its number of texts.

    Each round sends one expected count for each piece and partition; the vocabulary bounds what meets.
    """
    lattice, logp = load(path or default_path())
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], logp=logp) -> Iterator[pa.RecordBatch]:
            lattice, _ = load(path or default_path())
            total, words, weights, size = np.zeros(lattice.n), [], [], 0
            for batch in batches:
                for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    words.append(MARK + w.decode("utf-8", "replace"))
                    weights.append(n)
                    size += len(w)
                    if size >= AT_ONCE:
                        total += lattice.expect(words, np.array(weights, float), logp)
                        words, weights, size = [], [], 0
            if words:
                total += lattice.expect(words, np.array(weights, float), logp)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["piece", "uses"])

        found = words.select("word", "n").mapInArrow(expect, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toPandas()
        uses = np.full(lattice.n + 1, SMOOTH)
        uses[found["piece"].to_numpy(int)] += found["uses"].to_numpy(float)
        uses[-1] += ends
        logp = np.log(uses / uses.sum())
    return logp


class _Scorer:
    """Words remembered with their scores: lattice log10 probability, log10(c + 1) if common, and whether it is."""

    def __init__(self, lattice: Lattice, logp: np.ndarray, keys: np.ndarray, counts: np.ndarray):
        self.lattice, self.logp, self.keys, self.counts = lattice, logp, keys, counts
        self.forget()

    def forget(self) -> None:
        self.memory: dict[bytes, int] = {}
        self.own, self.hashes, self.used = np.zeros((1024, 3)), np.zeros(1024, np.int64), 0

    def learn(self, texts: list[list[bytes]]) -> list[bytes]:
        """Remembers the words of ``texts``; returns those too long to keep for others."""
        memory = self.memory
        new = list({w for text in texts for w in text if w not in memory})
        if memory and self.used + len(new) > MEMORY:
            self.forget()
            memory, new = self.memory, list({w for text in texts for w in text})
        at, end = self.used, self.used + len(new)
        if end > len(self.own):
            more = end - at + end // 2
            self.own = np.concatenate([self.own[:at], np.zeros((more, 3))])
            self.hashes = np.concatenate([self.hashes[:at], np.zeros(more, np.int64)])
        if not new:
            return []
        fresh = self.own[at:end]
        fresh[:, 0] = self.lattice.score([MARK + w.decode("utf-8", "replace") for w in new], self.logp) / math.log(10)
        h = self.hashes[at:end] = np.fromiter(map(key_of, new), np.int64, len(new))
        fresh[:, 1:] = 0
        if len(self.keys):
            found = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[found] == h
            fresh[hit, 1], fresh[hit, 2] = np.log10(self.counts[found[hit]] + 1.0), 1
        memory.update(zip(new, range(at, end)))
        self.used = end
        return [w for w in new if len(w) > KEPT]

    def score(self, texts: list[list[bytes]], end_score: float) -> list[pa.Array]:
        """Columns n_tokens, known, base, score, and keys and times of the words that are not common."""
        long = self.learn(texts)
        out: list[list] = [[] for _ in range(6)]
        for text in texts:
            ids = np.fromiter(map(self.memory.__getitem__, text), np.int64, len(text))
            own = self.own[ids]
            sums = own.sum(0)
            rare, times = np.unique(self.hashes[ids[own[:, 2] == 0]], return_counts=True)
            for column, x in zip(out, (len(text) + 1, int(sums[2]), sums[1], sums[0] + end_score, rare, times)):
                column.append(x)
        for w in long:
            del self.memory[w]
        plain = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
        size = pa.array(np.r_[0, np.cumsum([len(x) for x in out[4]])], pa.int32())
        lists = [pa.ListArray.from_arrays(size, pa.array(np.concatenate(c).astype(t))) for c, t in zip(out[4:], (np.int64, np.int32))]
        return plain + lists


def in_parts(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    """Up to 256 texts, or as many as have AT_ONCE bytes."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if len(some) == 256 or size >= AT_ONCE:
            yield some
            some, size = [], 0
    if some:
        yield some


_kept: dict[str, _Scorer] = {}


def _scorer(run: str, make) -> _Scorer:
    """The scorer of this run that the worker made before, if it did."""
    if run not in _kept:
        _kept.clear()
        _kept[run] = make()
    return _kept[run]


def score_documents(docs: DataFrame, held_out: int = 2, folds: int = 7, share: float = SHARE, path: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``.

    Training documents are those whose crc32 of the id modulo ``folds`` is not ``held_out``. Null and
    empty texts are the end alone; a null id counts as an empty one; repeated rows are counted and
    scored as often as they stand there; an empty table gives no rows; other columns are not read. Words are
    met by 64-bit hashes; bytes that are not valid UTF-8 are scored as one replacement character.

    Counts of words that hold ``share`` of all training tokens are broadcast (at most 1 / share words);
    the counts of all others are joined to their documents by a shuffle.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), (crc_of_id(F.col("doc_id")) % folds == held_out).alias("held_out"))
    learned = base.where("not held_out")
    words = learned.select("text").mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array((key_of(w) for w in batch.column(0).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), keys], ["word", "n", "key"])

    words = stored(words.mapInArrow(keyed, "word binary, n long, key long"))
    ends = learned.count()
    tokens, types = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n, v = tokens + ends, types + (1 if ends else 0)
    logp = train(words, ends, path)
    end_score = float(logp[-1]) / math.log(10)
    logp = spark.sparkContext.broadcast(logp)
    least = max(1.0, share * n)
    common = words.where(F.col("n") >= least).select("key", "n").orderBy("key").toPandas()  # at most 1 / share
    common = spark.sparkContext.broadcast((common["key"].to_numpy("int64"), common["n"].to_numpy("int64")))

    run = uuid.uuid4().hex

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        scorer = _scorer(run, lambda: _Scorer(load(path or default_path())[0], logp.value, *common.value))
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            done = 0
            for texts in in_parts(batch.column(1).to_pylist()):
                part = batch.slice(done, len(texts))
                found = scorer.score([words_of(t) for t in texts], end_score)
                rows = pa.array(range(row, row + part.num_rows), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), rows, *found], ["doc_id", "held_out", "row", "n_tokens", "known", "base", "score", "keys", "times"])
                row += part.num_rows
                done += part.num_rows

    small_batches(spark)
    scored = base.select("doc_id", "text", "held_out").mapInArrow(score, "doc_id long, held_out boolean, row long, n_tokens long, known long, base double, score double, keys array<long>, times array<int>")
    scored = stored(scored)
    rare = scored.where("size(keys) > 0").select("row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row", F.col("x.keys").alias("key"), "x.times")
    met = rare.join(words.where(F.col("n") < least).select("key", "n"), "key")
    rest = met.groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"))
    df = scored.drop("keys", "times").join(rest, "row", "left")
    end_known = 1 if ends else 0
    known = F.col("known") + F.coalesce("more_known", F.lit(0)) + end_known
    total = F.col("base") + F.coalesce("more", F.lit(0.0)) + math.log10(ends + 1) - F.col("n_tokens") * math.log10(n + v + 1)
    return df.select("doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), total.alias("base_score"), "score")


def op5_subword_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
