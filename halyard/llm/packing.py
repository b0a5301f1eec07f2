"""Packing documents into fixed-size training sequences, online and in bounded space.

Every partition keeps a fixed number of open windows. An arriving piece goes to the window it fills
best. If none has room, the fullest window is emitted, its gap first filled with the head of the
piece when the gap is worth a cut. The windows still open at the end of a partition are merged, by
the same rule, in rounds of a fixed number of partitions, until one partition is left. No round
holds more than ``fan_in * open_windows`` windows, whatever the size of the corpus.
"""

from __future__ import annotations

import json
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm.common import small_batches, stored, table

#: Words kept in a worker's memory of token ids, beyond which it starts afresh, and their longest: together a bound in bytes.
MEMORY, LONGEST = 500_000, 48
#: The normalization and the word pattern that words are parted by here.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_OPEN = f"{PIECE}, part long, ids binary"


class WordEncoder:
    """Token ids of texts, word by word: a space or line end always parts tokens in this kind of vocabulary.

    Plain Latin words go to the library's model directly, with its normalization and word pattern
    applied here; all others through its whole pipeline. Texts go there whole if the file's normalization
    or pattern is another.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        parts = json.loads(self.tokenizer.to_str())
        steps = (parts["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        self.by_word = parts["normalizer"] == NORMALIZER and len(steps) == 2 and steps[0].get("pattern") == {"Regex": PATTERN} and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"]
        self.pattern = regex.compile(PATTERN)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.known: dict[str, bytes] = {"": b""}
        self.word_end = {c: self.whole(c) for c in ".,;:"}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        import unicodedata

        if word.isascii() and word.isalpha():
            low = word.lower()
            if low != word:
                return self.known.get(low) or self.word(low)
            ids = [t.id for t in self.model.tokenize(word)]
        elif word[-1] in ".,;:" and word[:-1].isalpha() and word[:-1].isascii():
            return (self.known.get(word[:-1]) or self.word(word[:-1])) + self.word_end[word[-1]]
        elif max(word) < "ɐ" and word.isprintable() and "<|" not in word:
            ids = [t.id for part in self.pattern.findall(unicodedata.normalize("NFC", word).lower()) for t in self.model.tokenize(part.encode().decode("latin1").translate(self.letters))]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return array("I", ids).tobytes() if LITTLE else np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        if not self.by_word:
            return self.whole(text)
        words, known = text.replace("\n", " ").split(" "), self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > MEMORY:
                known.clear()
                known[""] = b""
            long: dict[str, bytes] = {}  # of this text alone
            for w in words:
                if w not in known and w not in long:
                    (known if len(w) <= LONGEST else long)[w] = self.word(w)
            return b"".join(long[w] if len(w) > LONGEST else known[w] for w in words) if long else b"".join(map(known.__getitem__, words))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Packer:
    """The open windows of one partition. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, size: int, windows: int, least_cut: int):
        self.size, self.windows, self.least_cut = size, windows, least_cut
        self.open: list[tuple[int, int]] = []  # (room, window), sorted
        self.pieces: dict[int, list[tuple]] = {}
        self.made = 0

    def put(self, piece: tuple) -> Iterator[list[tuple]]:
        """Places a piece; yields the windows that this completes, each a list of pieces."""
        doc, start, ids, total = piece
        at, end = 0, len(ids) // 4  # of what is left

        def part(n: int) -> tuple:
            return doc, start + at, ids[4 * at : 4 * (at + n)], total

        while end - at >= self.size:
            yield [part(self.size)]
            at += self.size
        while at < end:
            n = end - at
            fits = bisect_left(self.open, (n, -1))
            if fits < len(self.open):  # the least room that is enough
                room, w = self.open.pop(fits)
                self.pieces[w].append(part(n))
                if room == n:
                    yield self.pieces.pop(w)
                else:
                    insort(self.open, (room - n, w))
                return
            if len(self.open) < self.windows:
                self.pieces[self.made] = []
                insort(self.open, (self.size, self.made))
                self.made += 1
                continue
            room, w = self.open.pop(0)  # the fullest
            done = self.pieces.pop(w)
            if room >= self.least_cut:
                done.append(part(room))
                at += room
            yield done

    def leftovers(self) -> list[list[tuple]]:
        return [self.pieces[w] for _, w in self.open]


class _Rows:
    """Pieces gathered as columns."""

    def __init__(self):
        self.columns: list[list] = [[] for _ in range(9)]

    def window(self, pieces: list[tuple], sequence: int | None, part: int) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            for column, x in zip(self.columns, (doc, start, n, zlib.crc32(ids), total, sequence, None if sequence is None else offset, part, ids if sequence is None else None)):
                column.append(x)
            offset += n

    def batch(self) -> pa.RecordBatch:
        types = [pa.int64()] * 8 + [pa.binary()]
        found = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(self.columns, types)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "ids"])
        self.columns = [[] for _ in range(9)]
        return found


def _pack(pieces: Iterator[tuple], part: int, round_: int, size: int, windows: int, least_cut: int, last: bool) -> Iterator[pa.RecordBatch]:
    packer, rows, n = Packer(size, windows, least_cut), _Rows(), 0
    number = lambda k: (round_ << 58) | (part << 34) | k  # noqa: E731  rounds, partitions and windows below 2**5, 2**24, 2**34
    for piece in pieces:
        for window in packer.put(piece):
            rows.window(window, number(n), part)
            n += 1
        if len(rows.columns[0]) >= 10_000:
            yield rows.batch()
    for window in packer.leftovers():
        rows.window(window, number(n) if last else None, part)
        n += 1
    yield rows.batch()


def pack_documents(docs: DataFrame, size: int = 2048, open_windows: int = 16, least_cut: int = 16, fan_in: int = 64, path: str | None = None, end_id: int = 1) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    The pieces of a sequence have offsets without gaps from 0 and sum to at most ``size``. A null or
    empty text is the end token alone. Null ids and repeated rows are packed like others (a repeated
    row's pieces repeat); an empty table gives no rows; other columns are not read.

    Pieces go to the shared folder once after each round, so later rounds read them and never
    tokenize again. Only pieces in open windows carry their ids between rounds.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = encoder(path or default_path()).encode, np.array([end_id], "<u4").tobytes()

        def pieces():
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ids = (encode(text) if text else b"") + end
                    yield doc, 0, ids, len(ids) // 4

        yield from _pack(pieces(), TaskContext.get().partitionId(), 0, size, open_windows, least_cut, False)

    def merger(round_: int, last: bool):
        def merge(left: pa.Table) -> pa.Table:
            group = left.column("part")[0].as_py() // fan_in
            order = left.sort_by([("length", "descending"), ("part", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
            pieces = zip(*(order.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")))
            return pa.Table.from_batches(_pack(pieces, group, round_, size, open_windows, least_cut, last))

        return merge

    small_batches(docs.sparkSession)
    rounds = [stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(first, _OPEN))]
    parts = (rounds[0].agg(F.max("part")).first()[0] or 0) + 1  # one number
    while True:
        last = parts <= fan_in
        left = rounds[-1].where("sequence_id is null")
        found = left.groupBy(F.floor(F.col("part") / fan_in)).applyInArrow(merger(len(rounds), last), _OPEN)
        rounds.append(found if last else stored(found))
        if last:
            break
        parts = -(-parts // fan_in)
    out = rounds[0].where("sequence_id is not null")
    for df in rounds[1:]:
        out = out.unionByName(df.where("sequence_id is not null"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
