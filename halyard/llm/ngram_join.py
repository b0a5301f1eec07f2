"""N-gram Jaccard self-join by T-occurrence search.

Two documents link when the sets of their word n-grams overlap enough. Equal sets are one class, and
classes are searched. A class is indexed by the first part of its n-grams in hash order, long enough
that linked classes share several of them (``tau``). As in DivideSkip, the inverted lists are divided:

* Short lists are merged, and the occurrences of a pair counted. A pair that shares at least ``tau`` keys, less
  the keys that both have in long lists, may link.
* Long lists make no pairs. Only classes that have at least ``tau`` of their keys in long lists can link by
  these alone; such classes are put together by the long lists that they share. A key that is frequent
  within a part of the input is known as long there, and its members never meet in a task.

What may link is split into connected blocks, and each block is searched by DivideSkip over whole sets:
the short lists of a query are merged by a heap, the long ones probed by binary search, and the classes that
reach the required overlap link. Within a block only links between different components are searched, each
large component having an index of its own, so a group of thousands of near copies costs no pairs. A
block whose sets are too large for one task is divided into tiles: each tile is searched once, and each pair of tiles
for links across. What is returned is components: links that join all that are linked, not all links.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import merge
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm.common import scratch, small_batches, stored, table
from halyard.llm.components import Forest, components

#: Longest inverted list whose pairs are counted; keys of one index task; keys that are dealt at once; n-grams of one tile.
SHORT, KEYS, DEALT, TILE = 32, 250_000, 1_000_000, 1_000_000
#: Members at which a component of a block gets an index of its own.
LARGE = 64
#: Words remembered, and the longest in bytes.
MEMORY, LONGEST = 400_000, 64
_P = [np.uint64(p) for p in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]
_CLASS = "doc_id long, th long, n long, c long"


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word n-grams; A-Z are lower-cased."""

    def __init__(self, n: int):
        self.n, self.memory = n, {}

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.n:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], np.uint64)
        memory = self.memory
        try:
            h = np.fromiter(map(memory.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(memory) > MEMORY:
                memory.clear()
            for w in words:
                if w not in memory and len(w) <= LONGEST:
                    memory[w] = xxhash.xxh64_intdigest(w)
            h = np.fromiter((memory[w] if len(w) <= LONGEST else xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
        m = len(h) - self.n + 1
        g = h[:m] * _P[0]
        for j in range(1, self.n):
            g ^= g >> np.uint64(29)
            g = g * _P[0] + h[j : j + m] * _P[1 + j % 4]
        g ^= g >> np.uint64(32)
        return np.unique(g * _P[1])


def class_of(s: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


def tau(n, percent: int = 85):
    """Keys that linked classes share at least in their indexed parts: a tenth of the set."""
    return np.maximum(1, n // 10)


def indexed(n: int, percent: int) -> int:
    """Length of the indexed part: what may be missing from an overlap, and tau more."""
    return int(n - -(-percent * n // 100) + tau(n))


def _index(percent: int):
    """Of one bucket of the key space: pairs counted in short lists, and the members of long ones.

    A key with a member of size -1 is known as long already.
    """

    def count_pairs(rows: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in rows.column("keys").to_pylist()])
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in rows.column("ids").to_pylist()])
        sizes = np.concatenate([np.frombuffer(x, np.int64) for x in rows.column("sizes").to_pylist()])
        runs = np.concatenate([np.frombuffer(x, np.int64) for x in rows.column("runs").to_pylist()])
        at = np.repeat(np.arange(len(ids)), runs)
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        length = np.diff(np.r_[first, len(keys)])
        known = np.logical_or.reduceat(sizes[at] < 0, first) if len(first) else np.zeros(0, bool)
        left, right = [], []
        for k in np.unique(length[(length > 1) & (length <= SHORT)]):
            own = at[first[(length == k) & ~known][:, None] + np.arange(k)]
            for i in range(k - 1):
                for j in range(i + 1, k):
                    left.append(own[:, i])
                    right.append(own[:, j])
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            a, b = np.minimum(a, b), np.maximum(a, b)
            small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
            fits = 100 * small >= percent * large
            pairs, count = np.unique(a[fits] * len(ids) + b[fits], return_counts=True)
            a, b = pairs // len(ids), pairs % len(ids)
        else:
            a = b = count = np.zeros(0, np.int64)
        long_ = np.flatnonzero((length > SHORT) | known)
        members = np.concatenate([at[first[i] : first[i] + length[i]] for i in long_]) if len(long_) else np.zeros(0, np.int64)
        hot = np.repeat(keys[first[long_]].view(np.int64), length[long_])
        true = sizes[members] >= 0
        members, hot = members[true], hot[true]
        none = pa.nulls
        return pa.table({
            "a": pa.chunked_array([pa.array(np.minimum(ids[a], ids[b])), pa.array(ids[members])]),
            "b": pa.chunked_array([pa.array(np.maximum(ids[a], ids[b])), none(len(members), pa.int64())]),
            "count": pa.chunked_array([pa.array(count.astype(np.int64)), none(len(members), pa.int64())]),
            "least": pa.chunked_array([pa.array(np.minimum(tau(sizes[a]), tau(sizes[b]))), pa.array(tau(sizes[members]))]),
            "hot": pa.chunked_array([none(len(a), pa.int64()), pa.array(hot)]),
        })

    return count_pairs


_PAIRS = "a long, b long, count long, least long, hot long"


class Lists:
    """Inverted lists over documents added in ascending size."""

    def __init__(self):
        self.lists: dict[int, list[int]] = {}
        self.members: list[int] = []

    def add(self, doc: int, keys: list[int]) -> None:
        self.members.append(doc)
        for k in keys:
            self.lists.setdefault(k, []).append(doc)

    def search(self, keys: list[int], size: int, sizes: np.ndarray, percent: int, skip) -> Iterator[int]:
        """Documents whose sets overlap enough with one of ``size``, among those that ``skip`` does not name.

        ``least`` is the smallest overlap that any partner can need. DivideSkip: the longest lists are
        set aside, as many as leave a threshold for the merged count; candidates are probed in them.
        """
        found = sorted((x for k in keys if (x := self.lists.get(k))), key=len)
        least = -(-percent * size // 100)
        if len(found) < least:
            return
        aside = min(least - 1, int(least / (0.0085 * np.log2(max(len(found[-1]), 2)) + 1)))
        short, long_ = found[: len(found) - aside], found[len(found) - aside :]
        smallest = -(-percent * size // 100)
        counted = ((sum(1 for _ in same), doc) for doc, same in groupby(merge(*short)))
        for count, doc in sorted(((n, doc) for n, doc in counted if n >= least - aside and sizes[doc] >= smallest), key=lambda x: -x[0]):
            if skip(doc):
                continue
            need = -(-percent * (size + int(sizes[doc])) // (100 + percent))
            left = len(long_)
            for x in long_:
                if count >= need or count + left < need:
                    break
                i = bisect_left(x, doc)
                count += i < len(x) and x[i] == doc
                left -= 1
            if count >= need:
                yield doc


def link(sets: list[np.ndarray], percent: int = 85, side: list[bool] | None = None) -> list[tuple[int, int]]:
    """Links between the numbers of ``sets`` that join all that are linked, one less than each component has.

    With ``side``, only sets of different sides are compared.
    """
    if side is not None:
        return _across(sets, percent, side)
    n = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), n)
    _, key, uses = np.unique(every, return_inverse=True, return_counts=True)
    shared = uses[key] > 1  # other keys are in no list but their own
    key, owner = key[shared], owner[shared]
    start = np.searchsorted(owner, np.arange(len(sets) + 1))
    order = sorted(range(len(sets)), key=lambda i: (n[i], sets[i][0] if n[i] else 0))
    forest, links, recent = Forest(), [], []
    rest, large, count = Lists(), {}, {}
    own: dict[int, list[int]] = {}

    def join(i: int, j: int) -> None:
        a, b = forest.find(i), forest.find(j)
        if not forest.join(a, b):
            return
        links.append((i, j))
        root, gone = min(a, b), max(a, b)
        count[root] = count.get(root, 1) + count.pop(gone, 1)
        big = [large.pop(x) for x in (a, b) if x in large]
        if big:
            keep, *other = sorted(big, key=lambda x: -len(x.members))
            for x in other:  # the smaller list of members moves; they stay in order of size
                merge(keep, x)
            large[root] = keep

    def merge(keep: Lists, other: Lists) -> None:
        place = {d: k for k, d in enumerate(order)}
        for k, x in other.lists.items():
            y = keep.lists.setdefault(k, [])
            y.extend(x)
            y.sort()
        keep.members += other.members
        keep.members.sort(key=place.get)

    number = {d: k for k, d in enumerate(order)}  # documents are named by their place in the order
    sizes = n[order]
    for i in order:
        if not n[i]:
            continue
        keys = key[start[i] : start[i + 1]].tolist()
        name = number[i]
        for j in recent[-3:]:
            both = len(np.intersect1d(sets[i], sets[order[j]], assume_unique=True))
            if (100 + percent) * both >= percent * (n[i] + sizes[j]):
                join(name, j)
                break
        for root in list(large):
            if root in large and forest.find(name) != forest.find(root):
                hit = next(large[root].search(keys, int(n[i]), sizes, percent, lambda d: False), None)
                if hit is not None:
                    join(name, hit)
        for hit in rest.search(keys, int(n[i]), sizes, percent, lambda d: forest.find(d) == forest.find(name)):
            join(name, hit)
        root = forest.find(name)
        if root in large:
            large[root].add(name, keys)
        else:
            rest.add(name, keys)
            own[name] = keys
            if count.get(root, 1) > LARGE:
                large[root] = Lists()
                kept = Lists()
                for d in rest.members:
                    (large[root] if forest.find(d) == root else kept).add(d, own[d])
                rest = kept
        recent.append(name)
    return [(order[a], order[b]) for a, b in links]


def _across(sets: list[np.ndarray], percent: int, side: list[bool]) -> list[tuple[int, int]]:
    """Links between sets of different sides that join all that are linked so. Each side is indexed, and searched for the other."""
    n = np.array([len(s) for s in sets])
    order = sorted(range(len(sets)), key=lambda i: (n[i], sets[i][0] if n[i] else 0))
    sizes, forest, links = n[order], Forest(), []
    lists = {False: Lists(), True: Lists()}
    for name, i in enumerate(order):  # documents are named by their place in the order
        if not n[i]:
            continue
        keys = sets[i].tolist()
        for hit in lists[not side[i]].search(keys, int(n[i]), sizes, percent, lambda d: forest.find(d) == forest.find(name)):
            if forest.join(name, hit):
                links.append((i, order[hit]))
        lists[side[i]].add(name, keys)
    return links


def _search(n: int, percent: int):
    def search(rows: pa.Table) -> pa.Table:
        shingle = Shingler(n)
        sets, side = {}, {}
        for c, tile, text in zip(*(rows.column(x).to_pylist() for x in ("c", "tile", "text"))):
            if c not in sets:
                sets[c], side[c] = shingle(text), tile == rows.column("low")[0].as_py()
        ids = list(sets)
        apart = rows.column("low")[0].as_py() != rows.column("high")[0].as_py()
        links = link([sets[c] for c in ids], percent, [side[c] for c in ids] if apart else None) if len(ids) > 1 else []
        return pa.table({"a": pa.array([ids[i] for i, _ in links], pa.int64()), "b": pa.array([ids[j] for _, j in links], pa.int64())})

    return search


def linked_classes(docs: DataFrame, n: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """((doc_id, th, n, c) of each row, (a, b) links that join all linked classes)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for batch in batches:
            found = [shingle(t) for t in batch.column(2).to_pylist()]
            keys = [s[: indexed(len(s), percent)].tobytes() for s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, found), pa.int64()), pa.array((class_of(s) if len(s) else None for s in found), pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "th", "n", "c", "keys"])

    small_batches(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
        rows = stored(rows.mapInArrow(sets, f"{_CLASS}, keys binary"))
        members = keep(stored(rows.select("doc_id", "th", "n", "c")))
        one = F.struct(F.col("doc_id").isNull(), "doc_id", "th")
        known = members.where("c is not null")
        chosen = stored(known.groupBy("c").agg(F.min(one).alias("one"), F.first("n").alias("n")).select("c", "one.doc_id", "one.th", "n"))
        total = rows.agg(F.sum(F.octet_length("keys") / 8)).first()[0] or 0  # one number
        buckets = int(total // KEYS) + 1

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Keys with their classes by bucket; those of more than SHORT classes here without one, their buckets being told."""
            names = ["bucket", "keys", "ids", "sizes", "runs"]

            def rows(every: np.ndarray, owner: np.ndarray, c: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
                order = np.argsort(every, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(every[order]) != 0])
                often = np.diff(np.r_[first, len(every)])
                frequent = np.empty(len(every), bool)
                frequent[order] = np.repeat(often > SHORT, often)
                marks = every[order][first[often > SHORT]]
                out: tuple[list, ...] = ([], [], [], [], [])

                def put(bucket: int | None, keys: np.ndarray, who: np.ndarray, sizes: np.ndarray, runs: np.ndarray) -> None:
                    for column, x in zip(out, (bucket, keys.tobytes(), who.tobytes(), sizes.tobytes(), runs.astype(np.int64).tobytes())):
                        column.append(x)

                if len(marks):
                    put(None, every[frequent], c[owner[frequent]], size[owner[frequent]], np.zeros(0))
                every, owner = np.r_[every[~frequent], marks], np.r_[owner[~frequent], np.full(len(marks), len(c))]
                c, size = np.r_[c, 0], np.r_[size, -1]
                bucket = (every % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((owner, bucket))
                every, owner, bucket = every[order], owner[order], bucket[order]
                cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
                for s, e in zip(cut, [*cut[1:], len(bucket)]):
                    who, runs = np.unique(owner[s:e], return_counts=True)
                    put(int(bucket[s]), every[s:e], c[who], size[who], runs)
                return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(x, pa.binary()) for x in out[1:])], names)

            gathered, total = [], 0
            for batch in batches:
                for c, size, keys in zip(*(x.to_pylist() for x in batch.columns)):
                    gathered.append((c, size, np.frombuffer(keys, np.uint64)))
                    total += len(gathered[-1][2])
                    if total >= DEALT:
                        yield rows(np.concatenate([g[2] for g in gathered]), np.repeat(np.arange(len(gathered)), [len(g[2]) for g in gathered]), *(np.array([g[i] for g in gathered], np.int64) for i in (0, 1)))
                        gathered, total = [], 0
            if total:
                yield rows(np.concatenate([g[2] for g in gathered]), np.repeat(np.arange(len(gathered)), [len(g[2]) for g in gathered]), *(np.array([g[i] for g in gathered], np.int64) for i in (0, 1)))

        def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, ids, sizes = (np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for x in batch.column(k).to_pylist())]) for k in (1, 2, 3))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.int64()), pa.array(tau(sizes)), pa.array(keys)], ["a", "b", "count", "least", "hot"])

        # one row of each class is indexed
        first = F.col("doc_id").eqNullSafe(F.col("one_id")) & (F.col("th") == F.col("one_th"))
        index = rows.where("c is not null").join(chosen.select("c", F.col("doc_id").alias("one_id"), F.col("th").alias("one_th")), "c").where(first).dropDuplicates(["c"])
        dealt = stored(index.select("c", "n", "keys").mapInArrow(deal, "bucket long, keys binary, ids binary, sizes binary, runs binary"))
        met = stored(dealt.where("bucket is not null").groupBy("bucket").applyInArrow(_index(percent), _PAIRS))
        met = met.union(dealt.where("bucket is null").mapInArrow(frequent, _PAIRS))
        pairs = met.where("hot is null").groupBy("a", "b").agg(F.sum("count").alias("count"), F.first("least").alias("least"))
        pairs = stored(pairs)
        held = met.where("hot is not null").groupBy("a").agg(F.count("*").alias("long"), F.first("least").alias("least"))
        held = stored(held)
        other = held.select(F.col("a").alias("b"), F.col("long").alias("long_b"))
        unsure = pairs.where("count < least").join(held.select("a", "long"), "a").join(other, "b").where(F.col("count") >= F.col("least") - F.least("long", "long_b"))
        full = stored(met.where("hot is not null").join(held.where("long >= least").select("a"), "a").select("a", "hot"))
        # stored, so that the partition of a frequent key can be split
        heads = stored(full.groupBy("hot").agg(F.min("a").alias("b")))
        stars = full.join(heads, "hot").select("a", "b")
        edges = pairs.where("count >= least").select("a", "b").union(unsure.select("a", "b")).union(stars)
        block = stored(components(edges))
        # tiles of a block, by its n-grams: each is searched, and each pair of them across
        sized = stored(block.select(F.col("node").alias("c"), "root").join(chosen, "c"))
        parts = sized.groupBy("root").agg(F.ceil(F.sum("n") / TILE).cast("int").alias("tiles"))
        tiled = sized.join(parts, "root").withColumn("tile", F.pmod(F.xxhash64("c"), F.col("tiles")).cast("int"))
        tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        place = tiled.select("c", "root", "tile", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), F.col("doc_id").alias("one_id"), F.col("th").alias("one_th"))
        same = F.col("doc_id").cast("long").eqNullSafe(F.col("one_id")) & (F.xxhash64("text") == F.col("one_th"))
        # by a shuffle at every size: what has a partner grows with the input, and one plan's figures hold for more
        texts = docs.select("doc_id", "text").join(place.hint("merge"), same)
        links = texts.groupBy("root", "low", "high").applyInArrow(_search(n, percent), "a long, b long")
        return members, keep(stored(links))


def _classified(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, th, n, c, root, component_id) for each row of ``docs``; c and root are null without n-grams."""
    members, links = linked_classes(docs, n, percent)
    joined = components(links).select(F.col("node").alias("c"), "root")
    smallest = members.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("d"))
    smallest = stored(smallest.join(joined, "c", "left").select("c", "d", F.coalesce("root", "c").alias("root")))
    named = smallest.groupBy("root").agg(F.min("d").alias("component_id"))
    named = stored(smallest.select("c", "root").join(stored(named), "root").select("c", "root", "component_id"))
    component = F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return members.join(named, "c", "left").select("doc_id", "th", "n", "c", "root", component.alias("component_id"))


def near_duplicates(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, th) for each row of ``docs``.

    Documents link when 100 * overlap >= percent * union of their word n-grams; component_id is the smallest
    doc_id that links reach, the own one included. Texts under n words are one n-gram; null, empty and blank
    texts have none, and link with nothing. Null ids link but never name a component of rows with ids; repeated
    rows are linked copies; an empty table gives no rows; other columns are not read. Sets and n-grams are
    met by 64-bit hashes.
    """
    return _classified(docs, n, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "th")


def keep_one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component one row, that with its smallest id, null ids last.

    Of rows of equal id and text one stays, whichever; of texts of one id the one with the smallest hash. Rows
    without n-grams (null, empty and blank texts) all stay; an empty table gives no rows.
    """
    found = _classified(docs.select("doc_id", "text"), n, percent).where("n > 0")
    who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    best = stored(found.groupBy("root").agg(F.min(who).alias("best")))
    # of each row whether it goes, and of those that stay whether they stand there several times
    rows = stored(found.join(best, "root").groupBy("doc_id", "th").agg(F.first(who != F.col("best")).alias("gone"), F.count("*").alias("times")))
    rows = rows.where("gone or times > 1").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "gone")
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("row.text") == F.col("_th"))
    packed = docs.select(F.struct(*docs.columns).alias("row"))
    kept = packed.join(rows, same, "left_anti").select("row.*")
    several = packed.join(rows.where("not gone"), same).groupBy("_id", "_th").agg(F.first("row").alias("row"))
    return kept.union(several.select("row.*"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("th")
