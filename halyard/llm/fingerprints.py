"""Document fingerprints by I-Match over several randomised lexicons, in DataFrame expressions only.

A lexicon keeps the terms of a chosen band of inverse document frequency: neither the words that every
text has nor those that hardly any shares. It is divided at random into sets, at several rates, so
that short and long texts alike have sets with few of their terms. A text's distinct terms are sorted,
and its terms of each set hashed in that order; the hashes are the fingerprint. Texts agree in a set's
hash if they share all terms that they have in it, so the share of agreeing sets, at the rate where it is
highest, tells how alike two texts are.

A text without terms of the lexicon has the sets of all its terms for a fingerprint, and is compared by
all terms.
"""

from __future__ import annotations

import json
import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halyard.llm.common import stored, table

#: Shares of all distinct texts that have a term of the lexicon: at least, at most.
LEAST, MOST = 0.001, 0.1
#: Each level samples a quarter of the terms of the one before, and divides them into SETS sets by their highest bits.
LEVELS, SETS = 4, 16
#: Beyond this many terms a lexicon is joined by a shuffle; mean distinct terms of a text / LEAST bounds it.
BROADCAST_TERMS = 2_000_000
MOST_BUCKETS = 1 << 16
#: Equal rows of one id beyond this share of a bucket are one row with a count.
HOT = 0.25
_LOWEST = -(1 << 63)


def terms(text: Column) -> Column:
    """The distinct hashes of a text's words: runs of letters and digits, in lower case; of a text without words, its own."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    words = F.when((F.size(words) == 0) & (text != ""), F.array(text)).otherwise(words)
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, least: float = LEAST, most: float = MOST) -> DataFrame:
    """(term): hashes of the terms that a share of the distinct texts of ``docs`` between ``least`` and ``most`` has.

    Of texts that stand there several times one is taken; all others are counted where they are read.
    """
    docs = docs.withColumn("th", F.xxhash64("t"))
    copies = stored(docs.select("th").groupBy("th").agg(F.count("*").alias("n")))
    n = copies.count()
    copies = copies.where("n > 1").select("th")
    if copies.count() <= BROADCAST_TERMS:
        copies = F.broadcast(copies)
    one = docs.join(copies, "th", "left_semi").groupBy("th").agg(F.first("t").alias("t")).select("t")
    every = docs.join(copies, "th", "left_anti").select("t").union(one)
    found = every.select(F.explode(terms(F.col("t"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return stored(found.where((F.col("df") >= least * n) & (F.col("df") <= max(most * n, 1))).select("term"))


def _bounds(light: DataFrame, buckets: int) -> list[tuple[int, int]]:
    """At most about ``buckets`` places (o, tie) that part the rows of ``light`` evenly, also within a frequent ``o``."""
    if buckets < 2:
        return []
    at = light.agg(F.percentile_approx("o", [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0] or []
    times = Counter(at)
    found = [(o, _LOWEST) for o in times]
    hot = [(o, n) for o, n in times.items() if n > 1]
    if hot:  # at most half of ``buckets``
        most = max(n for _, n in hot)
        rows = light.join(F.broadcast(light.sparkSession.createDataFrame(hot, "o long, parts int")), "o")
        inner = rows.groupBy("o", "parts").agg(F.percentile_approx("tie", [i / most for i in range(1, most)] or [0.5], 10 * most).alias("ties"))
        for o, parts, ties in inner.collect():
            found += [(o, tie) for tie in ties[:: max(1, most // parts)]]
    return sorted(set(found))


def _bucket(df: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """Adds ``bucket``: the number of ``bounds`` below a row's (o, tie), by a search of three levels."""
    g = max(2, math.ceil(len(bounds) ** (1 / 3)))
    array = lambda b: F.from_json(F.lit(json.dumps([{"o": o, "t": t} for o, t in b])), "array<struct<o: bigint, t: bigint>>")  # noqa: E731  folded once
    below = lambda b: F.size(F.filter(b, lambda x: (x["o"] < F.col("o")) | ((x["o"] == F.col("o")) & (x["t"] < F.col("tie")))))
    part = lambda b, start: F.slice(b, start + 1, F.lit(g))
    df = df.withColumn("b0", below(array(bounds[:: g * g])))
    df = df.withColumn("b1", F.when(F.col("b0") == 0, 0).otherwise((F.col("b0") - 1) * g + below(part(array(bounds[::g]), (F.col("b0") - 1) * g))))
    last = F.when(F.col("b1") == 0, 0).otherwise((F.col("b1") - 1) * g + below(part(array(bounds), (F.col("b1") - 1) * g)))
    return df.withColumn("bucket", last).drop("b0", "b1")


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """(bucket, rn, own, doc_id, t, next_t, copies): the text after each row's in descending order of doc_id.

    After the last comes the first; null ids are last, and equal ids are ordered by a hash of the text. Rows
    are dealt to buckets by percentiles of id and hash, so that one shuffle is enough and a frequent id is
    parted too: the first text of each bucket is also sent to the bucket before it, as a row with ``own`` false.
    Equal rows that would fill a bucket are one row with ``copies``; each but the last is followed by itself.
    """
    spark = docs.sparkSession
    buckets = buckets or min(MOST_BUCKETS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    df = docs.withColumns({"o": F.coalesce("doc_id", F.lit(_LOWEST)), "tie": F.xxhash64("t")})
    counted = stored(df.select("o", "tie").groupBy("o", "tie").agg(F.count("*").alias("copies")))
    total = counted.agg(F.sum("copies")).first()[0] or 0
    hot = counted.where(F.col("copies") > max(2.0, HOT * total / buckets)).select("o", "tie")  # at most buckets / HOT
    many = [tuple(r) for r in hot.collect()]
    df = df.select("doc_id", "o", "tie", "t", F.lit(1).cast("long").alias("copies"))
    if many:
        hot = F.broadcast(spark.createDataFrame(many, "o long, tie long"))
        one = df.join(hot, ["o", "tie"], "left_semi").groupBy("o", "tie").agg(F.first("doc_id").alias("doc_id"), F.first("t").alias("t"), F.count("*").alias("copies"))
        df = df.join(hot, ["o", "tie"], "left_anti").select("doc_id", "o", "tie", "t", "copies").union(one.select("doc_id", "o", "tie", "t", "copies"))
    bounds = _bounds(counted.select("o", "tie"), buckets)  # once: beyond some rows its percentiles depend on the order in which partitions arrive
    df = _bucket(df, bounds)
    # one row for each bucket, at most MOST_BUCKETS
    heads = sorted(tuple(r) for r in _bucket(counted, bounds).groupBy("bucket").agg(F.max(F.struct("o", "tie")).alias("x")).select("bucket", "x.o", "x.tie").collect())
    before = [(b, o, tie, heads[(i + 1) % len(heads)][0]) for i, (b, o, tie) in enumerate(heads)]
    heads = spark.createDataFrame(before, "bucket int, o long, tie long, target int")
    df = df.join(F.broadcast(heads), ["bucket", "o", "tie"], "left")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(True).alias("own"))
    copy = F.struct(F.col("target").alias("bucket"), F.lit(False).alias("own"))
    df = df.withColumn("x", F.explode(F.when(F.col("target").isNull(), F.array(own)).otherwise(F.array(own, copy))))
    df = df.select("x.bucket", "x.own", "doc_id", "o", "tie", "t", "copies")
    order = Window.partitionBy("bucket").orderBy(F.desc("own"), F.desc("o"), F.desc("tie"))
    return df.select("bucket", "own", "doc_id", "t", "copies", F.row_number().over(order).alias("rn"), F.lead("t").over(order).alias("next_t"))


def edited(text: Column, next_text: Column) -> Column:
    """``text`` with its last half replaced by as many first characters of ``next_text``, or all it has."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(next_text, F.lit(1), half))


def sets_of(ordered: Column) -> Column:
    """The hashes of LEVELS x SETS sets of sorted terms; null for a set without any."""
    sampled = lambda mask: F.filter(ordered, lambda t: t.bitwiseAND(F.lit(mask)) == 0)
    bit = lambda own, n, value: F.filter(own, lambda t: F.shiftrightunsigned(t, n).bitwiseAND(F.lit(1)) == value)

    def halved(parts: Column, n: int) -> Column:
        return F.flatten(F.transform(parts, lambda own: F.array(bit(own, n, 0), bit(own, n, 1))))

    found = []
    for level in range(LEVELS):
        parts = F.array(sampled((1 << 2 * level) - 1) if level else ordered)
        for n in range(63, 63 - SETS.bit_length() + 1, -1):
            parts = halved(parts, n)
        found.append(F.transform(parts, lambda x: F.when(F.size(x) > 0, F.xxhash64(x))))
    return F.concat(*found)


def likeness(a: Column, b: Column) -> Column:
    """The share of sets with equal hashes among those that either has, at the level where it is highest; 0 if neither has any."""
    shares = []
    for level in range(LEVELS):
        x, y = F.slice(a, level * SETS + 1, SETS), F.slice(b, level * SETS + 1, SETS)
        pairs = F.zip_with(x, y, lambda p, q: F.when(p.isNull() & q.isNull(), None).otherwise(F.coalesce(p == q, F.lit(False))))
        either, same = F.size(F.filter(pairs, lambda p: p.isNotNull())), F.size(F.filter(pairs, lambda p: p))
        shares.append(F.when(either >= 4 if level else either >= 1, same / either))
    return F.coalesce(F.greatest(*shares), F.lit(0.0))


def text_of(sets: Column) -> Column:
    return F.array_join(F.transform(sets, lambda x: F.coalesce(F.lower(F.hex(x)), F.lit(""))), ".")


def fingerprint(docs: DataFrame, least: float = LEAST, most: float = MOST) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row.

    Null texts count as empty, with an empty fingerprint; null ids come last in the order; repeated rows
    follow each other; a single row is its own next; an empty table gives no rows; other columns are not
    read. Equal texts have likeness 1, others that of their sets, 0 where neither has a term. Everything
    after the one shuffle of the texts works within its partitions.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
    words = lexicon(docs, least, most)
    rows = with_next(docs).withColumn("e", F.when(F.col("own"), edited(F.col("t"), F.col("next_t"))))
    # followed by itself, where it has copies
    rows = rows.withColumn("s", F.when(F.col("own") & (F.col("copies") > 1), edited(F.col("t"), F.col("t"))))
    rows = rows.withColumns({f"all_{c}": F.sort_array(terms(F.col(c))) for c in "tes"})
    row = ["own", "doc_id", "copies", F.char_length("t").cast("long").alias("n_chars"), *(F.sha2(c, 256).alias(f"sha_{c}") for c in "es"), *(F.xxhash64(c).alias(f"h_{c}") for c in "tes"), *(f"all_{c}" for c in "tes")]
    rows = rows.select("bucket", "rn", F.struct(*row).alias("row"))
    # one row for each term, without the row's other columns, and one with these
    none = F.when(F.lit(False), F.col("row"))
    entry = lambda which, term, row: F.struct(F.lit(which).alias("which"), term.alias("term"), row.alias("row"))
    of_text = lambda c: F.transform(F.coalesce(f"row.all_{c}", F.array().cast("array<long>")), lambda t: entry(c, t, none))
    each = F.concat(F.array(entry("", F.lit(None).cast("long"), F.col("row"))), *map(of_text, "tes"))
    rows = rows.select("bucket", "rn", F.explode(each).alias("x")).select("bucket", "rn", "x.*")
    if words.count() <= BROADCAST_TERMS:
        words = F.broadcast(words)
    rows = rows.join(words.withColumn("known", F.lit(True)), "term", "left").where("known or which = ''")
    gathered = [F.sort_array(F.collect_list(F.when(F.col("which") == c, F.col("term")))).alias(f"own_{c}") for c in "tes"]
    sets = rows.groupBy("bucket", "rn").agg(F.first("row", ignorenulls=True).alias("row"), *gathered).select("bucket", "rn", "row.*", *(f"own_{c}" for c in "tes"))
    sets = sets.withColumns({f"sets_{c}": sets_of(F.col(f"own_{c}")) for c in "tes"})
    order = Window.partitionBy("bucket").orderBy("rn")
    after = ("h_t", "all_t", "sets_t", F.size("own_t"))
    sets = sets.withColumns({f"next_{name}": F.lead(c).over(order) for name, c in zip(("h", "all", "sets", "own"), after)}).where("own")
    known = lambda c: F.size(f"own_{c}") > 0
    name = lambda c: F.when(known(c), F.col(f"sets_{c}")).otherwise(sets_of(F.col(f"all_{c}")))

    def near(same: Column, both: Column, other: Column, other_all: Column) -> Column:
        return F.when(same, 1.0).when(both, likeness(F.col("sets_t"), other)).otherwise(likeness(sets_of(F.col("all_t")), sets_of(other_all)))

    near_edited = lambda c: near(F.col("h_t") == F.col(f"h_{c}"), known("t") & known(c), F.col(f"sets_{c}"), F.col(f"all_{c}"))
    near_next = near(F.col("h_t") == F.col("next_h"), known("t") & (F.col("next_own") > 0), F.col("next_sets"), F.col("next_all"))
    found = lambda c, next_: F.struct(F.col(f"sha_{c}").alias("sha"), text_of(name(c)).alias("print"), near_edited(c).alias("edited"), next_.alias("next"))
    sets = sets.select("doc_id", "n_chars", "copies", text_of(name("t")).alias("fingerprint"), found("e", near_next).alias("x"), F.when(F.col("copies") > 1, found("s", F.lit(1.0))).alias("y"))
    each = F.when(F.col("copies") > 1, F.concat(F.array("x"), F.array_repeat("y", (F.col("copies") - 1).cast("int")))).otherwise(F.array("x"))
    sets = sets.select("doc_id", "n_chars", "fingerprint", F.explode(each).alias("x"))
    return sets.select("doc_id", "n_chars", F.col("x.sha").alias("edited_sha256"), "fingerprint", F.col("x.print").alias("edited_fingerprint"), F.col("x.edited").alias("near_edited"), F.col("x.next").alias("near_next"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(table(spark, sf_dir, "documents"))
