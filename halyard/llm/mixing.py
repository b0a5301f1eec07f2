"""Mixing sources to target weights by a low-discrepancy schedule of slots.

The mix is a sequence of slots of equal words. Slot i has the golden-ratio point frac(i * phi), and
belongs to the source in whose share of [0, 1) the point falls, so every stretch of the mix follows
the target shares. Each source's documents are shuffled and their words cut into equal blocks; the
r-th slot of a source takes its r-th block, and starts anew after the last one. Slots past a
source's target are left out, and the few that the points leave it short are appended, so every
source gives its target to the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from halyard.llm.common import WORD, n_words, stored, table
from halyard.operators.numbering import numbered

#: The golden ratio's fraction in units of 2**-31: slot * GOLDEN mod 2**31 is exact in 64-bit integers.
GOLDEN, UNIT = 1327217885, 1 << 31
WEIGHTS = (5.0, 2.0, 1.0)
BLOCK = 1024
BUCKETS = 4096
CHUNK = 1 << 16
CELLS = 1024
#: Keys of repeated rows up to this many are broadcast.
BROADCAST_KEYS = 1_000_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """(source, source_size, target) for each source of ``sizes`` (source, size).

    Sources in order get the weights in turn. Targets share all words by weight;
    none passes ``most`` times its source's size, and the excess goes to the others by weight. Sorted
    by size over weight, the sources at their limit come first, so running sums find the level. Only
    per-source sums are ordered in one place; rows are not.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy("source")
    place = (F.row_number().over(order) - 1) % len(weights)
    w = F.element_at(F.array(*map(F.lit, weights)), place + 1)
    df = by_source.select("source", "source_size", w.alias("weight"), (most * F.col("source_size")).alias("limit"))
    full = Window.orderBy(F.col("limit") / F.col("weight"), "source")
    before, everything = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    df = df.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") < F.col("limit"))
    # the first source under its limit sets the level for all that follow
    level = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(everything)
    return df.select("source", "source_size", F.least(F.col("limit"), F.coalesce(level * F.col("weight"), F.col("limit"))).alias("target"))


def _placed(sizes: DataFrame, seed: int) -> DataFrame:
    """Adds ``start``: the words of the source before this row, in shuffled order.

    Two levels of running sums: within a bucket of a source, and over a source's buckets, so that no
    task holds a source.
    """
    h = F.xxhash64("doc_id", F.lit(seed))
    df = sizes.withColumns({"h": h, "bucket": F.shiftright(h, 52)})
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy("source", "bucket").agg(F.sum("size").alias("words")).select("source", "bucket", F.coalesce(F.sum("words").over(over), F.lit(0)).alias("base"))
    df = df.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return df.join(base, ["source", "bucket"]).withColumn("start", F.col("base") + F.col("inside")).drop("h", "bucket", "inside", "base")


def schedule(targets: DataFrame, total: int, block: int = BLOCK) -> DataFrame:
    """(slot, source, rank, take): the slots of the mix in order; ``take`` words each, at most ``block``.

    ``targets`` has (source, source_size, words) with ``words`` the whole words to take. Points meet
    their sources by a join on a grid of cells, within a cell by its bounds.
    """
    spark, targets = targets.sparkSession, targets.where("words > 0")
    n = -(-total // block)
    order = Window.orderBy("source")
    shares = targets.withColumn("high", F.sum("words").over(order) / F.lit(float(max(total, 1)))).withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0.0)))
    cell = lambda x: F.least(F.floor(x * CELLS), F.lit(CELLS - 1))
    shares = shares.select("source", "words", "low", F.when(F.lead("low").over(order).isNull(), 2.0).otherwise(F.col("high")).alias("high"), F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    point = (F.col("slot") % UNIT * GOLDEN % UNIT) / float(UNIT)
    slots = spark.range(n).select(F.col("id").alias("slot")).withColumn("point", point).withColumn("cell", cell(F.col("point")))
    met = slots.join(shares, "cell").where("point >= low and point < high").select("slot", "source", "words", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    per_chunk = met.groupBy("source", "chunk").agg(F.count("*").alias("here"))
    base = per_chunk.select("source", "chunk", F.coalesce(F.sum("here").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1
    met = met.withColumn("inside", rank)
    met = met.join(base, ["source", "chunk"]).select("slot", "source", "words", (F.col("base") + F.col("inside")).alias("rank"))
    have = per_chunk.groupBy("source").agg(F.sum("here").alias("have"))
    short = targets.join(have, "source", "left").select("source", "words", "source_size", F.coalesce("have", F.lit(0)).alias("have"))
    need = _slots(F.col("words"), F.col("source_size"), block)
    extra = short.where(F.col("have") < need).select((F.lit(n) + F.col("have")).alias("slot"), "source", "words", F.explode(F.sequence(F.col("have"), need - 1)).alias("rank"))
    every = met.unionByName(extra)
    every = every.join(targets.select("source", "source_size"), "source")
    blocks = F.ceil(F.col("source_size") / block)
    turn, at = F.floor(F.col("rank") / blocks), F.col("rank") % blocks
    done = turn * F.col("source_size") + at * block
    whole = F.least(F.lit(block), F.col("source_size") - at * block)
    return every.withColumns({"turn": turn, "block": at, "take": F.least(whole, F.col("words") - done)}).where("take > 0").select("slot", "source", "rank", "turn", "block", "take")


def _slots(words, size, block):
    """Slots that give ``words`` words of a source: turns of its blocks, whose last one is short."""
    rest = words % size
    return F.floor(words / size) * F.ceil(size / block) + F.ceil(rest / block)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """(doc_id, source, tie, size, source_size, target, start, taken) for each row of ``docs``.

    ``taken`` counts the words that the schedule takes of the row, repeats included; never more than
    ``most`` times its size. A null text has size 0; null sources are a source of their own; repeated
    rows are rows like others; ``tie`` is a hash of the text. Reruns give the same mix.
    """
    doc = F.col("doc_id").cast("long").alias("doc_id")
    # a key that is never null and sorts as the sources do, null last
    source = F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1")).alias("source")
    sizes = stored(docs.select(doc, source, n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")))
    targets = source_targets(sizes, weights, most)
    targets = stored(targets.withColumn("words", F.least(F.round("target").cast("long"), F.floor(most * F.col("source_size")))))
    total = targets.agg(F.sum("words")).first()[0] or 0  # one number
    placed = stored(_placed(sizes, seed))
    slots = schedule(targets, total, block)
    # how often each block is taken, and how far into it the last, partial take goes
    whole_block = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    slots = slots.join(targets.select("source", "source_size"), "source")
    used = slots.groupBy("source", "block").agg(F.sum((F.col("take") == whole_block).cast("long")).alias("times"), F.max(F.when(F.col("take") < whole_block, F.col("take")).otherwise(0)).alias("part"))
    end = F.col("start") + F.col("size")
    pieces = placed.where("size > 0").withColumn("piece", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))))
    met = pieces.join(used.withColumnRenamed("block", "piece"), ["source", "piece"])
    low, high = F.greatest("start", F.col("piece") * block), F.least(end, (F.col("piece") + 1) * block)
    part = F.greatest(F.lit(0), F.least(high, F.col("piece") * block + F.col("part")) - low)
    taken = met.groupBy("doc_id", "source", "tie", "start", "size").agg(F.sum((high - low) * F.col("times") + part).alias("taken"))
    # a row without words shares its start with the next one, but not its size
    keys = ("doc_id", "source", "tie", "start", "size")
    every = placed.groupBy(*keys).agg(F.count("*").alias("rows")).withColumn("taken", F.lit(0).cast("long"))
    taken = every.unionByName(taken.withColumn("rows", F.lit(0).cast("long"))).groupBy(*keys).agg(F.sum("rows").alias("rows"), F.sum("taken").alias("taken"))
    taken = taken.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    source = F.when(F.col("source") != "1", F.substr("source", F.lit(2))).alias("source")
    return taken.join(targets, "source").select("doc_id", source, "tie", "size", "source_size", "target", "start", "taken")


def mix_texts(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: each row of ``docs`` once for every whole time that the schedule takes it.

    Where a source's last slot ends inside a document, its first words up to there follow as one more row,
    with ``n_chars`` (if there) set anew. Rows without words, null and empty texts among them, are not taken. Rows of equal id,
    source and text, null or not, share what is taken of them in any order. An empty table gives no rows. Other columns
    are carried along, whatever their names.
    """
    source = F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1"))
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), F.xxhash64("text").alias("tie"))
    own = own.select("row", F.xxhash64("doc_id", "source", "tie").alias("key"))
    taken = mix(docs, **options).where("taken > 0")
    source = F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1"))
    taken = stored(taken.select("doc_id", source.alias("source"), "tie", "size", "taken", "start").select(F.xxhash64("doc_id", "source", "tie").alias("key"), "size", "taken", "start"))
    # of equal rows only what is taken is numbered, in the order of the mix; the rows themselves, which are whole texts, only where a key has several
    times = stored(own.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    many = times.count()
    if many <= BROADCAST_KEYS:
        times = F.broadcast(times)
    once = own.join(times, "key", "left_anti").withColumn("copy", F.lit(1).cast("long"))
    alone = taken.join(times, "key", "left_anti").withColumn("copy", F.lit(1).cast("long"))
    if many:
        once = once.unionByName(_copies(own.join(times, "key", "left_semi"), F.rand(7)))
        alone = alone.unionByName(_copies(taken.join(times, "key", "left_semi"), F.col("start")))
    # the number is a bound and no join key where there is one shuffle of the texts
    same = (F.col("own.key") == F.col("taken.key")) & (F.col("own.copy") <= F.col("taken.copy")) & (F.col("own.copy") >= F.col("taken.copy"))
    df = once.alias("own").join(alone.alias("taken"), same).select("own.row", "taken.size", "taken.taken")
    turns, rest = F.floor(F.col("taken") / F.col("size")), F.col("taken") % F.col("size")
    lengths = F.concat(F.array_repeat(F.lit(-1).cast("long"), turns.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<long>")))
    df = df.select("row", F.explode(lengths).alias("words"))
    # each source has one such row at most
    words = F.regexp_extract_all(F.col("row.text"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.regexp_replace(F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), ""), r"[\x20\x09-\x0D]+$", "")
    df = df.select("row", F.when(F.col("words") >= 0, cut).alias("cut"))
    new = {"text": F.coalesce("cut", "row.text").alias("text"), "n_chars": F.when(F.col("cut").isNull(), F.col("row.n_chars")).otherwise(F.char_length("cut").cast("long")).alias("n_chars")} if "n_chars" in docs.columns else {"text": F.coalesce("cut", "row.text").alias("text")}
    return df.select(*(new[c] if c in new else F.col(f"row.`{c}`") for c in docs.columns))


def _copies(rows: DataFrame, order: Column) -> DataFrame:
    """Adds ``copy``: 1, 2, ... among the rows of a key, numbered by ranges of key and ``order``, so that no task holds a key."""
    df = numbered(rows.withColumn("at", order), ["key", "at"], "place").drop("at")
    df = stored(df)
    first = stored(df.groupBy("key").agg(F.min("place").alias("first")))
    return df.join(first, "key").withColumn("copy", F.col("place") - F.col("first") + 1).drop("place", "first")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
