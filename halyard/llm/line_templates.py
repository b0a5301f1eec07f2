"""Line deduplication by a fixed-depth tree of line templates.

A line is parsed as a log message: digits are folded, and its number of tokens and its leading tokens
lead to a leaf of a tree of fixed depth. In a leaf, a token's support is the number of documents that
have it at its place. The tokens of a line with at least a given support are a template, if they are
most of its tokens and one of them is a word; the others are variable fields. Each support that a line's
tokens have is tried, so the values of a field stay variable however often they recur, as long as the
words around them recur more often. Templates that recur across documents are dropped, except in the
document with the smallest id, so that what they say remains once.

All steps are aggregates and joins on hashes. Documents are counted, not lines: most documents have one
line in a leaf, and their counts add up over equal lines, so a line that a third of all documents has is
one row; only documents with several lines in a leaf are counted one by one. No leaf is gathered in one
task, and skewed join partitions are split at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm.common import scratch, stored, table

#: Leading tokens below the token count; documents that a fixed token has at least, and that make a template recur; least tokens
#: of a line with fields; least share of fixed tokens.
LEADING, MIN_DOCS, MIN_TOKENS, FIXED = 3, 3, 3, 0.6
#: An equal line of at least so many tokens is a passage, which two documents are enough for.
PASSAGE = 50
#: Leaves up to this many are broadcast to the lines; more are joined by a shuffle.
BROADCAST_LEAVES = 1_000_000
_WHO = "doc_id", "th"


def _even(line: Column, digits: bool) -> Column:
    """A line's tokens, which stand between white space, parted by one space; with ``digits``, runs of these are folded."""
    odd = line.rlike(r"[\x09-\x0D]|  " + "|[0-9]" * digits) | line.startswith(" ") | line.endswith(" ")
    even = F.trim(F.regexp_replace(F.regexp_replace(line, "[0-9]+", "0") if digits else line, r"[\x20\x09-\x0D]+", " "))
    return F.when(odd, even).otherwise(line)


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, d, pos, line, even, n, leaf, lh) for each line with tokens; ``even`` has them parted evenly, digits folded.

    ``d`` names the document: its id, or its text where the id is null. ``th`` tells texts of an id apart.
    """
    df = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    df = df.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("even", _even(F.col("line"), True))
    df = df.withColumn("n", F.regexp_count("even", F.lit(" ")) + 1)
    d = F.when(F.col("doc_id").isNull(), F.xxhash64("th", F.lit(2))).otherwise(F.xxhash64("doc_id", F.lit(1)))
    return df.withColumns({"d": d, "leaf": F.xxhash64("n", F.substring_index("even", " ", LEADING)), "lh": F.xxhash64("even")})


def _first(*columns: str) -> Column:
    """Aggregate: the row with the smallest id, null ids last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), *columns)).alias("first")


def _templates(places: Column, least: Column) -> Column:
    """A line's templates, one for each support of its tokens: those of that support or more, if ``least`` at least and with a word."""
    sets = F.transform(F.array_distinct(places["support"]), lambda s: F.filter(places, lambda p: p["support"] >= s))
    fit = F.filter(sets, lambda x: (F.size(x) >= least) & F.exists(x, lambda p: p["token"].bitwiseAND(F.lit(1)) == 1))
    return F.transform(fit, lambda x: F.xxhash64(F.transform(x, lambda p: F.struct(p["at"], p["token"]))))


def _documents(rows: DataFrame, several: DataFrame, key: list[str]) -> DataFrame:
    """(key, docs): documents of each ``key``, of ``rows`` (key, single) whose counts add up and of ``several`` (key, d) each counted once."""
    once = several.select(*key, "d").distinct().select(*key, F.lit(1).cast("long").alias("single"))
    return rows.select(*key, "single").union(once).groupBy(*key).agg(F.sum("single").alias("docs"))


def _recurring(by_doc: DataFrame, tokens: DataFrame, min_docs: int, fixed: float) -> DataFrame:
    """(lh, first) of the lines (leaf, lh) whose template recurs in at least ``min_docs`` documents.

    ``by_doc`` has (leaf, d, x) with the lines ``x`` (lh, doc_id, th) of each document and leaf.
    """
    by_doc = by_doc.withColumn("lines", F.array_distinct(F.col("x")["lh"]))
    each = by_doc.select("leaf", F.size("lines").alias("k"), F.posexplode("x").alias("at", "e")).select("leaf", "e.*", ((F.col("k") == 1) & (F.col("at") == 0)).cast("long").alias("single"))
    known = stored(each.groupBy("leaf", "lh").agg(F.sum("single").alias("single"), _first(*_WHO)).join(tokens, ["leaf", "lh"]))
    several = stored(by_doc.where(F.size("lines") > 1).select("leaf", "d", F.explode("lines").alias("lh")))
    place = F.posexplode("tokens").alias("at", "token")
    places = known.select("leaf", "lh", "single", place)
    apart = several.join(known.select("leaf", "lh", "tokens"), ["leaf", "lh"]).select("leaf", "d", place)
    support = _documents(places, apart, ["leaf", "at", "token"]).where(F.col("docs") >= min_docs).withColumnRenamed("docs", "support")
    met = places.join(stored(support), ["leaf", "at", "token"]).groupBy("leaf", "lh").agg(F.sort_array(F.collect_list(F.struct("at", "token", "support"))).alias("places"))
    found = known.select("leaf", "lh", "single", "first", F.size("tokens").alias("n")).join(met, ["leaf", "lh"])
    found = found.where(F.size("places") >= fixed * F.col("n")).withColumn("template", F.explode(_templates(F.col("places"), fixed * F.col("n"))))
    found = stored(found.select("leaf", "lh", "single", "first", "template"))
    total = _documents(found, several.join(found.select("leaf", "lh", "template"), ["leaf", "lh"]), ["leaf", "template"]).where(F.col("docs") >= min_docs)
    firsts = found.groupBy("leaf", "template").agg(F.min("first").alias("of_all"))
    total = stored(total.join(firsts, ["leaf", "template"]).select("leaf", "template", "of_all"))
    return found.join(total, ["leaf", "template"]).groupBy("lh").agg(F.min("of_all").alias("first"))


def _repeated(lines: DataFrame, min_docs: int) -> DataFrame:
    """(lh, first) of the equal lines that at least ``min_docs`` documents have."""
    known = lines.groupBy("lh", "d").agg(_first(*_WHO)).groupBy("lh").agg(F.count("*").alias("docs"), F.min("first").alias("first"))
    return known.where(F.col("docs") >= min_docs).select("lh", "first")


def _cleaned(text: Column, dropped: Column) -> Column:
    left = F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(dropped, i))
    return F.when(dropped.isNull(), text).otherwise(F.array_join(left, "\n"))


def _without(docs: DataFrame, kept: DataFrame, bad: DataFrame) -> DataFrame:
    """``docs`` without the lines of ``kept`` (doc_id, th, pos, lh) that are ``bad`` (lh, first), one row of each lh, except in the first document of each."""
    hit = kept.select(*_WHO, "pos", "lh").join(bad, "lh").where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))))
    hit = hit.groupBy(*_WHO).agg(F.array_sort(F.collect_set("pos")).alias("dropped"))
    hit = hit.select(F.col("doc_id").alias("_hit_id"), F.col("th").alias("_hit_th"), F.col("dropped").alias("_hit"))
    df = docs.join(hit, F.col("doc_id").cast("long").eqNullSafe(F.col("_hit_id")) & (F.xxhash64("text") == F.col("_hit_th")), "left")
    own = [F.col(f"`{c}`").alias(f"{c}_before" if c in ("n_lines", "dropped") else c) for c in docs.columns if c != "text"]
    n = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long")
    return df.select(*own, n.alias("n_lines"), F.col("_hit").alias("dropped"), _cleaned(F.col("text"), F.col("_hit")).alias("text"))


def drop_templates(docs: DataFrame, min_docs: int = MIN_DOCS, fixed: float = FIXED, passages: bool = True) -> DataFrame:
    """``docs`` with ``text`` cleaned, and ``n_lines`` and ``dropped`` (line numbers from 0, or null) added.

    A template goes from ``min_docs`` documents on, which are told apart by id, or by text where it is null. Equal
    lines of PASSAGE tokens or more, digits and all, go from two documents on, unless ``passages`` is false. A
    line of under MIN_TOKENS tokens is a template as a whole. A template without a token that has a letter, such
    as a row of numbers, stays. The first document of a template is that with the smallest id, null ids last;
    of an id with several texts, one of them. Null texts stay null; repeated rows have the same lines dropped,
    or both none. An empty table gives no rows. Other columns are carried along, own columns of the two names
    as ``n_lines_before`` and ``dropped_before``.
    """
    lines = _lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    # lines of few tokens have no leaf, others a hash of the line as it stands only if they are long
    short, letter = F.col("n") < MIN_TOKENS, F.col("line").rlike(r"\p{L}")
    passage = F.when((F.col("n") >= PASSAGE) & letter, F.xxhash64(_even(F.col("line"), False), F.lit(3)))
    kept = lines.select("d", *_WHO, "pos", F.when(~short, F.col("leaf")).alias("leaf"), "lh", passage.alias("passage"), (short & letter).alias("short"))
    kept = stored(kept)
    with scratch(docs.sparkSession) as keep:
        by_doc = kept.where("leaf is not null").groupBy("leaf", "d").agg(F.collect_set(F.struct("lh", *_WHO)).alias("x"))
        by_doc = stored(by_doc)
        leaves = stored(by_doc.groupBy("leaf").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs).select("leaf"))
        if leaves.count() <= BROADCAST_LEAVES:
            leaves = F.broadcast(leaves)
        again = lines.select("leaf", "lh", "even").join(leaves, "leaf", "left_semi")
        # a token's lowest bit says whether it has a letter
        named = F.transform("w", lambda t: F.xxhash64(t).bitwiseAND(F.lit(-2)).bitwiseOR(t.rlike(r"\p{L}").cast("long")))
        tokens = again.groupBy("leaf", "lh").agg(F.first("even").alias("even")).select("leaf", "lh", F.split("even", " ").alias("w")).select("leaf", "lh", named.alias("tokens"))
        bad = _recurring(by_doc.join(leaves, "leaf", "left_semi"), tokens, min_docs, fixed)
        bad = bad.union(_repeated(kept.where("short"), min_docs))
        if passages:
            whole = kept.where("passage is not null").select("d", *_WHO, "pos", F.col("passage").alias("lh"))
            bad = bad.union(_repeated(whole, 2))
            kept = kept.select(*_WHO, "pos", "lh").union(whole.select(*_WHO, "pos", "lh"))
        bad = keep(stored(bad.groupBy("lh").agg(F.min("first").alias("first"))))
    return _without(docs, kept, bad)


def drop_passages(docs: DataFrame) -> DataFrame:
    """Like :func:`drop_templates`, for nothing but equal lines of at least PASSAGE tokens, in two documents or more."""
    lines = _lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).where((F.col("n") >= PASSAGE) & F.col("line").rlike(r"\p{L}"))
    kept = stored(lines.select("d", *_WHO, "pos", F.xxhash64(_even(F.col("line"), False), F.lit(3)).alias("lh")))
    return _without(docs, kept, stored(_repeated(kept, 2)))


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): every document with its text after dropping recurring templates."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_templates(docs).select("doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), "text")
