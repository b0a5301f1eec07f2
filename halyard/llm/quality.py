"""Quality rules under weak supervision, in DataFrame expressions only.

Each rule votes keep (1) or reject (-1), or abstains (0). The class of a document is latent: votes are
taken as independent given the class, and expectation-maximisation over the counts of vote patterns
estimates the share of good documents and each rule's accuracy in each class. A document is kept
by its posterior, so one mistaken rule does not reject it. There are at most 3 to the power of the
number of rules patterns, whatever the size of the corpus; only their counts come to the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm.common import WORD, stored, table

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = "the of and to in is it that der die und das ist den le la les de et des un une el los las que en con por"
#: (name, SQL for reject, SQL for keep) over the columns of :func:`measure`.
RULES = [
    ("symbols", "n_symbols > 0.1 * n_words", "n_symbols = 0"),
    ("word_length", "word_chars < 3 * n_words or word_chars > 10 * n_words", "word_chars between 3.5 * n_words and 8 * n_words"),
    ("repeated_lines", "n_dup_lines > 0.3 * n_lines", "n_dup_lines = 0"),
    ("repeated_words", "n_repeat_words > 0.3 * n_words", "n_repeat_words <= 0.1 * n_words"),
    ("upper_case", "n_upper > 0.3 * word_chars", "n_upper <= 0.1 * word_chars"),
    ("line_ends", "n_ended < 0.5 * n_lines", "n_ended >= 0.9 * n_lines"),
    ("function_words", "false", "n_stop >= 0.05 * n_words"),  # abstains on other languages
    ("variety", "n_distinct < 0.3 * n_words", "n_distinct >= 0.5 * n_words"),
    ("exclamations", "n_exclaimed > 0.3 * n_words", "false"),
]
#: Expected shares of reject, abstain, keep votes in bad and good documents; they count as PRIOR_WEIGHT of the documents.
PRIOR = ((0.4, 0.3, 0.3), (0.01, 0.19, 0.8))
PRIOR_WEIGHT, GOOD_SHARE, ROUNDS = 0.02, 0.85, 50
#: A rule is written so that few good documents break it: the most that its reject votes may be wrong on them.
MOST_WRONG = 0.01
_POSITION = (1 << 24) - 1
#: Windows of a text up to which their places fit beside their hashes.
_MOST_WINDOWS = 1 << 24


def measure(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The columns ``carry`` and the counts that the rules use, for each row of ``docs``.

    Repeated three-word windows are found by sorting, in each text, one long per window: 40 bits of the
    window's hash and 24 of its place. Neighbours that agree in the 40 bits are compared in all 64;
    a text where two differ there, or of over 2**24 words, has its windows sorted as pairs of hash and place.
    """
    own = [F.col(c).alias(f"carry_{k}") for k, c in enumerate(carry)]
    kept = [f"carry_{k}" for k in range(len(carry))]
    df = docs.select(*own, F.coalesce("text", F.lit("")).alias("t"))
    lines = "filter(split(t, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    df = df.select(*kept, "t", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w"), F.expr(lines).alias("lines"))
    drop = lambda chars: f"cast(char_length(t) - char_length(translate(t, '{chars}', '')) as long)"
    space = r" \t\n\u000b\u000c\r"
    df = df.select(
        *kept,
        F.expr("transform(w, x -> xxhash64(x))").alias("h"),
        F.expr("cast(size(w) as long)").alias("n_words"),
        F.expr(f"cast(char_length(translate(t, '{space}', '')) as long)").alias("word_chars"),
        F.expr(drop("#*$%&|<>")).alias("n_symbols"),
        F.expr(drop("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("n_upper"),
        F.expr(drop("!")).alias("n_exclaimed"),
        F.expr("cast(size(lines) as long)").alias("n_lines"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) as long)").alias("n_dup_lines"),
        F.expr(r"cast(size(filter(lines, x -> x rlike '[.!?\"\\u201d][\\x20\\x09-\\x0D]*$')) as long)").alias("n_ended"),
        F.regexp_count("t", F.lit(rf"(?i)(?<![^\x20\x09-\x0D])(?:{'|'.join(STOP_WORDS.split())})(?![^\x20\x09-\x0D])")).cast("long").alias("n_stop"),
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_upper", "n_exclaimed", "n_lines", "n_dup_lines", "n_ended", "n_stop"]
    df = df.select(*kept, *counts, F.expr("cast(size(array_distinct(h)) as long)").alias("n_distinct"), F.expr("case when size(h) >= 3 then transform(sequence(0, size(h) - 3), i -> xxhash64(h[i], h[i + 1], h[i + 2])) else array() end").alias("g"))
    counts.append("n_distinct")
    df = df.select(*kept, *counts, "g", F.expr(f"sort_array(transform(g, (x, i) -> (x & ~{_POSITION}L) | i))").alias("k"))
    same = "shiftright(k[i - 1], 24) = shiftright(x, 24)"
    df = df.select(*kept, *counts, "g", "k", F.expr(f"filter(transform(k, (x, i) -> case when i > 0 and {same} then i end), x -> x is not null)").alias("d"))
    place = lambda x: f"cast({x} & {_POSITION}L as int)"
    differs = f"exists(d, i -> g[{place('k[i]')}] <> g[{place('k[i - 1]')}])"
    fast = f"sort_array(array_distinct(flatten(transform(d, i -> array({place('k[i - 1]')}, {place('k[i]')})))))"
    pairs = "sort_array(transform(g, (x, i) -> named_struct('h', x, 'p', i)))"
    equal = "filter(sequence(1, size(s) - 1), j -> s[j].h = s[j - 1].h)"
    slow = f"element_at(transform(array({pairs}), s -> sort_array(array_distinct(flatten(transform({equal}, j -> array(s[j - 1].p, s[j].p)))))), 1)"
    df = df.select(*kept, *counts, F.expr(f"case when size(g) > {_MOST_WINDOWS} or {differs} then {slow} else {fast} end").alias("p"))
    covered = "cast(coalesce(aggregate(transform(p, (x, i) -> case when i = 0 then 3 else least(3, x - p[i - 1]) end), 0, (s, x) -> s + x), 0) as long)"
    out = df.select(*kept, *counts, F.expr(covered).alias("n_repeat_words"))
    for k, c in enumerate(carry):
        out = out.withColumnRenamed(f"carry_{k}", c)
    return out


def fit(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[list[list[float]]]]:
    """(log odds of a good document, log P(vote) by class, rule and vote + 1), from pattern counts."""
    rules = len(RULES)
    share, p = GOOD_SHARE, [[list(PRIOR[y]) for _ in range(rules)] for y in (0, 1)]
    total = sum(n for _, n in patterns)
    weight = max(1.0, PRIOR_WEIGHT * total)
    for _ in range(ROUNDS):
        votes = [[[weight * x for x in PRIOR[y]] for _ in range(rules)] for y in (0, 1)]
        good = 0.0
        for pattern, n in patterns:
            odds = math.log(share / (1 - share)) + sum(math.log(p[1][j][v + 1] / p[0][j][v + 1]) for j, v in enumerate(pattern))
            q = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
            good += q * n
            for j, v in enumerate(pattern):
                votes[1][j][v + 1] += q * n
                votes[0][j][v + 1] += (1 - q) * n
        share = (good + weight * GOOD_SHARE) / (total + weight)
        p = [[[x / sum(row) for x in row] for row in votes[y]] for y in (0, 1)]
        for row in p[1]:
            if row[0] > MOST_WRONG:
                rest = (1 - MOST_WRONG) / (row[1] + row[2])
                row[:] = [MOST_WRONG, row[1] * rest, row[2] * rest]
    return math.log(share / (1 - share)), [[[math.log(x) for x in row] for row in p[y]] for y in (0, 1)]


def judge(docs: DataFrame, carry: list[str], threshold: float = 0.5) -> DataFrame:
    """``carry`` columns of each row with its counts, votes, ``posterior``, ``base_failed`` and ``kept``.

    A null or empty text has no words, fails the base rules and is not kept. Null ids and repeated rows are
    judged like others; an empty table gives no rows. The measured rows go to the shared folder, so texts
    are measured once.
    """
    df = measure(docs, carry)
    votes = [f"vote_{name}" for name, _, _ in RULES]
    for name, reject, keep in RULES:
        df = df.withColumn(f"vote_{name}", F.expr(f"case when {reject} then -1 when {keep} then 1 else 0 end"))
    df = stored(df)
    patterns = [(tuple(r[:-1]), r[-1]) for r in df.where("n_words > 0").groupBy(*votes).count().orderBy(*votes).collect()]  # at most 3**9
    prior, p = fit(patterns)
    odds = F.lit(prior)
    for j, v in enumerate(votes):
        weigh = [F.lit(p[1][j][k] - p[0][j][k]) for k in range(3)]
        odds = odds + F.when(F.col(v) < 0, weigh[0]).when(F.col(v) > 0, weigh[2]).otherwise(weigh[1])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    df = df.withColumns({"posterior": 1 / (1 + F.exp(-odds)), "base_failed": failed})
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return judge(docs, ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
