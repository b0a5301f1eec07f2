"""SQL for the text operators, or for those of their columns that SQL can express, and the queries that it checks.

Each query runs its operator over its whole table. Words, lines and ids are taken as the operators take them; SQL
meets words and sets themselves where the operators meet their hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm import fingerprints, line_templates, mixing, quality, subword_lm
from halyard.llm.common import table

_W = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Documents with the set of their word n-grams; links; components.
JOIN_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
every AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT reach.a, every.b FROM reach JOIN every ON reach.b = every.a)
SELECT doc_id, len(g) AS n_shingles, m AS component_id FROM s JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = doc_id
"""

#: The template tree: support of tokens by distinct documents, templates for each support, recurring ones, lines to drop.
TEMPLATES_SQL = rf"""
WITH x AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
l AS (SELECT *, len(w) AS n, len(raw) AS nr, len(w)::VARCHAR || ' ' || array_to_string(w[1:{line_templates.LEADING}], ' ') AS leaf, array_to_string(w, ' ') AS lh, regexp_matches(line, '\p{{L}}') AS letter
  FROM (SELECT *, regexp_extract_all(regexp_replace(line, '[0-9]+', '0', 'g'), '[^\x20\x09-\x0D]+') AS w, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS raw FROM x) WHERE len(w) > 0),
tree AS (SELECT DISTINCT doc_id, leaf, lh, n, w FROM l WHERE n >= {line_templates.MIN_TOKENS}),
t AS (SELECT doc_id, leaf, lh, n, unnest(w) AS token, unnest(range(len(w))) AS k FROM tree),
support AS (SELECT leaf, k, token, count(DISTINCT doc_id) AS s FROM t GROUP BY ALL HAVING count(DISTINCT doc_id) >= {line_templates.MIN_DOCS}),
lines AS (SELECT leaf, lh, n, list({{'k': k, 'token': token, 's': s}} ORDER BY k) AS p FROM (SELECT DISTINCT leaf, lh, n, k, token FROM t) JOIN support USING (leaf, k, token) GROUP BY leaf, lh, n),
cut AS (SELECT leaf, lh, n, list_filter(p, lambda q: q.s >= least) AS p FROM (SELECT *, unnest(list_distinct(list_transform(p, lambda q: q.s))) AS least FROM lines)),
named AS (SELECT leaf, lh, array_to_string(list_transform(p, lambda q: q.k::VARCHAR || ' ' || q.token), chr(10)) AS template FROM cut WHERE len(p) >= {line_templates.FIXED} * n AND len(list_filter(p, lambda q: regexp_matches(q.token, '\p{{L}}'))) > 0),
recurring AS (SELECT leaf, template, min(doc_id) AS first FROM named JOIN tree USING (leaf, lh) GROUP BY ALL HAVING count(DISTINCT doc_id) >= {line_templates.MIN_DOCS}),
bad AS (SELECT 'line' AS kind, lh, min(first) AS first FROM named JOIN recurring USING (leaf, template) GROUP BY lh
  UNION ALL SELECT 'line', lh, min(doc_id) FROM l WHERE n < {line_templates.MIN_TOKENS} AND letter GROUP BY lh HAVING count(DISTINCT doc_id) >= {line_templates.MIN_DOCS}
  UNION ALL SELECT 'passage', array_to_string(raw, ' '), min(doc_id) FROM l WHERE nr >= {line_templates.PASSAGE} AND letter GROUP BY 2 HAVING count(DISTINCT doc_id) >= 2),
gone AS (SELECT DISTINCT l.doc_id, l.pos FROM l JOIN bad ON (bad.kind = 'line' AND bad.lh = l.lh OR bad.kind = 'passage' AND nr >= {line_templates.PASSAGE} AND bad.lh = array_to_string(raw, ' ')) AND l.doc_id <> bad.first),
left_ AS (SELECT x.doc_id, count(*) AS n_lines, count(gone.pos) AS n_dropped, coalesce(string_agg(x.line, chr(10) ORDER BY x.pos) FILTER (WHERE gone.pos IS NULL), '') AS text FROM x LEFT JOIN gone USING (doc_id, pos) GROUP BY x.doc_id)
SELECT doc_id, n_lines, n_dropped, text FROM left_ UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""

_TARGETS_SQL = rf"""
WITH s AS (SELECT source, sum(len({_W}))::BIGINT AS source_size FROM documents GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS most FROM s),
o AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM w WINDOW before AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT first(level ORDER BY most / weight, source NULLS LAST) AS level FROM o WHERE level * weight < most)
SELECT source, source_size, round(least(most, coalesce(f.level * weight, most)), 3) AS target FROM o LEFT JOIN f ON true
"""

_COUNTS_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
g AS (SELECT r, i, word, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, word, b, c) AS n FROM g WHERE c IS NOT NULL) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(3) t(k) GROUP BY r),
counted AS (SELECT d.r, doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
every AS (SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM counted LEFT JOIN covered USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM every
"""

#: crc32 of a text of ASCII characters, bit by bit: for each byte its value, then eight steps.
_CRC = "xor(list_reduce(flatten(list_transform(range(1, length({0}) + 1), lambda i: [ascii({0}[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda x, e: CASE WHEN e >= 0 THEN xor(x, e) WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, 4294967295::BIGINT), 4294967295::BIGINT)"
_BASE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_CRC.format('(doc_id::VARCHAR)')} % 7 = 2 AS held_out, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') || [''] AS w FROM documents),
t AS (SELECT r, held_out, unnest(w) AS token FROM d),
c AS (SELECT token, count(*) AS c FROM t WHERE NOT held_out GROUP BY token),
m AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1)::DOUBLE)), 3) AS base_score
FROM t JOIN (SELECT r, doc_id FROM d) USING (r) LEFT JOIN c USING (token), m GROUP BY r, doc_id, held_out
"""

_EDITS_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS u, length(t) // 2 AS half FROM d)
SELECT doc_id, length(t) AS n_chars, sha256(substr(t, 1, length(t) - half) || substr(u, 1, half)) AS edited_sha256 FROM o
"""


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target of each source, of the whole mix."""
    return mixing.mix(table(spark, sf_dir, "documents")).groupBy("source", "source_size", F.round("target", 3).alias("target")).count().drop("count")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op6 and what follows from them alone."""
    return quality.op6_quality_rules(spark, sf_dir).drop("kept")


def subword_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of op5 but the lattice's score; sums are rounded, as their order is free."""
    return subword_lm.op5_subword_lm(spark, sf_dir).drop("score").withColumn("base_score", F.round("base_score", 3))


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edited texts of op4."""
    return fingerprints.op4_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


QUERIES = {"mixing_targets": mixing_targets, "quality_counts": quality_counts, "subword_base": subword_base, "fingerprint_edits": fingerprint_edits}
ORACLE_SQL = {"op3_line_templates": TEMPLATES_SQL, "op7_ngram_join": JOIN_SQL, "mixing_targets": _TARGETS_SQL, "quality_counts": _COUNTS_SQL, "subword_base": _BASE_SQL, "fingerprint_edits": _EDITS_SQL}
