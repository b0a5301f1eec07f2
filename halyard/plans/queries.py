"""The registered queries of the vector engine, and SQL for each that SQL can express.

Searches take every row whose id is divisible by 20 as a query, against all rows. ``embeddings`` are unit
vectors; where raw vectors matter, each is scaled by one plus its label.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.catalog import VectorCatalog
from halyard.config import CollectionConfig, GraphParams, SearchParams
from halyard.functions import random, vectors
from halyard.operators import evaluation, graph, validation
from halyard.operators.collection import VectorCollection
from halyard.operators.numbering import numbered
from halyard.errors import HalyardError, InvalidInput
from halyard.operators.search import candidates, counts, exact_search, padded, ranked_by_slice, search_expression, search_lateral
from halyard.sources import bodies, indexfile, matrices, synthetic
from halyard.storage import shared_dir, stored
from halyard.streaming.ingest import Ingest

DIM, K = 64, 10
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# --- SQL of the float32 arithmetic, rounding at every step


def _sql_sum(a: str, b: str, term: str) -> str:
    return f"list_reduce(list_transform(list_zip({a}, {b}), lambda z: ({term})::FLOAT), lambda x, y: (x + y)::FLOAT, 0::FLOAT)"


def _l2(a: str, b: str) -> str:
    return _sql_sum(a, b, "(z[1] - z[2]) * (z[1] - z[2])")


def _dot(a: str, b: str) -> str:
    return _sql_sum(a, b, "z[1] * z[2]")


def _inverse(a: str) -> str:
    return f"(1.0 / sqrt({_dot(a, a)}::DOUBLE))::FLOAT"


_SCORES = {
    "l2": _l2("query", "vector"),
    "ip": f"(-{_dot('query', 'vector')} + 0::FLOAT)::FLOAT",
    "cosine_unit": f"greatest(0::FLOAT, (1::FLOAT - ({_dot('query', 'vector')} * inverse)::FLOAT)::FLOAT)",
    "l2_unit": f"greatest(0::FLOAT, (2::FLOAT - (2::FLOAT * ({_dot('query', 'vector')} * inverse)::FLOAT)::FLOAT)::FLOAT)",
    "ip_unit": f"(-({_dot('query', 'vector')} * inverse)::FLOAT + 0::FLOAT)::FLOAT",
}
_RAW = "SELECT vec_id AS row_id, vec_id AS id, embedding AS vector FROM embeddings"
_SCALED = "SELECT vec_id AS row_id, vec_id AS id, list_transform(embedding, lambda x: (x * (1 + label)::FLOAT)::FLOAT) AS vector FROM embeddings"
_ASKED = "SELECT id AS qid, vector AS query FROM base WHERE id % 20 = 0"


def _knn(mode: str, base: str, k: int = K, rows: str = "SELECT * FROM base", select: str = "qid, rank, id, distance", tail: str = "") -> str:
    """SQL of a search of every twentieth row of ``base`` among ``rows``."""
    unit = f"SELECT row_id, id, list_transform(vector, lambda x: (x * inv)::FLOAT) AS vector FROM (SELECT *, {_inverse('vector')} AS inv FROM ({rows}))" if mode.endswith("unit") else rows
    return f"""WITH base AS ({base}), v AS MATERIALIZED ({unit}), q AS MATERIALIZED (SELECT *, {_inverse('query')} AS inverse FROM ({_ASKED})),
d AS (SELECT qid, row_id, id, {_SCORES[mode]} AS distance FROM q, v),
r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY distance, row_id)::INT AS rank, id, distance FROM d QUALIFY rank <= {k})
SELECT {select} FROM r {tail}"""


# --- inputs


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _base(spark: SparkSession, sf_dir: str, scaled: bool = False) -> DataFrame:
    v = F.transform("embedding", lambda x: x * (F.col("label") + 1).cast("float")) if scaled else F.col("embedding")
    return _embeddings(spark, sf_dir).select(F.col("vec_id").alias("id"), v.alias("vector"))


def _asked(base: DataFrame) -> DataFrame:
    return base.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("query"))


def _rows(base: DataFrame, unit: bool = False) -> DataFrame:
    v = vectors.normalize(F.col("vector")) if unit else F.col("vector")
    return base.select(F.col("id").alias("row_id"), "id", v.alias("vector"), F.lit(False).alias("deleted"))


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _search(metric: str, normalize: bool, scaled: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        config, base = CollectionConfig(DIM, metric, normalize), _base(spark, sf_dir, scaled)
        return exact_search(_rows(base, config.normalize), _asked(base), config, SearchParams(K))

    return run


for _name, _metric, _normalize, _is_scaled in (("knn_l2", "l2", False, False), ("knn_ip", "ip", False, True), ("knn_cosine", "cosine", True, True), ("knn_l2_normalized", "l2", True, True), ("knn_ip_normalized", "ip", True, True)):
    _mode = CollectionConfig(DIM, _metric, _normalize).mode
    query(_name, _knn(_mode, _SCALED if _is_scaled else _RAW))(_search(_metric, _normalize, _is_scaled))


@query("knn_single_topk", f"SELECT e.vec_id AS id, {_l2('q.embedding', 'e.embedding')} AS distance FROM embeddings q, embeddings e WHERE q.vec_id = 0 ORDER BY distance, id LIMIT {K}")
def knn_single_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest rows of one query: a top-k report."""
    e = _embeddings(spark, sf_dir)
    q = e.where("vec_id = 0").select(F.col("embedding").alias("query"))
    d = e.join(F.broadcast(q.limit(1))).select(F.col("vec_id").alias("id"), vectors.l2sq(F.col("query"), F.col("embedding")).alias("distance"))
    return d.orderBy("distance", "id").limit(K)


@query("knn_expression", _knn("l2", _RAW))
def knn_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search as plain expressions, ranked with a window group limit."""
    base = _base(spark, sf_dir)
    return search_expression(_rows(base), _asked(base), CollectionConfig(DIM), K)


@query("knn_lateral", _knn("cosine_unit", _SCALED))
def knn_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search as a correlated subquery for each query."""
    base = _base(spark, sf_dir, scaled=True)
    return search_lateral(_rows(base, unit=True), _asked(base), CollectionConfig(DIM, "cosine"), K)


@query("knn_sorted_slice", _knn("l2", _RAW))
def knn_sorted_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking by a sorted slice, over the candidates that the block search leaves of each partition."""
    base = _base(spark, sf_dir)
    return ranked_by_slice(candidates(_rows(base), _asked(base), CollectionConfig(DIM), SearchParams(K)), K)


_TIES = """WITH base AS (SELECT l_orderkey * 10 + l_linenumber AS id, [l_quantity::FLOAT, (l_discount * 100)::FLOAT, (l_tax * 100)::FLOAT] AS vector FROM lineitem),
q AS (SELECT DISTINCT l_quantity::BIGINT AS qid, [l_quantity::FLOAT, 5::FLOAT, 4::FLOAT] AS query FROM lineitem)"""


@query("knn_ties", f"{_TIES}, d AS (SELECT qid, id, {_l2('query', 'vector')} AS distance FROM q, base) SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY distance, id)::INT AS rank, id, distance FROM d QUALIFY rank <= {K}")
def knn_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small whole-number vectors with many equal distances: ties go by insertion order."""
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    v = F.array(F.col("l_quantity").cast("float"), (F.col("l_discount") * 100).cast("float"), (F.col("l_tax") * 100).cast("float"))
    id_ = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long")
    q = item.select(F.col("l_quantity").cast("long").alias("qid"), F.array(F.col("l_quantity").cast("float"), F.lit(5.0).cast("float"), F.lit(4.0).cast("float")).alias("query")).distinct()
    return exact_search(_rows(item.select(id_.alias("id"), v.alias("vector"))), q, CollectionConfig(3), SearchParams(K))


_LABEL0 = "SELECT * FROM base WHERE id IN (SELECT vec_id FROM embeddings WHERE label = 0)"


def _label0(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(results, queries) of a search that asks for more rows than are live."""
    base = _base(spark, sf_dir)
    few = base.join(_embeddings(spark, sf_dir).where("label = 0").select(F.col("vec_id").alias("id")), "id", "left_semi")
    return exact_search(_rows(few), _asked(base), CollectionConfig(DIM), SearchParams(1000)), _asked(base)


@query("knn_batch_padded", f"SELECT q.qid, g.rank::INT AS rank, coalesce(r.id, -1) AS id, coalesce(r.distance, 'inf'::FLOAT) AS distance FROM (SELECT vec_id AS qid FROM embeddings WHERE vec_id % 20 = 0) q CROSS JOIN range(1, 1001) g(rank) LEFT JOIN ({_knn('l2', _RAW, 1000, _LABEL0)}) r ON r.qid = q.qid AND r.rank = g.rank")
def knn_batch_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return padded(*_label0(spark, sf_dir), 1000)


@query("knn_counts", _knn("l2", _RAW, 1000, _LABEL0, "qid, count(*) AS n", "GROUP BY qid"))
def knn_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(*_label0(spark, sf_dir))


@query("knn_join_metadata", _knn("l2", _RAW, K, "SELECT * FROM base", "qid, rank, id, distance, label", "JOIN embeddings ON vec_id = id"))
def knn_join_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = QUERIES["knn_l2"](spark, sf_dir)
    return found.join(_embeddings(spark, sf_dir).select(F.col("vec_id").alias("id"), "label"), "id").select("qid", "rank", "id", "distance", "label")


# --- mutations


def _collection(spark: SparkSession, sf_dir: str, **config) -> VectorCollection:
    c = VectorCollection(spark, CollectionConfig(DIM, **config))
    c.add_batch(_base(spark, sf_dir))
    return c


def _third(base: DataFrame) -> DataFrame:
    return base.where("id % 3 = 0").select("id")


_LEFT = "SELECT * FROM base WHERE id % 3 <> 0"


@query("knn_after_remove", _knn("l2", _RAW, K, _LEFT))
def knn_after_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, base = _collection(spark, sf_dir), _base(spark, sf_dir)
    c.remove(_third(base))
    return c.search(_asked(base), K)


@query("knn_after_compact", _knn("l2", _RAW, K, _LEFT))
def knn_after_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, base = _collection(spark, sf_dir), _base(spark, sf_dir)
    c.remove(_third(base))
    c.compact()
    return c.search(_asked(base), K)


_DOUBLED = "SELECT CASE WHEN id % 7 = 0 THEN row_id + 1000000000 ELSE row_id END AS row_id, id, CASE WHEN id % 7 = 0 THEN list_transform(vector, lambda x: (x * 2::FLOAT)::FLOAT) ELSE vector END AS vector FROM base"


@query("knn_after_upsert", _knn("l2", _RAW, K, _DOUBLED))
def knn_after_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, base = _collection(spark, sf_dir), _base(spark, sf_dir)
    c.add_batch(base.where("id % 7 = 0").select("id", F.transform("vector", lambda x: x * F.lit(2.0).cast("float")).alias("vector")), upsert=True)
    return c.search(_asked(base), K)


@query("collection_stats", "SELECT count(*) FILTER (WHERE vec_id % 3 <> 0) AS live, count(*) FILTER (WHERE vec_id % 3 = 0) AS deleted, count(*) AS rows FROM embeddings")
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _collection(spark, sf_dir)
    c.remove(_third(_base(spark, sf_dir)))
    return c.stats()


@query("compact_stats", "SELECT count(*) AS rows_before, count(*) FILTER (WHERE vec_id % 3 = 0) AS removed_rows, count(*) FILTER (WHERE vec_id % 3 <> 0) AS rows_after FROM embeddings")
def compact_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _collection(spark, sf_dir)
    c.remove(_third(_base(spark, sf_dir)))
    return spark.createDataFrame([c.compact()], "rows_before long, removed_rows long, rows_after long")


@query("auto_ids", "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, vec_id AS tag FROM embeddings")
def auto_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by the collection's counter, in the order of a column."""
    c = VectorCollection(spark, CollectionConfig(DIM))
    c.add_batch(_base(spark, sf_dir).select("vector", F.col("id").alias("tag")), order="tag")
    tags = numbered(_embeddings(spark, sf_dir).select(F.col("vec_id").alias("tag")), ["tag"], "at")
    return c.rows.select("id", F.col("row_id").alias("at")).join(tags, "at").select("id", "tag")


@query("live_count", "SELECT count(*) AS n FROM embeddings")
def live_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_base(spark, sf_dir)).where("not deleted").agg(F.count("*").alias("n"))


def _components(df: DataFrame, key: str, vector: str) -> DataFrame:
    """A row for each component, from 0."""
    return df.select(key, F.posexplode(vector).alias("at", "x"))


def _sql_components(key: str, vector: str, source: str) -> str:
    return f"SELECT {key}, unnest(range(len({vector})))::INT AS at, unnest({vector}) AS x FROM ({source})"


@query("point_get", _sql_components("id", "vector", f"SELECT * FROM ({_RAW}) WHERE id = 7"))
def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(_rows(_base(spark, sf_dir)).where("id = 7 and not deleted"), "id", "vector")


@query("contains_batch", "SELECT g.id, e.vec_id IS NOT NULL AS found FROM (SELECT vec_id * 2 AS id FROM embeddings) g LEFT JOIN embeddings e ON e.vec_id = g.id")
def contains_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _base(spark, sf_dir)
    return VectorCollection(spark, CollectionConfig(DIM), _rows(base)).contains(base.select((F.col("id") * 2).alias("id")))


# --- scalar functions, on each vector and the one after it

_NEXT = "FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _embeddings(spark, sf_dir)
    return e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")


def _scalars() -> None:
    makers = {
        "vector_dot": (lambda: vectors.dot(F.col("a"), F.col("b")), _dot("a.embedding", "b.embedding")),
        "vector_l2sq": (lambda: vectors.l2sq(F.col("a"), F.col("b")), _l2("a.embedding", "b.embedding")),
        "vector_norm2": (lambda: vectors.norm2(F.col("a")), _dot("a.embedding", "a.embedding")),
        "vector_distance_ip": (lambda: vectors.distance("ip", F.col("a"), F.col("b")), f"(-{_dot('a.embedding', 'b.embedding')} + 0::FLOAT)::FLOAT"),
        "vector_distance_cosine": (lambda: vectors.distance("cosine", F.col("a"), F.col("b")), f"(1.0::DOUBLE - {_dot('a.embedding', 'b.embedding')}::DOUBLE / (sqrt({_dot('a.embedding', 'a.embedding')}::DOUBLE) * sqrt({_dot('b.embedding', 'b.embedding')}::DOUBLE)))::FLOAT"),
    }
    for name, (make, sql) in makers.items():

        def run(spark: SparkSession, sf_dir: str, make=make) -> DataFrame:
            return _pairs(spark, sf_dir).select("vec_id", make().alias("value"))

        query(name, f"SELECT a.vec_id, {sql} AS value {_NEXT}")(run)


_scalars()


@query("vector_normalize", _sql_components("vec_id", "unit", f"SELECT vec_id, list_transform(vector, lambda x: (x * inv)::FLOAT) AS unit FROM (SELECT id AS vec_id, vector, {_inverse('vector')} AS inv FROM ({_SCALED}))"))
def vector_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(_base(spark, sf_dir, scaled=True).select(F.col("id").alias("vec_id"), vectors.normalize(F.col("vector")).alias("unit")), "vec_id", "unit")


@query("vector_sql_functions", f"SELECT a.vec_id, {_l2('a.embedding', 'b.embedding')} AS value {_NEXT}")
def vector_sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors.register(spark)
    return _pairs(spark, sf_dir).selectExpr("vec_id", "vector_l2sq(a, b) AS value")


# --- validation


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector, some made too short, not a number, or too large."""
    bad = F.when(F.col("vec_id") % 11 == 0, F.slice("embedding", 1, 63)).when(F.col("vec_id") % 11 == 1, F.concat(F.slice("embedding", 1, 63), F.array(F.lit(float("nan")).cast("float")))).when(F.col("vec_id") % 11 == 2, F.concat(F.array(F.lit(1e17).cast("float")), F.slice("embedding", 2, 63))).otherwise(F.col("embedding"))
    return _embeddings(spark, sf_dir).select(F.col("vec_id").alias("id"), bad.alias("vector"))


@query("validate_batch_report", "SELECT vec_id AS id, CASE vec_id % 11 WHEN 0 THEN 1 ELSE 2 END AS code, CASE vec_id % 11 WHEN 1 THEN 63 WHEN 2 THEN 0 ELSE -1 END::INT AS position, CASE vec_id % 11 WHEN 0 THEN 'vector does not have 64 components' WHEN 1 THEN 'component is NaN' ELSE 'component is larger than 1e+16' END AS problem FROM embeddings WHERE vec_id % 11 < 3")
def validate_batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = validation.vector_report(_damaged(spark, sf_dir), "id", "vector", CollectionConfig(DIM))
    return report.withColumn("position", F.coalesce("position", F.lit(-1)))


@query("invalid_components", "SELECT vec_id AS id, CASE vec_id % 11 WHEN 1 THEN 63 ELSE 0 END::INT AS position FROM embeddings WHERE vec_id % 11 IN (1, 2)")
def invalid_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _damaged(spark, sf_dir).select("id", vectors.invalid_component(F.col("vector")).alias("position")).where("position is not null")


@query("duplicate_ids", "SELECT label::BIGINT AS id, count(*) AS n FROM embeddings GROUP BY label HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.duplicate_ids(_embeddings(spark, sf_dir).select(F.col("label").cast("long").alias("id")))


@query("existing_ids", "SELECT vec_id * 2 AS id FROM embeddings WHERE vec_id * 2 IN (SELECT vec_id FROM embeddings)")
def existing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _base(spark, sf_dir)
    return validation.existing_ids(base.select((F.col("id") * 2).alias("id")), base)


# --- evaluation: the approximate side is an exact search that misses every third row


def _approximate(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base, config = _base(spark, sf_dir), CollectionConfig(DIM)
    found = exact_search(_rows(base.where("id % 3 <> 0")), _asked(base), config, SearchParams(K))
    return stored(found), stored(exact_search(_rows(base), _asked(base), config, SearchParams(K)))


_BOTH = f"WITH t AS ({_knn('l2', _RAW)}), a AS ({_knn('l2', _RAW, K, _LEFT)})"


@query("recall_tie_tolerant", f"{_BOTH}, k AS (SELECT qid, count(*) AS n, max(distance)::DOUBLE AS kth FROM t GROUP BY qid), h AS (SELECT a.qid, count(*) AS hits FROM a JOIN k USING (qid) LEFT JOIN t ON t.qid = a.qid AND t.id = a.id WHERE t.id IS NOT NULL OR a.distance::DOUBLE <= kth + 1e-6 * greatest(1.0, abs(kth)) GROUP BY a.qid) SELECT qid, least(1.0::DOUBLE, coalesce(hits, 0) / n::DOUBLE) AS recall FROM k LEFT JOIN h USING (qid)")
def recall_tie_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.recall_by_query(*_approximate(spark, sf_dir), K)


@query("recall_id_overlap", f"{_BOTH} SELECT t.qid, count(a.id) / {K}::DOUBLE AS recall FROM t LEFT JOIN a ON a.qid = t.qid AND a.id = t.id GROUP BY t.qid")
def recall_id_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.id_overlap(*_approximate(spark, sf_dir), K)


@query("latency_percentiles", "SELECT list_sort(list(value))[floor(0.5 * (count(value) - 1))::INT + 1] AS p50, list_sort(list(value))[floor(0.99 * (count(value) - 1))::INT + 1] AS p99, list_sort(list(value))[greatest(1, ceil(0.95 * count(value)))::INT] AS rank95 FROM events")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = {"p50": evaluation.floor_percentile(50), "p99": evaluation.floor_percentile(99), "rank95": evaluation.nearest_rank(95)}
    return evaluation.at_ranks(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", ranks)


@query("sweep_pareto", "SELECT s.* FROM (SELECT c_nationkey AS recall, c_custkey AS qps FROM customer) s WHERE NOT EXISTS (SELECT 1 FROM customer t WHERE t.c_nationkey >= s.recall AND t.c_custkey >= s.qps AND (t.c_nationkey > s.recall OR t.c_custkey > s.qps))")
def sweep_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that no other beats in both of two measures."""
    return evaluation.pareto_front(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").alias("recall"), F.col("c_custkey").alias("qps")))


# --- graphs


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, CollectionConfig]:
    base, config = _base(spark, sf_dir), CollectionConfig(DIM, index="hnsw", graph=GraphParams(shards=8))
    return graph.build(_rows(base), config), _asked(base), config


_TWO64 = f"{1 << 64}::UHUGEINT"


def _sql_mixed(source: str, column: str, tag: str) -> str:
    """SQL of three steps of splitmix64 on ``column`` (below 2**64) of ``source``; ``{tag}3`` has (node, z)."""
    shifted = lambda bits: f"xor(z, z // {1 << bits}::UHUGEINT)"
    return f"""{tag}0 AS (SELECT node, ({column} + {random.STEP}::UHUGEINT) % {_TWO64} AS z FROM {source}),
{tag}1 AS (SELECT node, ({shifted(30)} * {random.MIX_A}::UHUGEINT) % {_TWO64} AS z FROM {tag}0),
{tag}2 AS (SELECT node, ({shifted(27)} * {random.MIX_B}::UHUGEINT) % {_TWO64} AS z FROM {tag}1),
{tag}3 AS (SELECT node, {shifted(31)} AS z FROM {tag}2)"""


_BOUND = f"{1 << 53}::UHUGEINT // (z // {1 << 11}::UHUGEINT + 1::UHUGEINT)"
_POWERS = " + ".join(f"(b >= {16**k}::UHUGEINT)::INT" for k in range(1, 14))


def _sql_levels(node: str) -> str:
    return f"""WITH n AS (SELECT {node} AS node, ({node})::UHUGEINT AS z FROM embeddings), {_sql_mixed("n", "z", "a")},
m AS (SELECT node, xor(z, {GraphParams().seed}::UHUGEINT) AS z FROM a3), {_sql_mixed("m", "z", "c")}
SELECT node, ({_POWERS})::INT AS level FROM (SELECT node, {_BOUND} AS b FROM c3)"""



@query("hnsw_levels", _sql_levels("vec_id"))
def hnsw_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, level): the top level that each row number would have in one graph."""
    p = GraphParams()

    @F.pandas_udf("int")
    def level(nodes):
        import pandas as pd

        return pd.Series(random.levels(nodes.to_numpy(), p.seed, p.m, p.max_level))

    return _embeddings(spark, sf_dir).select(F.col("vec_id").alias("node"), level("vec_id").alias("level"))


@query("hnsw_level_histogram", f"SELECT g.level::INT AS level, count(l.node) AS n FROM range(17) g(level) LEFT JOIN ({_sql_levels('vec_id // 8')}) l ON l.level = g.level GROUP BY g.level")
def hnsw_level_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.level_histogram(_graph(spark, sf_dir)[0], GraphParams().max_level)


@query("hnsw_knn_exhaustive", _knn("l2", _RAW))
def hnsw_knn_exhaustive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A beam as wide as the shard finds what the exact search finds."""
    g, asked, config = _graph(spark, sf_dir)
    return graph.graph_search(g, asked, config, SearchParams(K, max(K, g.count())))


@query("hnsw_knn_default")
def hnsw_knn_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, asked, config = _graph(spark, sf_dir)
    return graph.graph_search(g, asked, config, SearchParams(K))


@query("hnsw_recall", "SELECT (SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0) AS queries, true AS at_least_95")
def hnsw_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the default beam reaches a mean recall of 0.95."""
    g, asked, config = _graph(spark, sf_dir)
    found = stored(graph.graph_search(g, asked, config, SearchParams(K)))
    return evaluation.recall_summary(found, QUERIES["knn_l2"](spark, sf_dir), K).select("queries", (F.col("mean_recall") >= 0.95).alias("at_least_95"))


@query("hnsw_invariants", "SELECT 0 AS violations")
def hnsw_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, _, config = _graph(spark, sf_dir)
    return graph.violations(g, config.graph).agg(F.count("*").cast("int").alias("violations"))


@query("hnsw_reachability", "SELECT 0::BIGINT AS unreachable")
def hnsw_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.unreachable(_graph(spark, sf_dir)[0]).agg(F.sum("n").alias("unreachable"))


@query("hnsw_build_counters", "SELECT s.shard::INT AS shard, count(e.vec_id) AS nodes, true AS computed, 0::BIGINT AS unrepaired FROM range(8) s(shard) LEFT JOIN embeddings e ON e.vec_id % 8 = s.shard GROUP BY s.shard HAVING count(e.vec_id) > 0")
def hnsw_build_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the build of each shard counted: distances were computed, and no node stayed without a link."""
    return graph.build_counters(_graph(spark, sf_dir)[0]).select("shard", "nodes", (F.col("computed") > F.col("nodes")).alias("computed"), "unrepaired")


@query("hnsw_canonical", "SELECT (vec_id % 8)::INT AS shard, true AS equal FROM embeddings GROUP BY 1")
def hnsw_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two builds, of rows dealt in different ways, have the same canonical bytes."""
    one, _, config = _graph(spark, sf_dir)
    other = graph.build(_rows(_base(spark, sf_dir).repartition(7)), config)
    found = [graph.canonical(g, config.graph).select("shard", F.sha2("bytes", 256).alias(name)) for g, name in ((one, "a"), (other, "b"))]
    return found[0].join(found[1], "shard").select("shard", (F.col("a") == F.col("b")).alias("equal"))


# --- sources, storage, streaming


def _file(spark: SparkSession, suffix: str) -> str:
    """A path in the shared folder for a file that is opened by its path, which the folder has to allow."""
    import os

    at = shared_dir(spark)
    if "://" in at and not at.startswith("file://"):
        raise InvalidInput("matrix and index files need a shared folder that is mounted")
    at = "/" + at.removeprefix("file:").lstrip("/")
    os.makedirs(at, exist_ok=True)
    return f"{at}/{uuid.uuid4().hex}.{suffix}"


def _round_trip(suffix: str) -> None:
    @query(f"{suffix}_roundtrip", _sql_components("row", "embedding", "SELECT vec_id AS row, embedding FROM embeddings"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _file(spark, suffix)
        matrices.save_matrix(_embeddings(spark, sf_dir), path, "vec_id", "embedding")
        return _components(matrices.read_matrix(spark, path), "row", "vector")


_round_trip("npy")
_round_trip("fvecs")


@query("ivecs_truth_roundtrip", f"SELECT qid, rank - 1 AS at, id::INT AS x FROM ({_knn('l2', _RAW)})")
def ivecs_truth_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of a search, written as a truth file and read again."""
    ids = QUERIES["knn_l2"](spark, sf_dir).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("x"))
    path = _file(spark, "ivecs")
    matrices.save_matrix(ids.select("qid", F.transform("x", lambda r: r["id"]).alias("ids")), path, "qid", "ids")
    return _components(matrices.read_matrix(spark, path).select((F.col("row") * 20).alias("qid"), "vector"), "qid", "vector")


@query("ids_roundtrip", "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, vec_id AS id FROM embeddings")
def ids_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External ids, written as a one-dimensional file and read again."""
    path = _file(spark, "npy")
    matrices.save_matrix(_embeddings(spark, sf_dir).select("vec_id", F.array("vec_id").alias("ids")), path, "vec_id", "ids", "<i8")
    return matrices.read_ids(spark, path)


_GONE = "SELECT row_id, id, vector FROM base WHERE id % 3 <> 0"


@query("index_file_knn", _knn("cosine_unit", _SCALED, K, _GONE))
def index_file_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection with deleted rows, written as an index file, read again with all checks, and searched."""
    base, config = _base(spark, sf_dir, scaled=True), CollectionConfig(DIM, "cosine")
    rows = _rows(base, unit=True).withColumn("deleted", F.col("id") % 3 == 0)
    # a file numbers its rows from 0
    path, rows = _file(spark, "index"), numbered(rows.drop("row_id"), ["id"], "row_id")
    indexfile.write_index(rows, config, path)
    return exact_search(indexfile.read_index(spark, path)[1], _asked(base), config, SearchParams(K))


@query("index_file_graph", "SELECT true AS equal, true AS same_bytes")
def index_file_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a graph that goes through an index file keeps its canonical bytes, and a second file has those of the first."""
    config = CollectionConfig(DIM, index="hnsw", graph=GraphParams(ef_construction=40, shards=1))
    rows = numbered(_rows(_base(spark, sf_dir)).drop("row_id"), ["id"], "row_id")
    g, paths = graph.build(rows, config), [_file(spark, "index") for _ in range(2)]
    indexfile.write_index(rows, config, paths[0], g)
    meta, again, h = indexfile.read_index(spark, paths[0])
    indexfile.write_index(again, meta.config, paths[1], h)
    digest = lambda g: graph.canonical(g, config.graph).select(F.sha2("bytes", 256)).first()[0]
    same = [open(p, "rb").read() for p in paths]
    return spark.createDataFrame([(digest(g) == digest(h), same[0] == same[1])], "equal boolean, same_bytes boolean")


@query("checksum_values", "SELECT * FROM (VALUES ('123456789', 3808858755::BIGINT), ('', 0::BIGINT), ('a', 3251651376::BIGINT)) t(text, crc32c)")
def checksum_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRC-32C of published check values."""
    return spark.createDataFrame([(t, indexfile.crc32c(t.encode())) for t in ("123456789", "", "a")], "text string, crc32c long")


@query("packed_bodies", _sql_components("id", "vector", _RAW))
def packed_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors packed into request bodies, one for each label, and decoded again."""

    def pack(table):
        import numpy as np
        import pyarrow as pa

        body = bodies.pack(np.array(table.column("vec_id").to_pylist()), np.array(table.column("embedding").to_pylist(), np.float32))
        return pa.table({"content": pa.array([body], pa.binary())})

    packed = _embeddings(spark, sf_dir).groupBy("label").applyInArrow(pack, "content binary")
    return _components(bodies.packed_vectors(packed), "id", "vector")


@query("batch_rules", "SELECT * FROM (VALUES ('sound', 'added 2'), ('twice', 'InvalidInput'), ('reserved', 'InvalidInput'), ('negative', 'InvalidInput'), ('null', 'InvalidInput'), ('short', 'InvalidInput'), ('exists', 'DuplicateId'), ('upsert', 'added 1')) t(batch, outcome)")
def batch_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of batches that break a rule, in a collection that has id 1."""
    c, out = VectorCollection(spark, CollectionConfig(2)), []
    cases = [("sound", [(1, [1.0, 2.0]), (2, [0.0, 1.0])]), ("twice", [(5, [1.0, 2.0])] * 2), ("reserved", [(-1, [1.0, 2.0])]), ("negative", [(-7, [1.0, 2.0])]), ("null", [(None, [1.0, 2.0])]), ("short", [(6, [1.0])]), ("exists", [(1, [1.0, 2.0])]), ("upsert", [(1, [3.0, 2.0])])]
    for name, rows in cases:
        try:
            outcome = f"added {c.add_batch(spark.createDataFrame(rows, 'id long, vector array<float>'), upsert=name == 'upsert')}"
        except HalyardError as e:
            outcome = type(e).__name__
        out.append((name, outcome))
    return spark.createDataFrame(out, "batch string, outcome string")


@query("vector_sql_distances", f"SELECT a.vec_id, (-{_dot('a.embedding', 'b.embedding')} + 0::FLOAT)::FLOAT AS ip, (1.0::DOUBLE - {_dot('a.embedding', 'b.embedding')}::DOUBLE / (sqrt({_dot('a.embedding', 'a.embedding')}::DOUBLE) * sqrt({_dot('b.embedding', 'b.embedding')}::DOUBLE)))::FLOAT AS cosine, (a.embedding[1] * {_inverse('a.embedding')})::FLOAT AS first {_NEXT}")
def vector_sql_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors.register(spark)
    return _pairs(spark, sf_dir).selectExpr("vec_id", "vector_ip_distance(a, b) AS ip", "vector_cosine_distance(a, b) AS cosine", "vector_normalize(a)[0] AS first")


@query("synthetic_mixture")
def synthetic_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many seeded vectors as there are embeddings."""
    return synthetic.synthetic(spark, synthetic.Mixture(16), _embeddings(spark, sf_dir).count())


@query("synthetic_uniform")
def synthetic_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.uniform(spark, 16, _embeddings(spark, sf_dir).count())


@query("stream_ingest_final", _knn("l2", _RAW))
def stream_ingest_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of files ends in the same collection as one batch."""
    e, c = _embeddings(spark, sf_dir), VectorCollection(spark, CollectionConfig(DIM))
    files = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    e.write.parquet(files)
    stream = spark.readStream.schema(e.schema).parquet(files).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    Ingest(c).start(stream, f"{shared_dir(spark)}/{uuid.uuid4().hex}").awaitTermination()
    rows = c.rows.withColumn("row_id", F.col("id"))  # files arrive in any order
    return exact_search(rows, _asked(_base(spark, sf_dir)), c.config, SearchParams(K))


@query("snapshot_reload_knn", _knn("cosine_unit", _SCALED))
def snapshot_reload_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, base = f"{shared_dir(spark)}/{uuid.uuid4().hex}", _base(spark, sf_dir, scaled=True)
    catalog = VectorCatalog(spark, root)
    catalog.create("vectors", CollectionConfig(DIM, "cosine")).add_batch(base)
    catalog.save("vectors")
    return VectorCatalog(spark, root).get("vectors").search(_asked(base), K)


@query("catalog_entries", "SELECT name, 64 AS dim, 'l2' AS metric, 'flat' AS index, g AS generation, n AS rows, n AS live FROM (SELECT 'a' AS name, 1::BIGINT AS g, count(*) AS n FROM embeddings UNION ALL SELECT 'b', 0, 0)")
def catalog_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = VectorCatalog(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}")
    catalog.create("b", CollectionConfig(DIM))
    catalog.create("a", CollectionConfig(DIM)).add_batch(_base(spark, sf_dir))
    catalog.save("a")
    return catalog.entries()
