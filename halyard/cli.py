"""Commands: gen-data, ground-truth, build, search, info, verify, export, load, serve.

    python -m halyard.cli build --base base.npy --catalog /data/catalog --name a --index hnsw
"""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.catalog import VectorCatalog
from halyard.config import CollectionConfig, GraphParams, SearchParams
from halyard.errors import HalyardError, InvalidInput
from halyard.operators import evaluation, graph
from halyard.operators.collection import VectorCollection
from halyard.operators.search import exact_search, padded
from halyard.operators.validation import duplicate_ids, vector_report
from halyard.sources import indexfile, matrices, synthetic
from halyard.storage import stored


def _rows(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    df = matrices.read_matrix(spark, path)
    return df, matrices.shape_of(path, matrices.kind_of(path)).cols


def _asked(df: DataFrame) -> DataFrame:
    return df.select(F.col("row").alias("qid"), F.col("vector").alias("query"))


def gen_data(spark: SparkSession, a) -> dict:
    spec = synthetic.Mixture(a.dim, a.seed, a.clusters, a.center_range, a.spread, a.mixture_seed)
    return {"rows": matrices.save_matrix(synthetic.synthetic(spark, spec, a.count), a.out)}


def ground_truth(spark: SparkSession, a) -> dict:
    """Writes <out>.ids.npy and <out>.distances.npy, padded with -1 and infinity."""
    base, dim = _rows(spark, a.base)
    queries, _ = _rows(spark, a.queries)
    c = VectorCollection(spark, CollectionConfig(dim, a.metric))
    c.add_batch(base.select(F.col("row").alias("id"), "vector"))
    return {"queries": _save(padded(exact_search(c.rows, _asked(queries), c.config, SearchParams(a.k)), _asked(queries), a.k), a.out), "k": a.k}


def _save(results: DataFrame, out: str) -> int:
    """Writes padded results as <out>.ids.npy and <out>.distances.npy; returns the queries."""
    each = stored(results).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "distance"))).alias("x"))
    n = matrices.save_matrix(each.select("qid", F.transform("x", lambda r: r["id"]).alias("v")), f"{out}.ids.npy", "qid", "v", "<i8")
    matrices.save_matrix(each.select("qid", F.transform("x", lambda r: r["distance"]).alias("v")), f"{out}.distances.npy", "qid", "v")
    return n


def build(spark: SparkSession, a) -> dict:
    base, dim = _rows(spark, a.base)
    batch = base.select(F.col("row").alias("id"), "vector", F.col("row").alias("at"))
    if a.ids:
        ids = matrices.read_ids(spark, a.ids)
        if ids.count() != base.count():
            raise InvalidInput("as many ids as rows are needed")
        batch = base.join(ids, "row").select("id", "vector", F.col("row").alias("at"))
    config = CollectionConfig(dim, a.metric, a.normalize, a.index, GraphParams(m=a.m, ef_construction=a.ef_construction, shards=a.shards))
    catalog, began = VectorCatalog(spark, a.catalog), time.time()
    n = catalog.create(a.name, config).add_batch(batch, order="at")
    return {"rows": n, "generation": catalog.save(a.name), "seconds": round(time.time() - began, 2)}


def search(spark: SparkSession, a) -> dict:
    """Searches a file of queries: all at once, for the rate; some one by one, for latencies. Truth is a prefix of npy files or an ivecs file."""
    c, (queries, _) = VectorCatalog(spark, a.catalog).get(a.name), _rows(spark, a.queries)
    asked = stored(_asked(queries))
    began = time.time()
    found = stored(c.search(asked, a.k, a.ef_search))
    took, n = time.time() - began, queries.count()
    out = {"queries": n, "seconds": round(took, 3), "qps": round(n / took, 1)}
    times = []
    for r in asked.orderBy("qid").limit(a.single).collect():
        began = time.time()
        c.search_one(r["query"], a.k)
        times.append(time.time() - began)
    if times:
        times.sort()
        at = lambda percent: round(1000 * times[evaluation.floor_percentile(percent)(len(times)) - 1], 3)
        out |= {"p50_ms": at(50), "p99_ms": at(99)}
    if a.out:
        _save(padded(found, asked, a.k), a.out)
    if a.gt and a.gt.endswith(".ivecs"):
        truth = matrices.read_matrix(spark, a.gt)
        if truth.count() != n or truth.where(F.size("vector") < a.k).take(1):
            raise InvalidInput(f"{a.gt}: as many rows as queries are needed, with {a.k} ids or more")
        truth = truth.select(F.col("row").alias("qid"), F.posexplode("vector").alias("at", "id")).select("qid", (F.col("at") + 1).alias("rank"), F.col("id").cast("long").alias("id"))
        out["id_overlap"] = evaluation.id_overlap(found, truth, a.k).agg(F.coalesce(F.avg("recall"), F.lit(1.0))).first()[0]
    elif a.gt:
        ids, d = (matrices.read_matrix(spark, f"{a.gt}.{x}.npy").select(F.col("row").alias("qid"), F.posexplode("vector").alias("at", x)) for x in ("ids", "distances"))
        truth = ids.join(d, ["qid", "at"]).select("qid", (F.col("at") + 1).alias("rank"), F.col("ids").alias("id"), F.col("distances").alias("distance"))
        out |= evaluation.recall_summary(found, truth, a.k).first().asDict()
    return out


def export(spark: SparkSession, a) -> dict:
    """Writes a collection as one index file; an hnsw one must have one shard."""
    c = VectorCatalog(spark, a.catalog).get(a.name)
    return {"bytes": indexfile.write_index(c.rows, c.config, a.out, c.graph() if c.config.index == "hnsw" else None)}


def load(spark: SparkSession, a) -> dict:
    """Adds an index file to a catalog; checked as --verify says."""
    meta, rows, g = indexfile.read_index(spark, a.file, a.verify)
    catalog = VectorCatalog(spark, a.catalog)
    c = catalog.create(a.name, meta.config)
    c._commit(rows, meta.rows, (rows.agg(F.max("id")).first()[0] or 0) + 1)
    c._graph = g
    return {"rows": meta.rows, "live": meta.live, "generation": catalog.save(a.name)}


def info(spark: SparkSession, a) -> dict:
    return {r["name"]: r.asDict() for r in VectorCatalog(spark, a.catalog).entries().collect() if a.name in (None, r["name"])}


def verify(spark: SparkSession, a) -> dict:
    """By level: the manifest alone (none), counts against it (metadata), or also all vectors, ids and the rules of the graph (full)."""
    if a.level not in indexfile.VERIFY:
        raise InvalidInput(f"level is one of {', '.join(indexfile.VERIFY)}")
    catalog = VectorCatalog(spark, a.catalog)
    c, manifest = catalog.get(a.name), catalog._manifest(a.name)
    out = {"manifest": manifest is not None}
    if a.level != "none":
        s = c.stats().first()
        out["counts"] = out["manifest"] and (s["rows"], s["live"]) == (manifest["rows"], manifest["live"])
    if a.level == "full":
        out |= {"bad_vectors": vector_report(c.rows, "row_id", "vector", CollectionConfig(c.config.dim)).count(), "duplicate_ids": duplicate_ids(c.live()).count()}
        if c.config.index == "hnsw":
            out["graph_violations"] = graph.violations(c.graph(), c.config.graph).count()
    return out | {"ok": out["manifest"] and out.get("counts", True) and not any(v for k, v in out.items() if k not in ("counts", "manifest"))}


def serve(spark: SparkSession, a) -> dict:
    from halyard import server

    catalog = VectorCatalog(spark, a.catalog)
    http, service = server.serve(catalog, a.port, token=a.token)
    print(f"listening on {http.server_port}", flush=True)
    try:
        while True:
            time.sleep(1)
    except KeyboardInterrupt:
        service.stop()
        http.shutdown()
    return catalog.save_all()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="halyard")
    sub = p.add_subparsers(required=True)

    def command(title, run, /, *needed, **defaults):
        c = sub.add_parser(title)
        c.set_defaults(run=run)
        for x in needed:
            c.add_argument(f"--{x}", required=True, type=int if x in ("dim", "count") else str)
        for x, v in defaults.items():
            flag = f"--{x.replace('_', '-')}"
            if isinstance(v, bool):
                c.add_argument(flag, action="store_true")
            else:
                c.add_argument(flag, default=v, type=type(v) if v is not None else (int if x == "ef_search" else str))

    command("gen-data", gen_data, "out", "dim", "count", seed=1, clusters=100, center_range=1.0, spread=0.1, mixture_seed=42)
    command("ground-truth", ground_truth, "base", "queries", "out", metric="l2", k=100)
    command("build", build, "base", "catalog", "name", ids=None, metric="l2", normalize=False, index="flat", m=16, ef_construction=200, shards=8)
    command("search", search, "catalog", "name", "queries", k=10, ef_search=None, gt=None, out=None, single=20)
    command("info", info, "catalog", name=None)
    command("verify", verify, "catalog", "name", level="full")
    command("export", export, "catalog", "name", "out")
    command("load", load, "catalog", "name", "file", verify="full")
    command("serve", serve, "catalog", port=8080, token=None)
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("halyard").getOrCreate()
    try:
        out = a.run(spark, a)
    except HalyardError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(json.dumps(out))
    return 0 if out.get("ok", True) else 1


if __name__ == "__main__":
    sys.exit(main())
