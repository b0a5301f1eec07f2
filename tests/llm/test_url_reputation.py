import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from halyard.llm.url_reputation import OP9_SQL, beta_cdf, host_names, judge_urls, op9_url_reputation, page_outcomes, reputation


def test_rules_and_parts(spark):
    urls = {
        "http://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "https://b.net/x": ("b.net", "/x", "net/", "block"),
        "http://b.net": ("b.net", "", None, "allow"),
        "http://example.com/de/1": ("example.com", "/de/1", "example.com/de/", "block"),
        "http://notexample.com/de/1": ("notexample.com", "/de/1", None, "allow"),
        "x://org/fr/": ("org", "/fr/", "org/fr/", "allow"),
        "http://h.com?a=://b/c": ("h.com", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string").union(spark.createDataFrame([(None, None, None)], "page_id long, url string, host string"))
    none = spark.createDataFrame([], "url string, bad boolean")
    got = judge_urls(pages, none).collect()
    assert len(got) == len(urls) + 1
    by_id = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert [by_id[i] for i in range(len(urls))] == list(urls.values())
    assert judge_urls(pages.limit(0), none).count() == 0


def test_bad_hosts_are_blocked_with_evidence(spark):
    rows = [("bad.x.com", True)] * 30 + [("bad.x.com", False)] * 2 + [("few.x.com", True)] * 2 + [(f"h{i}.y.com", i % 7 == 0) for i in range(80)] + [("good.y.com", False)] * 40
    outcomes = spark.createDataFrame(rows, "host string, bad boolean")
    hosts = spark.createDataFrame([("bad.x.com",), ("few.x.com",), ("good.y.com",), ("new.y.com",), ("a.new.org",), ("",)], "host string")
    got = {r["host"]: r for r in reputation(hosts, outcomes).collect()}
    assert got["bad.x.com"]["blocked"] and not got["good.y.com"]["blocked"] and not got["new.y.com"]["blocked"]
    assert got["good.y.com"]["bad_rate"] < got["new.y.com"]["bad_rate"] < got["few.x.com"]["bad_rate"]
    assert all(r["blocked"] == (r["doubt"] < 0.05) for r in got.values()) and got["few.x.com"]["doubt"] < got["good.y.com"]["doubt"]


def test_the_posterior_by_numeric_integration():
    rng = np.random.default_rng(1)
    a, b = np.r_[rng.uniform(0.05, 5, 20), 300, 2, 40.5, 0, 3], np.r_[rng.uniform(0.05, 5, 20), 280, 900, 0.3, 2, 0]
    u = np.linspace(-400, 400, 400_001)
    log_t, log_1_t = -np.logaddexp(0, -u), -np.logaddexp(0, u)
    for x in (0.2, 0.5, 0.9):
        for p, q, got in zip(a, b, beta_cdf(x, a, b)):
            if p and q:
                f = np.exp(p * log_t + q * log_1_t - (p * log_t + q * log_1_t).max())
                assert abs(got - f[u <= np.log(x / (1 - x))].sum() / f.sum()) < 8e-3
    assert beta_cdf(0.5, [0, 3], [2, 0]).tolist() == [1, 0] and abs(beta_cdf(0.5, [7], [7])[0] - 0.5) < 1e-12


def test_suffixes_and_domains(spark):
    want = {
        "a.b.example.com": ("com", "example.com"), "innocent.co.nz": ("co.nz", "innocent.co.nz"), "x.school.govt.co.nz": ("co.nz", "govt.co.nz"), "co.nz": ("co.nz", "co.nz"), "nz": ("nz", "nz"),
        "a.b.foo.ck": ("foo.ck", "b.foo.ck"), "ck": ("ck", "ck"), "x.www.ck": ("ck", "www.ck"), "u:p@a.co.uk:8080": ("co.uk", "a.co.uk"), "10.1.2.3": ("10.1.2.3", "10.1.2.3"), "[::1]:80": ("[::1]", "[::1]"),
        "": ("", ""), "dot.com.": ("com", "dot.com"), "..": ("", "."), ".".join(["x"] * 5000 + ["org"]): ("org", "x.org"),
    }
    got = {r["host"]: (r["suffix"], r["domain"]) for r in host_names(spark.createDataFrame([(h,) for h in want], "host string")).collect()}
    assert {h: got[h] for h in want if h != ".."} == {h: want[h] for h in want if h != ".."}
    own = host_names(spark.createDataFrame([("a.b.c",)], "host string"), ["b.c"]).first()
    assert (own["suffix"], own["domain"]) == ("b.c", "a.b.c")
    none = host_names(spark.createDataFrame([("a.b.c",)], "host string"), []).first()
    assert (none["suffix"], none["domain"]) == ("c", "b.c")


def test_bad_neighbours_below_a_public_suffix_block_nobody_else(spark):
    rows = [(f"w{i % 3}.evil{i % 4}.co.nz", True) for i in range(200)] + [(f"h{i}.fine.com", i % 9 == 0) for i in range(300)]
    outcomes = spark.createDataFrame(rows, "host string, bad boolean")
    hosts = spark.createDataFrame([("new.evil1.co.nz",), ("innocent.govt.nz",), ("new.fine.com",)], "host string")
    got = {r["host"]: r for r in reputation(hosts, outcomes).collect()}
    assert got["new.evil1.co.nz"]["blocked"] and not got["innocent.govt.nz"]["blocked"] and not got["new.fine.com"]["blocked"]


def test_equally_long_rules_and_long_urls(spark):
    pages = spark.createDataFrame([(1, "http://b.net/x"), (1, "http://b.net/x"), (2, "http://h.com/" + "a/" * 100_000), (3, "x://" + "a." * 50_000 + "net/")], "page_id long, url string")
    rules = [("net/xx", "allow"), ("b.net/", "block"), ("net/x", "allow"), ("b.net/", "allow")]
    got = sorted((r["page_id"], r["rule"] or "-", r["verdict"]) for r in judge_urls(pages, spark.createDataFrame([], "url string, bad boolean"), rules).collect())
    assert got == [(1, "b.net/", "block"), (1, "b.net/", "block"), (2, "-", "allow"), (3, "-", "allow")]


def test_sql_gives_the_same_where_hosts_are_blocked(spark, tmp_path):
    rng = random.Random(3)
    hosts = ["a.bad.co.nz", "b.bad.co.nz", "c.bad.co.nz", "ok.co.nz", "x.good.com", "y.good.com", "z.mixed.org", "www.ck", "q.foo.ck", "10.0.0.1", "u@p.co.uk:81", "only.net"]
    pages, labels = [], []
    for i in range(600):
        host = rng.choice(hosts)
        pages.append((i, rng.choice([f"http://{host}/{rng.choice(['en', 'de', 'fr'])}/{i}?q", f"https://{host}/{i}.html", None if i % 50 == 0 else f"http://{host}"])))
        if rng.random() < 0.6:
            bad = rng.random() < (0.95 if "bad" in host else 0.5 if "mixed" in host else 0.05)
            labels += [(i, int(not bad), None if rng.random() < 0.3 else 0)] * rng.choice([1, 1, 2])
    con = duckdb.connect()
    for name, rows, names in (("pages", pages, ["page_id", "url"]), ("labels", labels, ["doc_id", "quality", "toxic"])):
        pq.write_table(pa.table({n: [r[i] for r in rows] for i, n in enumerate(names)}), tmp_path / f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = sorted(map(repr, con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({OP9_SQL})").fetchall()))
    got = op9_url_reputation(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(repr(tuple(r)) for r in got) == want
    assert {r["verdict"] for r in got if r["host"] == "a.bad.co.nz" and not r["rule"]} == {"block"}
    assert {r["verdict"] for r in got if r["host"] == "ok.co.nz"} == {"allow"}


def test_outcomes_come_from_the_document_in_the_path(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/7.html"), (2, "http://a.com/en/8?x=9"), (3, "http://a.com/"), (4, None)], "page_id long, url string")
    labels = spark.createDataFrame([(7, 0, 0), (7, 1, 0), (8, 1, None), (9, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = sorted((r["url"], r["bad"]) for r in page_outcomes(pages, labels).collect())
    assert got == [("http://a.com/en/7.html", True), ("http://a.com/en/8?x=9", False)]
