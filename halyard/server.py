"""A thin HTTP front for a catalog, on the standard library's server.

Requests are JSON (or packed bodies for bulk inserts). Mutations of a collection run one at a time;
searches run beside them over the version that was current when they began.
"""

from __future__ import annotations

import hmac
import json
import re
import sys
import threading
import time
import uuid
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from halyard import __version__
from halyard.catalog import VectorCatalog
from halyard.config import CollectionConfig, GraphParams
from halyard.errors import AlreadyExists, CapacityExceeded, Corrupt, DuplicateId, InvalidInput, NotFound, Unsupported
from halyard.sources.bodies import unpack

#: Limits of a request; beyond those after the first the answer is 422.
MAX_BODY, MAX_BATCH, MAX_K, MAX_BEAM, MAX_DIM, MAX_DEPTH = 64 << 20, 10_000, 1_000, 4_096, 65_536, 8
#: Upper bounds of the time histogram, in seconds.
TIMES = (0.00005, 0.0001, 0.00025, 0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


class Refused(Exception):
    def __init__(self, status: int, code: str, message: str):
        super().__init__(message)
        self.status, self.code = status, code


def _depth(x, at: int = 1) -> int:
    inner = x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()
    return max((_depth(y, at + 1) for y in inner if isinstance(y, (dict, list))), default=at)


def fields(body, allowed: set[str], needed: set[str]) -> dict:
    """``body`` if it is an object with only ``allowed`` keys and all ``needed`` ones."""
    if not isinstance(body, dict):
        raise Refused(400, "INVALID_ARGUMENT", "the body must be an object")
    if unknown := set(body) - allowed:
        raise Refused(400, "INVALID_ARGUMENT", f"unknown key {min(unknown)}")
    if missing := needed - set(body):
        raise Refused(400, "INVALID_ARGUMENT", f"missing key {min(missing)}")
    return body


def vector_of(x, dim: int) -> list[float]:
    if not isinstance(x, list) or any(isinstance(v, bool) or not isinstance(v, (int, float)) for v in x):
        raise Refused(400, "INVALID_ARGUMENT", "a vector is a list of numbers")
    if len(x) != dim:
        raise Refused(400, "DIMENSION_MISMATCH", f"vector has {len(x)} components, expected {dim}")
    return [float(v) for v in x]


def limit(name: str, value, most: int) -> int:
    if not isinstance(value, int) or isinstance(value, bool) or value < 1:
        raise Refused(400, "INVALID_ARGUMENT", f"{name} must be a positive integer")
    if value > most:
        raise Refused(422, "LIMIT_EXCEEDED", f"{name} is above {most}")
    return value


def logfmt(level: str, event: str, **fields) -> str:
    """One line of key=value pairs; values with spaces, quotes, equals signs or control characters are quoted."""
    def value(x) -> str:
        text = str(x)
        return text if re.fullmatch(r'[^\s"=\\\x00-\x1f]+', text) else json.dumps(text, ensure_ascii=False)

    stamp = time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime())
    return " ".join([f"time={stamp}Z", f"level={level}", f"event={value(event)}", *(f"{k}={value(v)}" for k, v in fields.items())])


class Service:
    """What the routes do; each returns (status, answer)."""

    def __init__(self, catalog: VectorCatalog, token: str | None = None):
        self.catalog, self.token, self.began, self.ready = catalog, token, time.time(), True
        self.locks: dict[str, threading.Lock] = {}
        self.counts: Counter = Counter()
        self.times, self.seconds, self.running = [0] * (len(TIMES) + 1), 0.0, 0
        self.guard = threading.Condition()
        self.log = lambda line: print(line, file=sys.stderr, flush=True)

    def stop(self, most: float = 30.0) -> bool:
        """Refuses new requests and waits for those that run, ``most`` seconds; whether all have ended."""
        self.ready = False
        with self.guard:
            return self.guard.wait_for(lambda: not self.running, most)

    def began_one(self) -> None:
        with self.guard:
            self.running += 1

    def ended_one(self, method: str, route: str, status: int, took: float, request: str) -> None:
        with self.guard:
            self.running -= 1
            self.counts[method, route, status // 100] += 1
            self.times[next((i for i, b in enumerate(TIMES) if took <= b), len(TIMES))] += 1
            self.seconds += took
            self.guard.notify_all()
        self.log(logfmt("error" if status >= 500 else "info", "request", method=method, route=route, status=status, ms=round(1000 * took, 3), request_id=request))

    def _lock(self, name: str) -> threading.Lock:
        with self.guard:
            return self.locks.setdefault(name, threading.Lock())

    def _describe(self, name: str) -> dict:
        c = self.catalog.get(name)
        return {"name": name, "dim": c.config.dim, "metric": c.config.metric, "normalize": c.config.normalize, "index": c.config.index, "count": c.size()}

    def health(self, **_):
        return 200, {"status": "ok"}

    def readiness(self, **_):
        return (200, {"status": "ready"}) if self.ready else (503, {"status": "stopping"})

    def status(self, **_):
        return 200, {"version": __version__, "uptime_s": round(time.time() - self.began, 3), "collections": len(self.catalog.names()), "spark": self.catalog.spark.version}

    def metrics(self, **_):
        lines = [f'http_requests_total{{method="{m}",route="{r}",status="{s}xx"}} {n}' for (m, r, s), n in sorted(self.counts.items())]
        total = 0
        for bound, n in zip((*TIMES, "+Inf"), self.times):
            total += n
            lines.append(f'http_request_seconds_bucket{{le="{bound}"}} {total}')
        lines += [f"http_request_seconds_sum {self.seconds:.6f}", f"http_request_seconds_count {total}", f"http_requests_running {self.running}", f"uptime_seconds {time.time() - self.began:.3f}"]
        return 200, "\n".join([*lines, ""])

    def create(self, body, **_):
        body = fields(body, {"name", "dim", "metric", "normalize", "index"}, {"name", "dim"})
        index = fields(body.get("index", {}), {"type", "M", "ef_construction", "ef_search", "max_level", "seed", "shards"}, set())
        graph = {{"M": "m"}.get(k, k): v for k, v in index.items() if k != "type"}
        limit("dim", body["dim"], MAX_DIM)
        config = CollectionConfig(body["dim"], body.get("metric", "l2"), bool(body.get("normalize", False)), index.get("type", "hnsw"), GraphParams(**graph))
        with self._lock(str(body["name"])):
            self.catalog.create(str(body["name"]), config)
        return 201, self._describe(body["name"])

    def list(self, **_):
        return 200, {"collections": [self._describe(n) for n in self.catalog.names()]}

    def describe(self, name, **_):
        return 200, self._describe(name)

    def drop(self, name, **_):
        with self._lock(name):
            self.catalog.drop(name)
        return 200, {"dropped": name}

    def _insert(self, name, rows, upsert):
        if len(rows) > MAX_BATCH:
            raise Refused(422, "LIMIT_EXCEEDED", f"more than {MAX_BATCH} vectors")
        frame = self.catalog.spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "id long, vector array<float>, at long")
        with self._lock(name):
            return 200, {"inserted": self.catalog.get(name).add_batch(frame, upsert, "at")}

    def insert(self, name, body, **_):
        body = fields(body, {"upsert", "vectors"}, {"vectors"})
        dim = self.catalog.get(name).config.dim
        if not isinstance(body["vectors"], list):
            raise Refused(400, "INVALID_ARGUMENT", "vectors must be a list")
        rows = [fields(r, {"id", "vector"}, {"id", "vector"}) for r in body["vectors"]]
        if any(not isinstance(r["id"], int) or isinstance(r["id"], bool) or r["id"] < 0 for r in rows):
            raise Refused(400, "INVALID_ARGUMENT", "ids are integers from 0")
        if any(r["id"] >= 1 << 63 for r in rows):
            raise Refused(400, "INVALID_ARGUMENT", "ids are below 2**63")
        if not isinstance(body.get("upsert", False), bool):
            raise Refused(400, "INVALID_ARGUMENT", "upsert is true or false")
        return self._insert(name, [(r["id"], vector_of(r["vector"], dim)) for r in rows], body.get("upsert", False))

    def bulk(self, name, raw, query, **_):
        ids, rows = unpack(raw)
        if rows.shape[1] != self.catalog.get(name).config.dim:
            raise Refused(400, "DIMENSION_MISMATCH", f"vectors have {rows.shape[1]} components")
        return self._insert(name, [(int(i), [float(x) for x in v]) for i, v in zip(ids, rows)], query.get("upsert") == ["true"])

    def get(self, name, id, **_):
        return 200, {"id": int(id), "vector": list(self.catalog.get(name).get(int(id)))}

    def delete(self, name, id, **_):
        with self._lock(name):
            self.catalog.get(name).remove([int(id)])
        return 200, {"deleted": int(id)}

    def _search(self, name, vectors, body):
        k, ef = limit("k", body.get("k", 10), MAX_K), body.get("ef_search")
        ef = limit("ef_search", ef, MAX_BEAM) if ef is not None else None
        c, began = self.catalog.get(name), time.time()
        asked = self.catalog.spark.createDataFrame([(i, vector_of(v, c.config.dim)) for i, v in enumerate(vectors)], "qid long, query array<float>")
        out: list[list] = [[] for _ in vectors]
        for r in c.search(asked, k, ef).orderBy("qid", "rank").collect():
            out[r["qid"]].append({"id": r["id"], "distance": r["distance"]})
        return out, round(1000 * (time.time() - began), 3)

    def search(self, name, body, **_):
        body = fields(body, {"vector", "k", "ef_search"}, {"vector"})
        out, took = self._search(name, [body["vector"]], body)
        return 200, {"results": out[0], "took_ms": took}

    def search_batch(self, name, body, **_):
        body = fields(body, {"vectors", "k", "ef_search"}, {"vectors"})
        if not isinstance(body["vectors"], list):
            raise Refused(400, "INVALID_ARGUMENT", "vectors must be a list")
        if len(body["vectors"]) > MAX_BATCH:
            raise Refused(422, "LIMIT_EXCEEDED", f"more than {MAX_BATCH} queries")
        out, took = self._search(name, body["vectors"], body) if body["vectors"] else ([], 0.0)
        return 200, {"results": out, "took_ms": took}

    def stats(self, name, **_):
        s = self.catalog.get(name).describe()
        return 200, s | {"deleted_ratio": s["deleted"] / s["rows"] if s["rows"] else 0.0}

    def snapshot(self, name, **_):
        began = time.time()
        with self._lock(name):
            n = self.catalog.save(name)
        return 200, {"generation": n, "took_ms": round(1000 * (time.time() - began), 3)}

    def compact(self, name, **_):
        began = time.time()
        with self._lock(name):
            done = self.catalog.get(name).compact()
        return 200, done | {"took_ms": round(1000 * (time.time() - began), 3)}


_ONE = r"/v1/collections/(?P<name>[^/:]+)"
ROUTES = [
    ("GET", r"/healthz", "health"),
    ("GET", r"/readyz", "readiness"),
    ("GET", r"/metrics", "metrics"),
    ("GET", r"/v1/status", "status"),
    ("POST", r"/v1/collections", "create"),
    ("GET", r"/v1/collections", "list"),
    ("GET", _ONE, "describe"),
    ("DELETE", _ONE, "drop"),
    ("POST", _ONE + r"/vectors", "insert"),
    ("POST", _ONE + r"/vectors:bulk", "bulk"),
    ("GET", _ONE + r"/vectors/(?P<id>\d{1,18})", "get"),
    ("DELETE", _ONE + r"/vectors/(?P<id>\d{1,18})", "delete"),
    ("POST", _ONE + r"/search", "search"),
    ("POST", _ONE + r"/search:batch", "search_batch"),
    ("GET", _ONE + r"/stats", "stats"),
    ("POST", _ONE + r"/snapshot", "snapshot"),
    ("POST", _ONE + r"/compact", "compact"),
]
#: Errors of the engine as (status, code).
ERRORS = [(DuplicateId, 409, "ALREADY_EXISTS"), (AlreadyExists, 409, "ALREADY_EXISTS"), (NotFound, 404, "NOT_FOUND"), (InvalidInput, 400, "INVALID_ARGUMENT"), (CapacityExceeded, 507, "RESOURCE_EXHAUSTED"), (Unsupported, 500, "UNSUPPORTED_VERSION"), (Corrupt, 500, "CORRUPT_DATA")]


def route_of(method: str, target: str) -> str:
    """The name of a request's route, for counters and the log."""
    path = urlsplit(target).path
    return next((name for m, pattern, name in ROUTES if m == method and re.fullmatch(pattern, path)), "unmatched")


def answer(service: Service, method: str, target: str, headers, read) -> tuple[int, object]:
    """(status, answer) of one request; ``read`` gives the body."""
    url = urlsplit(target)
    hits = [(m, m_, f) for m_, path, f in ROUTES if (m := re.fullmatch(path, url.path))]
    route = next((x for x in hits if x[1] == method), None)
    try:
        if service.token and url.path not in ("/healthz", "/readyz") and not hmac.compare_digest(headers.get("Authorization", ""), f"Bearer {service.token}"):
            raise Refused(401, "UNAUTHORIZED", "a bearer token is needed")
        if route is None:
            raise Refused(404, "NOT_FOUND", f"no route {method} {url.path}")
        if not service.ready and route[2] not in ("health", "readiness"):
            raise Refused(503, "UNAVAILABLE", "stopping")
        args = route[0].groupdict() | {"query": parse_qs(url.query)}
        if route[2] in ("create", "insert", "bulk", "search", "search_batch"):
            if int(headers.get("Content-Length") or 0) > MAX_BODY:
                raise Refused(413, "PAYLOAD_TOO_LARGE", f"more than {MAX_BODY} bytes")
            wanted = "application/octet-stream" if route[2] == "bulk" else "application/json"
            if headers.get("Content-Type", "").split(";")[0].strip() != wanted:
                raise Refused(415, "UNSUPPORTED_MEDIA_TYPE", f"the body must be {wanted}")
            raw = read()
            if route[2] == "bulk":
                args["raw"] = raw
            else:
                try:
                    args["body"] = json.loads(raw)
                except (ValueError, RecursionError):
                    raise Refused(400, "MALFORMED_JSON", "the body is not JSON") from None
                if _depth(args["body"]) > MAX_DEPTH:
                    raise Refused(400, "MALFORMED_JSON", "nested too deep")
        return getattr(service, route[2])(**args)
    except Refused as e:
        return e.status, {"error": {"code": e.code, "message": str(e)}}
    except Exception as e:  # noqa: BLE001  every failure has an answer
        status, code = next(((s, c) for kind, s, c in ERRORS if isinstance(e, kind)), (500, "INTERNAL"))
        return status, {"error": {"code": code, "message": str(e.args[0] if e.args else e)[:500]}}


def serve(catalog: VectorCatalog, port: int = 0, host: str = "127.0.0.1", token: str | None = None) -> tuple[ThreadingHTTPServer, Service]:
    """A server that a thread runs; ``server.server_port`` is its port, ``shutdown()`` ends it."""
    service = Service(catalog, token)

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def handle_any(self):
            began = time.time()
            service.began_one()
            body = lambda: self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, out = answer(service, self.command, self.path, self.headers, body)
            text = isinstance(out, str)
            raw = (out if text else json.dumps(out)).encode()
            given = self.headers.get("X-Request-Id", "")
            given = given if re.fullmatch(r"[\x21-\x7e]{1,128}", given) else uuid.uuid4().hex
            self.send_response(status)
            self.send_header("Content-Type", "text/plain" if text else "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.send_header("X-Request-Id", given)
            self.end_headers()
            try:
                self.wfile.write(raw)
            finally:
                service.ended_one(self.command, route_of(self.command, self.path), status, time.time() - began, given)

        do_GET = do_POST = do_DELETE = do_PUT = handle_any

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server, service
