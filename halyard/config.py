"""Parameters of collections and searches, with their ranges."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from halyard.errors import InvalidInput

METRICS = ("l2", "ip", "cosine")
#: Largest component, as float32.
LARGEST = 1e16
MAX_DIM, MAX_K, MAX_BEAM = 65_536, 1 << 20, 1 << 20
#: The id that pads short results, as a signed 64-bit integer; reserved. Ids are from 0 to 2**63 - 1.
NO_ID = -1
#: Rows, deleted ones included, that a collection can number.
MAX_ROWS = (1 << 32) - 2


def _within(name: str, value: int, least: int, most: int) -> None:
    if not isinstance(value, int) or isinstance(value, bool) or not least <= value <= most:
        raise InvalidInput(f"{name} must be an integer from {least} to {most}, not {value!r}")


@dataclass(frozen=True)
class GraphParams:
    """Of the layered proximity graph: links a node, construction and search beams (the latter the least where a search names none), levels, level seed."""

    m: int = 16
    ef_construction: int = 200
    ef_search: int = 50
    max_level: int = 16
    seed: int = 0x5EEDF0A6E
    heuristic: bool = True
    keep_pruned: bool = True
    shards: int = 8

    def __post_init__(self):
        _within("m", self.m, 2, 512)
        _within("ef_construction", self.ef_construction, self.m, MAX_BEAM)
        _within("ef_search", self.ef_search, 1, MAX_BEAM)
        _within("max_level", self.max_level, 1, 32)
        _within("shards", self.shards, 1, 1 << 20)


@dataclass(frozen=True)
class CollectionConfig:
    dim: int
    metric: str = "l2"
    normalize: bool = False
    index: str = "flat"
    graph: GraphParams = field(default_factory=GraphParams)

    def __post_init__(self):
        _within("dim", self.dim, 1, MAX_DIM)
        if self.metric == "inner_product":
            object.__setattr__(self, "metric", "ip")
        if self.metric not in METRICS:
            raise InvalidInput(f"metric must be one of {', '.join(METRICS)}, not {self.metric!r}")
        if self.index not in ("flat", "hnsw"):
            raise InvalidInput(f"index must be flat or hnsw, not {self.index!r}")
        if self.metric == "cosine":
            object.__setattr__(self, "normalize", True)

    @property
    def mode(self) -> str:
        """How a search scores: the metric, on raw or unit rows."""
        return self.metric + ("_unit" if self.normalize else "")

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> CollectionConfig:
        found = json.loads(text)
        return CollectionConfig(**found | {"graph": GraphParams(**found["graph"])})

    def with_index(self, index: str) -> CollectionConfig:
        return replace(self, index=index)


@dataclass(frozen=True)
class SearchParams:
    k: int = 10
    ef_search: int | None = None

    def __post_init__(self):
        _within("k", self.k, 1, MAX_K)
        if self.ef_search is not None:
            _within("ef_search", self.ef_search, 1, MAX_BEAM)

    def beam(self, graph: GraphParams) -> int:
        return max(self.ef_search or graph.ef_search, self.k)
