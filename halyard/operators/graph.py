"""Approximate search by layered proximity graphs, one for each shard of the rows.

A shard's graph is built by one task in insertion order, in batches: the nodes of a batch search the graph
that stands together, see the ones before them in the batch, choose their links, and link back. The
result depends on the rows and parameters alone. Rows are dealt to shards by their number. A search asks every
shard and ranks what they return, so recall is at least that of one graph with the same beam. All
searches of a block advance together, so a step is a few operations on arrays.

The beam that a recall takes grows with a shard. Where a search names no beam, each shard has its own, the graph's
``ef_search`` or wider, fitted when it is packed: to what a bounded sample of its rows, left out of its links, needs.

Graphs are tables, one row a node: (shard, node, row_id, id, vector, deleted, level, links), ``links`` holding
the neighbours by level; the first node of a shard also has what its build counted: distances, and orphans
that were linked or left. For searches a shard is packed into one row of flat arrays, once for a graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.config import CollectionConfig, GraphParams, SearchParams
from halyard.functions import kernels, random
from halyard.operators.search import CANDIDATE, Best, query_blocks, ranked
from halyard.operators.validation import check_queries
from halyard.storage import stored

NODE = "shard int, node int, row_id long, id long, vector array<float>, deleted boolean, level int, links array<array<int>>, computed long, repaired long, unrepaired long"
PACKED = "shard int, n long, row_ids binary, ids binary, vectors binary, deleted binary, levels binary, links binary, beam int"
#: Nodes of a batch; queries that advance together; marks of visited nodes, in bytes; vectors of a shard, in bytes.
BATCH, TOGETHER, VISITED, SHARD_BYTES = 256, 256, 64 << 20, 1 << 29
#: Rows of a shard, the nearest of each, and the share of these by which its beam is fitted.
FITTED_ON, FITTED_K, FITTED_RECALL = 64, 10, 0.97
#: A beam wider than this share of a shard costs more than to score all that is in reach.
WIDEST = 1 / 16
#: Key of nothing; keys order by distance, then by node; the lowest bit tells whether the node was expanded.
NONE = np.int64((1 << 63) - 1)


def select_neighbours(candidates: list[tuple[float, int]], most: int, between, heuristic: bool = True, keep_pruned: bool = True) -> list[tuple[float, int]]:
    """At most ``most`` of ``candidates`` (distance to the base, node), nearest first.

    The heuristic takes a candidate only if it is nearer to the base than to all taken before, so links
    point in different directions; pruned ones fill what is left, if asked.
    """
    if not heuristic:
        return candidates[:most]
    taken: list[tuple[float, int]] = []
    pruned: list[tuple[float, int]] = []
    for d, node in candidates:
        if len(taken) == most:
            break
        if all(between(node, other) >= d for _, other in taken):
            taken.append((d, node))
        else:
            pruned.append((d, node))
    return taken + pruned[: most - len(taken)] if keep_pruned else taken


def keys_of(d: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """(distance, node) as integers of the same order."""
    bits = (d.astype(np.float32) + np.float32(0)).view(np.int32)
    return ((bits ^ ((bits >> 31) & 0x7FFFFFFF)).astype(np.int64) << 32) | (nodes.astype(np.int64) << 1)


def nodes_of(keys: np.ndarray) -> np.ndarray:
    """The nodes of keys; -1 for none."""
    return np.where(keys == NONE, -1, (keys & 0xFFFFFFFF) >> 1)


def distances_of(keys: np.ndarray) -> np.ndarray:
    bits = (keys >> 32).astype(np.int32)
    return np.where(keys == NONE, np.float32(np.inf), (bits ^ ((bits >> 31) & 0x7FFFFFFF)).view(np.float32))


class Graph:
    """Nodes 0, 1, ... of one shard over its vectors. The links of a level are rows of node numbers, -1 where there is room."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, mode: str, params: GraphParams, strict: bool = True):
        self.v, self.levels, self.mode, self.params, self.strict = vectors, levels, mode, params, strict
        n = len(vectors)
        members = [np.flatnonzero(levels >= at) for at in range(int(levels.max(initial=0)) + 1)]
        self.place = [np.full(n, -1, np.int32) for _ in members]
        for place, own in zip(self.place, members):
            place[own] = np.arange(len(own))
        self.links = [np.full((len(own), self.room(at)), -1, np.int32) for at, own in enumerate(members)]
        self.linked = [np.zeros(len(own), np.int64) for own in members]  # links to each node
        self.entry, self.count = -1, 0
        self.computed = self.repaired = self.unrepaired = 0

    def room(self, level: int) -> int:
        return self.params.m * (1 if level else 2)

    def lists(self) -> list[list[list[int]]]:
        """The links of each node by level."""
        out: list[list[list[int]]] = [[] for _ in self.levels]
        for place, links in zip(self.place, self.links):
            for node, own in zip(np.flatnonzero(place >= 0).tolist(), links.tolist()):
                out[node].append([x for x in own if x >= 0])
        return out

    def of(self, level: int, nodes: np.ndarray) -> np.ndarray:
        return self.links[level][self.place[level][nodes]]

    def far(self, q: np.ndarray, inverse: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Keys of ``nodes`` (queries, k), by distance from their queries; NONE for -1."""
        out = np.full(nodes.shape, NONE)
        r, c = np.nonzero(nodes >= 0)
        self.computed += len(r)
        to = nodes[r, c]
        d = np.concatenate([np.zeros(0, np.float32), *(kernels.pairs(self.mode, q[r[i : i + 8192]], inverse[r[i : i + 8192]], self.v[to[i : i + 8192]], self.strict) for i in range(0, len(r), 8192))])
        out[r, c] = keys_of(d, to)
        return out

    def descend(self, q: np.ndarray, inverse: np.ndarray, current: np.ndarray, level: int, live: np.ndarray) -> None:
        """Moves the keys ``current`` of the ``live`` queries to the nearest neighbour while that is nearer."""
        at = np.flatnonzero(live)
        while len(at):
            best = self.far(q[at], inverse[at], self.of(level, nodes_of(current[at]))).min(1)
            nearer = best < current[at]
            at, best = at[nearer], best[nearer]
            current[at] = best

    def beam(self, q: np.ndarray, inverse: np.ndarray, found: np.ndarray, width: int, level: int, deleted: np.ndarray | None = None) -> np.ndarray:
        """Keys (queries, at most ``width``, or more where there are deleted nodes) that a best-first search finds from ``found``, in order.

        The nearest node that is not expanded yet is, until none is left among the ``width`` nearest. Deleted nodes lead
        on, and stand among the others, but don't count.
        """
        most = max(1, min(TOGETHER, VISITED // max(len(self.v), 1)))
        if len(q) > most:
            parts = [self.beam(q[i : i + most], inverse[i : i + most], found[i : i + most], width, level, deleted) for i in range(0, len(q), most)]
            wide = max(p.shape[1] for p in parts)
            return np.concatenate([np.pad(p, ((0, 0), (0, wide - p.shape[1])), constant_values=NONE) for p in parts])
        seen = np.zeros((len(q), len(self.v) + 1), bool)  # the last for -1
        seen[:, -1] = True
        np.put_along_axis(seen, nodes_of(found), True, 1)
        seen[:, -1] = True
        keys = self._nearest(np.sort(found, 1), width, deleted)
        while True:
            open_ = (keys & 1) == 0
            at = np.flatnonzero(open_.any(1))
            if not len(at):
                return np.where(keys == NONE, NONE, keys & ~np.int64(1))
            first = open_[at].argmax(1)
            nodes = nodes_of(keys[at, first])
            keys[at, first] |= 1
            new = self.of(level, nodes)
            new = np.where(seen[at[:, None], new], -1, new)
            seen[at[:, None], new] = True
            more = self.far(q[at], inverse[at], new)
            merged = self._nearest(np.sort(np.concatenate([keys[at], more], 1), 1), width, deleted)
            wide = max(merged.shape[1], keys.shape[1])
            if wide > keys.shape[1]:
                keys = np.pad(keys, ((0, 0), (0, wide - keys.shape[1])), constant_values=NONE)
            keys[at, : merged.shape[1]] = merged
            keys[at, merged.shape[1] :] = NONE

    @staticmethod
    def _nearest(keys: np.ndarray, width: int, deleted: np.ndarray | None) -> np.ndarray:
        if deleted is None:
            return keys[:, :width]
        nodes = nodes_of(keys)
        counts = (nodes >= 0) & ~deleted[nodes]
        kept = (np.cumsum(counts, 1) - counts < width) & (nodes >= 0)
        return np.where(kept, keys, NONE)[:, : max(1, int(kept.sum(1).max(initial=0)))]

    def _select(self, keys: np.ndarray, most: int) -> np.ndarray:
        """The nodes (rows, most) that the heuristic takes of candidates in order; see :func:`select_neighbours`."""
        nodes, d = nodes_of(keys), distances_of(keys)
        valid, wide = nodes >= 0, keys.shape[1]
        if not self.params.heuristic:
            return np.pad(nodes, ((0, 0), (0, max(0, most - wide))), constant_values=-1)[:, :most]
        taken, n = np.zeros(nodes.shape, bool), np.zeros(len(nodes), np.int64)
        step = max(1, (32 << 20) // (4 * wide * (wide + self.v.shape[1])))
        for i in range(0, len(nodes), step):
            some = slice(i, i + step)
            v = self.v[nodes[some]]
            between = v @ v.transpose(0, 2, 1)
            if self.mode == "l2":
                square = np.einsum("tcd,tcd->tc", v, v)
                between = np.maximum(square[:, :, None] + square[:, None, :] - 2 * between, 0)
            elif self.mode in ("l2_unit", "cosine_unit"):
                between = np.maximum(1 - between, 0) * (2 if self.mode == "l2_unit" else 1)
            else:
                between = -between
            own, count = taken[some], n[some]
            for c in range(wide):
                fits = valid[some, c] & (count < most) & ~(own & (between[:, c] < d[some, c, None])).any(1)
                own[:, c] = fits
                count += fits
        spare = valid & ~taken
        if self.params.keep_pruned:
            taken_too = spare & (np.cumsum(spare, 1) <= (most - n)[:, None])
        else:
            taken_too = np.zeros_like(taken)
        place = np.where(taken, np.arange(wide), np.where(taken_too, wide + np.arange(wide), 2 * wide + 1))
        order = np.argsort(place, 1, kind="stable")[:, :most]
        out = np.where(np.take_along_axis(place, order, 1) <= 2 * wide, np.take_along_axis(nodes, order, 1), -1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)

    def grow(self) -> Graph:
        while self.count < len(self.v):
            self._add(min(BATCH, max(1, self.count), len(self.v) - self.count))
        return self

    def _add(self, n: int) -> None:
        """Adds the next ``n`` rows."""
        first, p = self.count, self.params
        new = np.arange(first, first + n)
        q, one, levels = self.v[new], np.ones(n, np.float32), self.levels[new]
        mates = keys_of(kernels.scores(self.mode, q, one, q, self.strict), np.broadcast_to(new, (n, n)))
        mates = np.where(np.tri(n, n, -1, bool), mates, NONE)  # the ones before
        top = int(self.levels[self.entry]) if self.entry >= 0 else -1
        current = self.far(q, one, np.full((n, 1), self.entry))[:, 0] if top >= 0 else np.full(n, NONE)
        found, plan = current[:, None], []
        for at in range(max(top, int(levels.max())), -1, -1):
            here = levels >= at
            if at <= top:
                self.descend(q, one, current, at, ~here)
                found[~here, 0] = current[~here]
                if here.any():
                    got = self.beam(q[here], one[here], found[here], p.ef_construction, at)  # the next level starts from all of them
                    found = np.pad(found, ((0, 0), (0, max(0, got.shape[1] - found.shape[1]))), constant_values=NONE)
                    found[here, : got.shape[1]] = got
                    found[here, got.shape[1] :] = NONE
            if here.any():
                near = np.where(here, mates[here], NONE)
                candidates = np.sort(np.concatenate([found[here] if at <= top else near[:, :0], near], 1), 1)[:, : p.ef_construction]
                plan.append((at, new[here], candidates, self._select(candidates, p.m)))
        for at, nodes, _, chosen in plan:
            self.links[at][self.place[at][nodes], : p.m] = chosen
            np.add.at(self.linked[at], self.place[at][chosen[chosen >= 0]], 1)
        self.count += n
        for at, nodes, candidates, chosen in reversed(plan):
            lost = self._link_back(at, nodes, chosen)
            self._repair(at, nodes, candidates, lost)
        if int(levels.max()) > top:
            self.entry = first + int(levels.argmax())

    def _link_back(self, at: int, nodes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Links from the chosen nodes; where there is no room for all, the nearest by the heuristic stay. Returns nodes that lost a link."""
        r, c = np.nonzero(chosen >= 0)
        to, source = chosen[r, c], nodes[r]
        order = np.lexsort((source, to))
        to, source = to[order], source[order]
        targets, start, times = np.unique(to, return_index=True, return_counts=True)
        if not len(targets):
            return targets
        room, place = self.room(at), self.place[at]
        new = np.full((len(targets), int(times.max())), -1, np.int32)
        new[np.repeat(np.arange(len(targets)), times), np.arange(len(to)) - np.repeat(start, times)] = source
        both = np.concatenate([self.links[at][place[targets]], new], 1)
        np.add.at(self.linked[at], place[source], 1)
        # those with room: links first, then the free places
        packed = np.take_along_axis(both, np.argsort(both < 0, 1, kind="stable"), 1)
        full = (both >= 0).sum(1) > room
        kept = packed[:, :room].copy()
        lost = targets[:0]
        if full.any():
            own = targets[full]
            keys = np.sort(self.far(self.v[own], np.ones(len(own), np.float32), packed[full]), 1)
            kept[full] = self._select(keys, room)
            before = packed[full]
            gone = before[(before >= 0) & ~(before[:, :, None] == kept[full][:, None, :]).any(2)]
            np.subtract.at(self.linked[at], place[gone], 1)
            lost = np.unique(gone)
        self.links[at][place[targets]] = kept
        return lost

    def _repair(self, at: int, nodes: np.ndarray, candidates: np.ndarray, lost: np.ndarray) -> None:
        """Links orphans, new ones and those that lost their last link, from the nearest candidate that has room, or else in place of a link."""
        place, links = self.place[at], self.links[at]
        of = {int(node): nodes_of(candidates[i]) for i, node in enumerate(nodes) if self.linked[at][place[node]] == 0}
        of |= {int(node): links[place[node]] for node in lost if self.linked[at][place[node]] == 0 and int(node) not in of}
        for node, near in of.items():
            if self.count == 1 or node == self.entry or not (near >= 0).any() or self.linked[at][place[node]]:
                continue
            near = near[near >= 0]
            spare = near[(links[place[near]] < 0).any(1)]
            if not len(spare):
                if self._replace(at, node, near):
                    self.repaired += 1
                else:
                    self.unrepaired += 1
                continue
            row = links[place[spare[0]]]
            row[np.flatnonzero(row < 0)[0]] = node
            self.linked[at][place[node]] += 1
            self.repaired += 1

    def _replace(self, at: int, node: int, near: np.ndarray) -> bool:
        """Links the orphan ``node`` from the nearest of ``near``, which are full, in place of the last link that can go, or from nodes that they lead to.

        A link can go if the orphan leads to its end, or has room to, so that all stays in reach, or else if its end keeps another link.
        """
        place, links, linked = self.place[at], self.links[at], self.linked[at]
        own, queue = links[place[node]], [int(x) for x in near]
        met = {node, *queue}
        for x in queue:
            row = links[place[x]]
            free = np.flatnonzero(row < 0)
            if len(free):
                row[free[0]] = node
                linked[place[node]] += 1
                return True
            room, kept = np.flatnonzero(own < 0), np.flatnonzero(np.isin(row, own))
            if not len(kept) and len(room):
                kept = np.arange(len(row))
                own[room[0]] = row[-1]
                linked[place[row[-1]]] += 1
            elif not len(kept):
                kept = np.flatnonzero(linked[place[row]] > 1)
            if len(kept):
                linked[place[row[kept[-1]]]] -= 1
                linked[place[node]] += 1
                row[kept[-1]] = node
                return True
            more = [y for y in row.tolist() if y not in met]
            met.update(more)
            queue += more
        return False

    def search(self, q: np.ndarray, inverse: np.ndarray, k: int, width: int, deleted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, distances), each (queries, k): the nearest found, -1 and infinity where fewer are."""
        if not len(self.v):
            return np.full((len(q), k), -1), np.full((len(q), k), np.inf, np.float32)
        current = self.far(q, inverse, np.full((len(q), 1), self.entry))[:, 0]
        for at in range(int(self.levels[self.entry]), 0, -1):
            self.descend(q, inverse, current, at, np.ones(len(q), bool))
        if max(width, k) >= len(self.v) - (0 if deleted is None else int(deleted.sum())):
            return self._nearest_reached(q, inverse, nodes_of(current), k, deleted)
        keys = self.beam(q, inverse, current[:, None], max(width, k), 0, deleted)
        if deleted is not None:
            nodes = nodes_of(keys)
            keys = np.sort(np.where((nodes >= 0) & ~deleted[nodes], keys, NONE), 1)
        keys = np.pad(keys, ((0, 0), (0, max(0, k - keys.shape[1]))), constant_values=NONE)[:, :k]
        return nodes_of(keys), distances_of(keys)


    def _nearest_reached(self, q: np.ndarray, inverse: np.ndarray, starts: np.ndarray, k: int, deleted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """What a beam finds that has room for every node: it expands all that links reach from where it starts, in whatever order, so they are scored at once."""
        nodes, d = np.full((len(q), k), -1), np.full((len(q), k), np.inf, np.float32)
        links = self.links[0]
        source, slot = np.nonzero(links >= 0)
        order = np.argsort(links[source, slot], kind="stable")
        source, end = source[order], np.cumsum(np.bincount(links[source, slot], minlength=len(links)))
        back = lambda to: source[_ranges(np.concatenate([[0], end])[to], end[to])]
        left = np.unique(starts)
        while len(left):
            reached = _reached(len(links), left[0], lambda of: links[of].ravel())
            # starts that lead to one another reach the same
            same = reached & _reached(len(links), left[0], back)
            own, left = np.flatnonzero(same[starts]), left[~same[left]]
            rows = np.flatnonzero(reached if deleted is None else reached & ~deleted)
            best = Best(len(own), k)
            best.scan(self.mode, q[own], inverse[own], self.v[rows], rows, rows, self.strict)
            self.computed += len(own) * len(rows)
            place = np.arange(len(best.q)) - np.searchsorted(best.q, best.q)
            nodes[own[best.q], place], d[own[best.q], place] = best.row, best.d
        return nodes, d


    def fitted(self, deleted: np.ndarray | None) -> int:
        """The beam, ``ef_search`` or wider, by which a sample of the nodes finds its nearest among the others; one for all nodes if that is not narrow.

        No link leads to the sample, as none leads to a query that is not a row.
        """
        n, width = len(self.v), self.params.ef_search
        own = np.unique(np.linspace(0, n - 1, min(FITTED_ON, n // 16), dtype=np.int64))
        own = own[own != self.entry]
        hidden = np.isin(np.arange(n + 1), own)  # the last for -1
        rest = np.flatnonzero(~hidden[:-1] if deleted is None else ~(hidden[:-1] | deleted))
        if not len(own) or not len(rest):
            return width
        g = Graph(self.v, self.levels, self.mode, self.params)
        g.links, g.entry, g.count = [np.where(hidden[x], -1, x) for x in self.links], self.entry, self.count
        q = self.v[own]
        inverse = kernels.inverse_norm(q) if self.mode.endswith("unit") else np.ones(len(q), np.float32)
        best = Best(len(q), FITTED_K)
        best.scan(self.mode, q, inverse, self.v[rest], rest, rest, True)
        while True:
            d = g.search(q, inverse, FITTED_K, width, deleted)[1]
            if (np.isfinite(d) & (d <= best.limit[:, None])).sum() >= FITTED_RECALL * len(best.q):
                return width
            width += max(1, width // 2)
            if width > WIDEST * n:
                return max(n, self.params.ef_search)


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers from each start to before its end, one range after the other."""
    n = end - start
    return np.arange(int(n.sum())) + np.repeat(start - np.cumsum(n) + n, n)


def _reached(n: int, start: int, step) -> np.ndarray:
    """Which of ``n`` nodes are ``start`` or follow from it; ``step`` gives the nodes after some, -1 for none."""
    reached = np.zeros(n + 1, bool)  # the last for -1
    reached[-1] = True
    frontier = np.array([start])
    while len(frontier):
        reached[frontier] = True
        after = step(frontier)
        frontier = np.unique(after[~reached[after]])
    return reached[:-1]


def build(rows: DataFrame, config: CollectionConfig) -> DataFrame:
    """The graph table of ``rows`` (row_id, id, vector, deleted), stored."""
    p, mode, dim = config.graph, config.mode, config.dim
    # more shards than asked for where one would not fit a task
    shards = max(p.shards, -(-rows.count() * 4 * dim // SHARD_BYTES))

    def grow(table: pa.Table) -> pa.Table:
        table = table.sort_by("row_id").combine_chunks()
        v = kernels.matrix(table.column("vector").combine_chunks(), dim)
        graph = Graph(v, random.levels(np.arange(len(v)), p.seed, p.m, p.max_level), mode, p, strict=False).grow()
        nodes = pa.array(range(len(v)), pa.int32())
        counted = (pa.array([x] + [None] * (len(v) - 1), pa.int64()) for x in (graph.computed, graph.repaired, graph.unrepaired))
        columns = [table.column("shard"), nodes, table.column("row_id"), table.column("id"), table.column("vector"), table.column("deleted"), pa.array(graph.levels, pa.int32()), pa.array(graph.lists(), pa.list_(pa.list_(pa.int32()))), *counted]
        return pa.table(columns, names=["shard", "node", "row_id", "id", "vector", "deleted", "level", "links", "computed", "repaired", "unrepaired"])

    dealt = rows.select(F.pmod(F.col("row_id"), F.lit(shards)).cast("int").alias("shard"), "row_id", "id", "vector", "deleted")
    return stored(dealt.groupBy("shard").applyInArrow(grow, NODE))


def packed(graph: DataFrame, config: CollectionConfig) -> DataFrame:
    """The shards of ``graph``, a row of flat arrays each with its fitted beam, stored; searches read them without a shuffle."""
    m = config.graph.m

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("node").combine_chunks()
        links = table.column("links").to_pylist()
        flat = np.full((sum(map(len, links)), 2 * m), -1, np.int32)
        for row, own in zip(flat, (own for node in links for own in node)):
            row[: len(own)] = own
        v = kernels.matrix(table.column("vector").combine_chunks(), config.dim)
        levels, gone = np.array(table.column("level").to_pylist(), np.uint8), np.array(table.column("deleted").to_pylist(), np.uint8)
        names = [c.split()[0] for c in PACKED.split(", ")]
        parts = [*(np.array(table.column(c).to_pylist(), np.int64) for c in ("row_id", "id")), v, gone, levels, flat]
        row = dict(zip(names[1:-1], (len(v), *(x.tobytes() for x in parts))))
        g, _, _, deleted = _unpacked(row, config)
        return pa.table([table.column("shard")[:1], pa.array([len(v)], pa.int64()), *(pa.array([row[x]], pa.binary()) for x in names[2:-1]), pa.array([g.fitted(deleted)], pa.int32())], names=names)

    return stored(graph.select("shard", "node", "row_id", "id", "vector", "deleted", "level", "links").groupBy("shard").applyInArrow(pack, PACKED))


def _unpacked(row: dict, config: CollectionConfig) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray | None]:
    """(graph, row ids, ids, which are deleted or None)."""
    v, levels = np.frombuffer(row["vectors"], np.float32).reshape(row["n"], config.dim), np.frombuffer(row["levels"], np.uint8).astype(np.int64)
    g, flat = Graph(v, levels, config.mode, config.graph), np.frombuffer(row["links"], np.int32).reshape(-1, 2 * config.graph.m)
    start = np.cumsum(levels + 1) - levels - 1
    for at in range(len(g.links)):
        nodes = np.flatnonzero(levels >= at)
        g.links[at][:] = flat[start[nodes] + at, : g.room(at)]
    g.entry, g.count = int(levels.argmax()) if len(levels) else -1, len(v)
    gone = np.frombuffer(row["deleted"], np.uint8).astype(bool)
    return g, np.frombuffer(row["row_ids"], np.int64), np.frombuffer(row["ids"], np.int64), gone if gone.any() else None


def graph_search(graph: DataFrame, queries: DataFrame, config: CollectionConfig, params: SearchParams = SearchParams()) -> DataFrame:
    """(qid, rank, id, distance) of ``queries`` by the graphs of all shards; ``graph`` is a graph's table, or what :func:`packed` made of it.

    Each block of queries is sent to the shards in parts, so that few shards keep all cores busy too. Without a beam in
    ``params`` a shard is searched by its fitted one, wider by what ``k`` is above FITTED_K.
    """
    check_queries(queries, config)
    spark, dim, k = graph.sparkSession, config.dim, params.k
    width = params.beam(config.graph) if params.ef_search else None
    shards = graph if "vectors" in graph.columns else packed(graph, config)
    found = spark.createDataFrame([], CANDIDATE)
    parts = max(1, -(-spark.sparkContext.defaultParallelism // max(1, shards.count())))
    asked = shards.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = asked.repartition("shard", "part") if parts > 1 else asked
    for qids, q in query_blocks(queries, dim):
        sent = spark.sparkContext.broadcast((qids, q, kernels.inverse_norm(q) if config.normalize else np.ones(len(q), np.float32)))
        found = found.union(asked.mapInArrow(_answer(sent, config, k, width, parts), CANDIDATE))
    return ranked(found, k)


def _answer(sent, config: CollectionConfig, k: int, width: int | None, parts: int):
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q, inverse = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                g, row_ids, ids, gone = _unpacked(row, config)
                own = slice(row["part"], None, parts)
                nodes, d = g.search(q[own], inverse[own], k, width or row["beam"] + max(0, k - FITTED_K), gone)
                r, c = np.nonzero(nodes >= 0)
                hit = nodes[r, c]
                yield pa.RecordBatch.from_arrays([pa.array(qids[own][r], pa.int64()), pa.array(row_ids[hit], pa.int64()), pa.array(ids[hit], pa.int64()), pa.array(d[r, c], pa.float32())], ["qid", "row_id", "id", "distance"])

    return answer


def build_counters(graph: DataFrame) -> DataFrame:
    """(shard, nodes, computed, repaired, unrepaired): what the build of each shard counted."""
    return graph.groupBy("shard").agg(F.count("*").alias("nodes"), *(F.sum(c).alias(c) for c in ("computed", "repaired", "unrepaired")))


def canonical(graph: DataFrame, params: GraphParams) -> DataFrame:
    """(shard, bytes): links a node, top level, nodes, entry point and its level, then each node's level and lists, little-endian.

    Equal graphs have equal bytes, however their rows are dealt.
    """

    def encode(table: pa.Table) -> pa.Table:
        table = table.sort_by("node").combine_chunks()
        levels = np.array(table.column("level").to_pylist())
        words = [np.array([params.m, int(levels.max())], "<u4").tobytes(), np.array([len(levels)], "<u8").tobytes(), np.array([int(np.argmax(levels)), int(levels.max())], "<u4").tobytes()]
        for level, lists in zip(levels.tolist(), table.column("links").to_pylist()):
            words.append(bytes([level]) + b"".join(np.array([len(own), *own], "<u4").tobytes() for own in lists))
        return pa.table({"shard": table.column("shard")[:1], "bytes": pa.array([b"".join(words)], pa.binary())})

    return graph.select("shard", "node", "level", "links").groupBy("shard").applyInArrow(encode, "shard int, bytes binary")


def level_histogram(graph: DataFrame, most: int) -> DataFrame:
    """(level, n) of nodes by top level, with zeros, for levels 0 to ``most``."""
    n = graph.groupBy("level").agg(F.count("*").alias("n"))
    every = graph.sparkSession.range(most + 1).select(F.col("id").cast("int").alias("level"))
    return every.join(n, "level", "left").select("level", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def edges(graph: DataFrame) -> DataFrame:
    """(shard, level, node, neighbour, slot) for each link."""
    df = graph.select("shard", "node", F.posexplode("links").alias("level", "to"))
    return df.select("shard", "level", "node", F.posexplode("to").alias("slot", "neighbour"))


def violations(graph: DataFrame, params: GraphParams) -> DataFrame:
    """(shard, node, level, problem) of everything that breaks the rules of a graph; no row if it is sound."""
    link = edges(graph)
    levels = graph.select("shard", F.col("node").alias("neighbour"), F.col("level").alias("top"))
    room = F.when(F.col("level") == 0, 2 * params.m).otherwise(params.m)
    lists = link.groupBy("shard", "node", "level").agg(F.count("*").alias("n"), F.countDistinct("neighbour").alias("distinct"))
    bad = [
        lists.where(F.col("n") > room).select("shard", "node", "level", F.lit("too many links").alias("problem")),
        lists.where(F.col("n") > F.col("distinct")).select("shard", "node", "level", F.lit("repeated link")),
        link.where("node = neighbour").select("shard", "node", "level", F.lit("link to itself")),
        link.join(levels, ["shard", "neighbour"], "left").where("top is null or top < level").select("shard", "node", "level", F.lit("link to a node that is not on the level")),
        graph.where("size(links) <> level + 1").select("shard", "node", "level", F.lit("number of lists")),
    ]
    out = bad[0]
    for df in bad[1:]:
        out = out.union(df)
    return out


def unreachable(graph: DataFrame) -> DataFrame:
    """(level, n): nodes of each level that its links do not reach from the entry points, of all shards."""
    link = stored(edges(graph).select("shard", "level", "node", "neighbour"))
    top = graph.groupBy("shard").agg(F.max_by("node", F.struct("level", -F.col("node"))).alias("node"), F.max("level").alias("top"))
    members = graph.select("shard", "node", F.explode(F.sequence(F.lit(0), F.col("level"))).alias("level"))
    reached = stored(top.select("shard", "node", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("level")))
    frontier = reached
    while True:
        step = frontier.join(link, ["shard", "level", "node"]).select("shard", F.col("neighbour").alias("node"), "level").distinct()
        frontier = stored(step.join(reached, ["shard", "node", "level"], "left_anti"))
        if frontier.isEmpty():
            break
        reached = stored(reached.union(frontier))
    lost = members.join(reached, ["shard", "node", "level"], "left_anti").groupBy("level").agg(F.count("*").alias("n"))
    return members.select("level").distinct().join(lost, "level", "left").select("level", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
