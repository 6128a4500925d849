"""Leiden communities of weighted graphs, one graph a structure and cutoff.

Edges are rows; Spark deals them by graph, and a graph, bounded by its structure's
length, is one array: sparse, never a matrix; graphs are solved a batch at a time.  The order of nodes is fixed
(ascending), and of equal gains the smallest community wins, so a result depends on
nothing but the graph.

Each turn has three phases.  Moving: nodes wait in a queue; one that finds a better community
moves there, and its neighbours outside that community queue again.  Refinement:
within each community the nodes start alone, and a node that is alone and well
connected joins the well-connected part that gains most.  Aggregation: the refined
parts become nodes, which start in the communities of the first phase.  Turns follow
until a whole pass changes nothing.  This is done from single nodes and from greedy
merges; the better result stays, so it is never below that of the merges.

The quality is the weight inside communities less ``resolution`` times the product of
their nodes' sizes: with ``cpm`` a node's size is 1, with ``modularity`` its weighted degree, and
the resolution is divided by twice the graph's weight.
"""

from __future__ import annotations

from collections import deque
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_EPS = 1e-12


class Graph:
    """A symmetric graph: ``to[v]`` are v's neighbours, ascending, ``w[v]`` the edges' weights; ``size`` is each node's size.

    Lists of plain numbers, as most graphs are small and most steps are about one node.
    """

    def __init__(self, to: list[list[int]], w: list[list[float]], size: list[float]):
        self.n, self.to, self.w, self.size = len(to), to, w, size

    @classmethod
    def of_edges(cls, n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, size: np.ndarray) -> Graph:
        a, b, w = np.r_[i, j], np.r_[j, i], np.r_[w, w]
        key, place = np.unique(a * n + b, return_inverse=True)
        to, w = (key % n).tolist(), np.bincount(place, w, len(key)).tolist()
        at = np.searchsorted(key, np.arange(n + 1) * n).tolist()
        ends = list(zip(at[:-1], at[1:], strict=True))
        return cls([to[s:e] for s, e in ends], [w[s:e] for s, e in ends], size.tolist())

    def aggregated(self, part: list[int]) -> Graph:
        k = max(part) + 1
        near: list[dict[int, float]] = [{} for _ in range(k)]
        for a, to, w in zip(part, self.to, self.w, strict=True):
            for u, x in zip(to, w, strict=True):
                if a < (b := part[u]):
                    near[a][b] = near[b][a] = near[a].get(b, 0.0) + x
        to = [sorted(d) for d in near]
        return Graph(to, [[d[u] for u in t] for d, t in zip(near, to, strict=True)], _held(part, self.size, k))


def _held(own: list[int], size: list[float], n: int) -> list[float]:
    """The size of each community."""
    out = [0.0] * n
    for c, s in zip(own, size, strict=True):
        out[c] += s
    return out


def _moved(g: Graph, own: list[int], gamma: float) -> None:
    """Nodes to the communities where they gain most; ``own`` changes in place."""
    held, count = _held(own, g.size, g.n), [0] * g.n
    for c in own:
        count[c] += 1
    queue, waits = deque(range(g.n)), [True] * g.n
    free = deque(c for c in range(g.n) if not count[c])
    while queue:
        v = queue.popleft()
        waits[v] = False
        to, c, s = g.to[v], own[v], g.size[v]
        inside: dict[int, float] = {}
        for u, x in zip(to, g.w[v], strict=True):
            inside[own[u]] = inside.get(own[u], 0.0) + x
        stay = inside.get(c, 0.0) - gamma * s * (held[c] - s)
        best, k = 0.0, -1  # alone
        for d in sorted(inside):
            gain = inside[d] - gamma * s * (held[d] - (s if d == c else 0.0))
            if gain > _EPS and gain > best:
                best, k = gain, d
        if best <= stay + _EPS or (k == -1 and count[c] == 1):
            continue
        if k == -1:
            k = free.popleft()
        held[c], held[k] = held[c] - s, held[k] + s
        count[c], count[k] = count[c] - 1, count[k] + 1
        if not count[c]:
            free.append(c)
        own[v] = k
        for u in to:
            if own[u] != k and not waits[u]:
                waits[u] = True
                queue.append(u)


def _refined(g: Graph, own: list[int], gamma: float) -> list[int]:
    """Parts of communities, each well connected within its community."""
    part, held, whole = list(range(g.n)), list(g.size), _held(own, g.size, g.n)
    out, single = [0.0] * g.n, [True] * g.n  # out: weight from a part to the rest of its community
    for v in range(g.n):
        for u, x in zip(g.to[v], g.w[v], strict=True):
            if own[u] == own[v]:
                out[v] += x
    for v in range(g.n):
        s, c = g.size[v], own[v]
        if not single[v] or out[v] + _EPS < gamma * s * (whole[c] - s):
            continue
        inside: dict[int, float] = {}
        for u, x in zip(g.to[v], g.w[v], strict=True):
            if own[u] == c:
                inside[part[u]] = inside.get(part[u], 0.0) + x
        best, t = _EPS, -1
        for d in sorted(inside):
            if out[d] + _EPS >= gamma * held[d] * (whole[c] - held[d]) and (gain := inside[d] - gamma * s * held[d]) > best:
                best, t = gain, d
        if t == -1:
            continue
        out[t] += out[v] - 2 * inside[t]
        held[t], part[v], single[v], single[t] = held[t] + s, t, False, False
    place = {c: k for k, c in enumerate(sorted(set(part)))}
    return [place[c] for c in part]


def merged(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, resolution: float = 1.0, objective: str = "modularity") -> np.ndarray:
    """Communities by greedy merges: the pair that gains most first, of equal gains that with the smallest nodes; named by their smallest nodes."""
    return np.array(_merged(*_graph(n, i, j, w, resolution, objective)), np.int64)


def _merged(g: Graph, gamma: float) -> list[int]:
    n, size, members = g.n, list(g.size), [[v] for v in range(g.n)]
    near = [dict(zip(to, w, strict=True)) for to, w in zip(g.to, g.w, strict=True)]
    gain = lambda a, b: near[a][b] - gamma * size[a] * size[b]
    heap = [(-gain(a, b), a, b) for a in range(n) for b in near[a] if a < b]
    heapify(heap)
    while heap:
        value, a, b = heappop(heap)
        if value > -_EPS:
            break
        if b not in near[a] or -gain(a, b) != value:
            continue  # outdated
        size[a] += size[b]
        for k, x in near[b].items():
            del near[k][b]
            if k != a:
                near[a][k] = near[k][a] = near[a].get(k, 0.0) + x
        near[b] = {}
        members[a] += members[b]
        members[b] = []
        for k in near[a]:
            heappush(heap, (-gain(a, k), min(a, k), max(a, k)))
    own = [0] * n
    for a, nodes in enumerate(members):
        for v in nodes:
            own[v] = a
    return own


def _graph(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, resolution: float, objective: str) -> tuple[Graph, float]:
    """The graph without loops, and what takes the product of sizes off a community's weight."""
    real = i != j
    i, j, w = i[real], j[real], w[real].astype(float)
    if objective == "modularity":
        return Graph.of_edges(n, i, j, w, np.bincount(np.r_[i, j], np.r_[w, w], n)), resolution / max(2 * w.sum(), _EPS)
    return Graph.of_edges(n, i, j, w, np.ones(n)), resolution


def _numbered(own: list[int]) -> list[int]:
    """Communities numbered by their first node."""
    seen: dict[int, int] = {}
    return [seen.setdefault(c, len(seen)) for c in own]


def _improved(base: Graph, own: list[int], gamma: float) -> list[int]:
    """Passes of the three phases from a partition on, until one changes nothing."""
    while True:
        g, labels, nodes, before = base, list(own), list(range(base.n)), own
        while True:
            _moved(g, labels, gamma)
            labels = _numbered(labels)
            own = [labels[v] for v in nodes]
            if max(labels, default=-1) + 1 == g.n:
                break
            part = _refined(g, labels, gamma)
            if max(part) + 1 == g.n:  # nothing to refine: communities themselves become nodes
                part = labels
            first: dict[int, int] = {}
            for v, k in enumerate(part):
                first.setdefault(k, v)
            g, nodes, labels = g.aggregated(part), [part[v] for v in nodes], [labels[first[k]] for k in sorted(first)]
        own = _numbered(own)
        if own == before:
            return own


def leiden(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, resolution: float = 1.0, objective: str = "cpm", greedy: bool = True) -> np.ndarray:
    """The community of each of ``n`` nodes, numbered by their first nodes; edges (i, j, w) may repeat, loops change nothing.

    Without ``greedy`` only from single nodes.
    """
    base, gamma = _graph(n, i, j, w, resolution, objective)
    own = _improved(base, list(range(n)), gamma)
    if greedy:
        other = _improved(base, _numbered(_merged(base, gamma)), gamma)
        if other != own:
            a, b = (_worth(base, gamma, i, j, w, np.array(x)) for x in (own, other))
            own = other if b > a + _EPS else own
    return np.array(own, np.int64)


def quality(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, own: np.ndarray, resolution: float = 1.0, objective: str = "cpm") -> float:
    """What ``leiden`` makes large, of any partition."""
    return _worth(*_graph(n, i, j, w, resolution, objective), i, j, w, own)


def _worth(g: Graph, gamma: float, i: np.ndarray, j: np.ndarray, w: np.ndarray, own: np.ndarray) -> float:
    size, real = np.array(g.size), i != j
    held = np.bincount(own, size)
    return float(w[real][own[i[real]] == own[j[real]]].sum() - gamma * ((held**2).sum() - (size**2).sum()) / 2)


def communities(edges: DataFrame, keys: tuple[str, ...] = ("ref_id",), objective: str = "cpm") -> DataFrame:
    """(*keys, first, pos): of each graph the nodes with an edge, and the smallest node of their community.

    Edges are (*keys, i, j, weight, resolution), the resolution being the graph's; keys are whole or real numbers.
    """
    kinds = {"bigint": pa.int64(), "double": pa.float64()}
    types = dict(edges.select(*keys).dtypes)
    schema = pa.schema([*((k, kinds[types[k]]) for k in keys), ("first", pa.int64()), ("pos", pa.int64())])

    def solve(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            at, edge = batch["edges"].offsets.to_numpy(), batch["edges"].values
            i, j, weight = (edge.field(c).to_numpy() for c in ("i", "j", "weight"))
            firsts, places = [], []
            for s, e, resolution in zip(at[:-1].tolist(), at[1:].tolist(), batch["resolution"].to_pylist(), strict=True):
                nodes, place = np.unique(np.r_[i[s:e], j[s:e]], return_inverse=True)
                own = leiden(len(nodes), *np.split(place, 2), weight[s:e], resolution, objective)
                firsts.append(nodes[np.unique(own, return_index=True)[1]][own])
                places.append(nodes)
            which = np.repeat(np.arange(batch.num_rows), [len(x) for x in places])
            yield pa.RecordBatch.from_arrays([*(batch[k].take(pa.array(which)) for k in keys), pa.array(np.concatenate(firsts)), pa.array(np.concatenate(places))], schema=schema)

    rows = edges.select(*keys, *(F.col(c).cast("long") for c in ("i", "j")), *(F.col(c).cast("double") for c in ("weight", "resolution")))
    # a graph's edges in order, so that sums of weights don't depend on how they came together
    graphs = rows.groupBy(*keys).agg(F.first("resolution").alias("resolution"), F.sort_array(F.collect_list(F.struct("i", "j", "weight"))).alias("edges"))
    return graphs.mapInArrow(solve, ", ".join(f"{k} {types[k]}" for k in keys) + ", first long, pos long")
