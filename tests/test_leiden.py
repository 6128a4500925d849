"""Leiden communities against a plain program with the same order of nodes, and against the greedy merges."""

import random
from collections import deque

import numpy as np
import pytest

from helixframe.operators.domains import modularity_domains
from helixframe.operators.leiden import communities, leiden, quality


def plain(n, edges, resolution, objective):
    """The same three phases over dictionaries."""
    adj = [dict() for _ in range(n)]
    for i, j, w in edges:
        if i != j:
            adj[i][j] = adj[i].get(j, 0.0) + w
            adj[j][i] = adj[j].get(i, 0.0) + w
    size, gamma = [1.0] * n, resolution
    if objective == "modularity":
        size = [sum(a.values()) for a in adj]
        gamma = resolution / max(sum(size), 1e-12)

    def numbered(labels):
        seen = {}
        return [seen.setdefault(x, len(seen)) for x in labels]

    def move(adj, size, own):
        m, queue, held = len(adj), deque(range(len(adj))), {}
        waiting = set(queue)
        for v in range(m):
            held[own[v]] = held.get(own[v], 0) + size[v]
        members = {c: own.count(c) for c in range(m)}
        free = deque(c for c in range(m) if not members[c])
        while queue:
            v = queue.popleft()
            waiting.discard(v)
            c, towards = own[v], {}
            for u, w in adj[v].items():
                towards[own[u]] = towards.get(own[u], 0.0) + w
            stay = towards.get(c, 0.0) - gamma * size[v] * (held[c] - size[v])
            best, to = 0.0, None
            for k in sorted(towards):
                gain = towards[k] - gamma * size[v] * (held[k] - (size[v] if k == c else 0))
                if gain > 1e-12 and (to is None or gain > best):
                    best, to = gain, k
            if best <= stay + 1e-12 or (to is None and members[c] == 1):
                continue
            to = free.popleft() if to is None else to
            held[c], held[to] = held[c] - size[v], held.get(to, 0) + size[v]
            members[c], members[to], own[v] = members[c] - 1, members[to] + 1, to
            if not members[c]:
                free.append(c)
            for u in sorted(adj[v]):
                if own[u] != to and u not in waiting:
                    waiting.add(u)
                    queue.append(u)

    def refine(adj, size, own):
        m = len(adj)
        part, held, alone = list(range(m)), list(size), [True] * m
        whole = {c: sum(size[v] for v in range(m) if own[v] == c) for c in set(own)}
        out = [sum(w for u, w in adj[v].items() if own[u] == own[v]) for v in range(m)]
        for v in range(m):
            if not alone[v] or out[v] + 1e-12 < gamma * size[v] * (whole[own[v]] - size[v]):
                continue
            towards, best, to = {}, 1e-12, None
            for u, w in adj[v].items():
                if own[u] == own[v]:
                    towards[part[u]] = towards.get(part[u], 0.0) + w
            for t in sorted(towards):
                gain = towards[t] - gamma * size[v] * held[t]
                if out[t] + 1e-12 >= gamma * held[t] * (whole[own[v]] - held[t]) and gain > best:
                    best, to = gain, t
            if to is not None:
                out[to] += out[v] - 2 * towards[to]
                held[to] += size[v]
                part[v], alone[v], alone[to] = to, False, False
        order = {p: k for k, p in enumerate(sorted(set(part)))}
        return [order[p] for p in part]

    own = list(range(n))
    while True:
        before, a, s, labels, nodes = own, adj, size, list(own), list(range(n))
        while True:
            move(a, s, labels)
            labels = numbered(labels)
            own = [labels[x] for x in nodes]
            if len(set(labels)) == len(a):
                break
            part = refine(a, s, labels)
            if len(set(part)) == len(a):
                part = labels
            k = len(set(part))
            up, weight, first = [dict() for _ in range(k)], [0.0] * k, {}
            for v in range(len(a)):
                weight[part[v]] += s[v]
                first.setdefault(part[v], labels[v])
                for u, w in a[v].items():
                    if part[u] != part[v]:
                        up[part[v]][part[u]] = up[part[v]].get(part[u], 0.0) + w
            nodes = [part[x] for x in nodes]
            a, s, labels = up, weight, [first[p] for p in range(k)]
        own = numbered(own)
        if own == before:
            return own


def graph(seed, n=60, blocks=5, inside=0.35, across=0.03):
    """Whole weights, so that sums are exact in any order."""
    rng = random.Random(seed)
    return n, [(i, j, float(rng.randint(1, 8))) for i in range(n) for j in range(i, n) if rng.random() < (inside if i * blocks // n == j * blocks // n else across)]


@pytest.mark.parametrize("objective", ["cpm", "modularity"])
@pytest.mark.parametrize("seed", range(8))
def test_equal_to_plain(seed, objective):
    n, edges = graph(seed)
    i, j, w = (np.array(x) for x in zip(*edges, strict=True))
    for resolution in (0.25, 1.0, 2.0):
        own = leiden(n, i, j, w, resolution, objective, greedy=False)
        assert own.tolist() == plain(n, edges, resolution, objective)


def test_finds_planted_blocks():
    n, edges = graph(11, n=90, blocks=3, inside=0.6, across=0.01)
    i, j, w = (np.array(x) for x in zip(*edges, strict=True))
    assert leiden(n, i, j, w, 1.0, "modularity").tolist() == [k // 30 for k in range(90)]
    assert leiden(3, np.array([1]), np.array([1]), np.array([5.0])).tolist() == [0, 1, 2]
    assert leiden(0, *(np.empty(0, int),) * 2, np.empty(0)).tolist() == []


def test_communities_are_connected():
    for seed in range(6):
        n, edges = graph(seed, n=80, blocks=8, inside=0.2, across=0.02)
        i, j, w = (np.array(x) for x in zip(*edges, strict=True))
        own = leiden(n, i, j, w, 0.5)
        for c in set(own.tolist()):
            todo = {v for v in range(n) if own[v] == c}
            reach, more = set(), [min(todo)]
            while more:
                v = more.pop()
                reach.add(v)
                more += [y for a, b, _ in edges for x, y in ((a, b), (b, a)) if x == v and y in todo - reach]
            assert reach == todo


def test_rows_and_at_least_the_greedy(spark):
    """As a grouped job; on each structure the modularity is at least that of greedy merges."""
    graphs = {k: graph(k, n=40 + k) for k in range(6)}
    rows = [(k, i, j, w, 1.0) for k, (_, edges) in graphs.items() for i, j, w in edges if i != j]
    df = spark.createDataFrame(rows, "ref_id long, i long, j long, weight double, resolution double").repartition(3)
    good, greedy = ({k: {} for k in graphs} for _ in range(2))
    for r in communities(df, objective="modularity").collect():
        good[r.ref_id][r.pos] = r.first
    for r in modularity_domains(df).collect():
        greedy[r.ref_id][r.pos] = r.first
    for k, (n, edges) in graphs.items():
        i, j, w = (np.array(x) for x in zip(*edges, strict=True))
        a, b = (quality(n, i, j, w, np.array([own.get(v, v) for v in range(n)]), 1.0, "modularity") for own in (good[k], greedy[k]))
        assert a >= b - 1e-9
        assert all(own <= v for v, own in good[k].items())


def test_graphs_are_solved_by_the_batch(spark):
    """Not a group's overhead for each small graph, and the same whatever the order in which edges come."""
    rows = [(s, c, i, j, 0.1 + ((7 * i + 3 * j + s) % 11) / 7, 0.5) for s in range(40) for c in (0.4, 0.7) for i in range(8) for j in range(8) if (i * j + s) % 3]
    ddl = "structure long, cutoff double, i long, j long, weight double, resolution double"
    found = communities(spark.createDataFrame(rows, ddl), ("structure", "cutoff"))
    assert "FlatMapGroupsInArrow" not in found._jdf.queryExecution().toString()
    again = communities(spark.createDataFrame(rows[::-1], ddl).repartition(5), ("structure", "cutoff"))
    got = sorted(map(tuple, found.collect()))
    assert got == sorted(map(tuple, again.collect())) and len({r[:2] for r in got}) == 80
    for s, c in ((0, 0.4), (17, 0.7)):
        mine = [r[2:5] for r in rows if r[:2] == (s, c)]
        nodes = sorted({v for i, j, _ in mine for v in (i, j)})
        own = plain(len(nodes), [(nodes.index(i), nodes.index(j), w) for i, j, w in mine], 0.5, "cpm")
        alone = leiden(len(nodes), *(np.array([nodes.index(r[k]) for r in mine]) for k in (0, 1)), np.array([r[2] for r in mine]), 0.5, "cpm", greedy=False)
        assert list(alone) == list(own)
