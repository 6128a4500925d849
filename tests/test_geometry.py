"""Geometry against numpy, domains and batches against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import aligned, batching, domains, geometry


def test_round_trip_of_angles(spark):
    """Residues built from phi and psi have these dihedrals, lengths and angles."""
    rows = [(k, float(phi), float(psi)) for k, (phi, psi) in enumerate([(-57, -47), (-120, 135), (60, 10), (-179, 179)])]
    start = [f"named_struct('x', {x}D, 'y', {y}D, 'z', {z}D) AS {n}" for n, x, y, z in (("n", 0, 0, 0), ("ca", 1.46, 0, 0), ("c", 2.0, 1.4, 0.1))]
    df = spark.createDataFrame(rows, "id int, phi double, psi double").selectExpr("*", *start)
    for r in geometry.extend(df).collect():
        n, ca, c, n2, ca2, c2 = (np.array([p.x, p.y, p.z]) for p in (r.n, r.ca, r.c, r.next_n, r.next_ca, r.next_c))

        def turn(a, b, c, d):
            u, v, w = b - a, c - b, d - c
            return math.degrees(math.atan2(np.linalg.norm(v) * u @ np.cross(v, w), np.cross(u, v) @ np.cross(v, w)))

        assert np.linalg.norm(n2 - c) == pytest.approx(1.335) and np.linalg.norm(c2 - ca2) == pytest.approx(1.522)
        assert turn(n, ca, c, n2) == pytest.approx(r.psi, abs=1e-6) and turn(c, n2, ca2, c2) == pytest.approx(r.phi, abs=1e-6)
        assert abs(turn(ca, c, n2, ca2)) == pytest.approx(180)


def test_straight_line(spark):
    p = lambda x: F.struct(F.lit(x).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    r = spark.range(1).select(geometry.place(p(0.0), p(1.0), p(2.0), 2.0, F.lit(math.pi / 2), F.lit(0.0)).alias("d")).first().d
    assert math.dist((2, 0, 0), (r.x, r.y, r.z)) == pytest.approx(2) and r.x == pytest.approx(2)


def test_rotation(spark):
    points = spark.createDataFrame([(1, 0, 1.0, 0.0, 0.0)], "ref_id int, pos int, x double, y double, z double")
    r = geometry.transform(points, (0, 0, 5), 90, (0, 0, 1)).first()
    assert (r.x, r.y, r.z) == pytest.approx((0, 1, 1))


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(r), int(i), int(j)) for r in range(6) for i, j in rng.integers(0, 40, (22, 2)) if i < j]
    got = {(r.ref_id, r.pos): r.first for r in domains.domain_components(spark.createDataFrame(edges, "ref_id long, i long, j long")).collect()}
    own = {(r, k): k for r, i, j in edges for k in (i, j)}
    for _ in own:
        for r, i, j in edges:
            own[r, i] = own[r, j] = min(own[r, i], own[r, j])
    assert got == own


def test_batches_and_rounds(spark):
    rows = [("a", k, n) for k, n in enumerate([5, 3, 3, 9, 1, 30, 2])] + [("b", 9, 100)]
    out = batching.token_batches(spark.createDataFrame(rows, "lane string, id long, length long"), 40)
    got = {r.id: r.batch for r in out.collect()}
    assert [got[k] for k in (4, 6, 1, 2, 0, 3, 5)] == [0, 0, 0, 0, 1, 2, 3] and got[9] == 0
    items = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    done = batching.adaptive_rounds(items, lambda df, t: df.withColumn("score", F.col("id") * 10.0 + 15 * t), 40, 2, 15)
    assert sorted((r.id, r.score, r.turn) for r in done.collect()) == [(1, 10.0, 0), (2, 50.0, 2), (3, 45.0, 1)]


def test_domain_marks(spark):
    pairs = spark.createDataFrame([(7, "--WWH-KR", "GAWFHPK-")], "ref_id long, q string, s string")
    runs = aligned.edit_runs(pairs)
    assert [tuple(r)[2:] for r in runs.orderBy("run").collect()] == [("M", 2, 0, 3), ("D", 5, 3, 1), ("M", 6, 3, 1), ("I", 7, 4, 1)]
    assert [r.marks for r in aligned.domain_marks(aligned.reference_marks(pairs), runs, 100).collect()] == ["|:|-|-"]


def test_closed_loops(spark):
    rng = np.random.default_rng(9)
    rows = []
    for r in range(5):
        steps = rng.normal(size=(8, 3))
        p = np.cumsum(3.8 * steps / np.linalg.norm(steps, axis=1, keepdims=True), axis=0)
        goal = p[0] + (p[-1] - p[0]) * 0.7 + rng.normal(size=3)
        rows += [(r, k, *map(float, p[k]), *map(float, goal)) for k in range(8)]
    loops = spark.createDataFrame(rows, "ref_id long, pos long, x double, y double, z double, tx double, ty double, tz double")
    out = geometry.close_loops(loops).collect()
    at = {(r.ref_id, r.pos): np.array([r.x, r.y, r.z]) for r in out}
    assert max(r.distance for r in out) <= 0.15
    for r in range(5):
        assert [np.linalg.norm(at[r, k + 1] - at[r, k]) for k in range(7)] == pytest.approx([3.8] * 7)


def test_modularity(spark):
    rng = np.random.default_rng(4)
    edges = [(1, i, j, 1.0) for k in range(3) for i in range(6 * k, 6 * k + 6) for j in range(i + 1, 6 * k + 6)]
    edges += [(1, 2, 8, 0.5), (1, 9, 14, 0.5)] + [(2, int(i), int(j), float(w)) for i, j, w in zip(rng.integers(0, 5, 9), rng.integers(5, 9, 9), rng.random(9))]
    got = {(r.ref_id, r.pos): r.first for r in domains.modularity_domains(spark.createDataFrame(edges, "ref_id long, i long, j long, weight double")).collect()}
    assert all(got[1, k] == k // 6 * 6 for k in range(18))

    def modularity(own, ref):
        w = [e for e in edges if e[0] == ref]
        total, share, inner = sum(e[3] for e in w), {}, 0
        for _, i, j, x in w:
            inner += x / total * (own[i] == own[j])
            for k in (i, j):
                share[own[k]] = share.get(own[k], 0) + x / total / 2
        return inner - sum(v * v for v in share.values())

    own = {p: f for (r, p), f in got.items() if r == 2}
    best = modularity(own, 2)
    for a in set(own.values()):
        for b in set(own.values()):
            assert modularity({p: a if f == b else f for p, f in own.items()}, 2) <= best + 1e-9
