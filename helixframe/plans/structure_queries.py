"""Queries over chains and error matrices, with their SQL: embeddings are read as points (xyz, 21 to a vector) and as 8 x 8 cells."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import aligned, domains, geometry, loops, structures
from .aligned_queries import _RUN, _pairs
from .queries import _POINTS, _cells, _points


def secondary_structure(s, d):
    out = geometry.secondary_structure(_points(s, d))
    return out.select("ref_id", "residue", F.round("phi", 3).alias("phi"), F.round("psi", 3).alias("psi"), "ss")


def structure_counts(s, d):
    return geometry.secondary_structure(_points(s, d)).groupBy("ss").agg(F.count("*").alias("n"))


def placed_residue(s, d):
    """The residue that follows a vector's first three points in extended form."""
    rows = _points(s, d).where("pos < 3").groupBy("ref_id").agg(*(F.expr(f"max(struct(x, y, z)) FILTER (WHERE pos = {k})").alias(n) for k, n in enumerate(("n", "ca", "c"))))
    out = geometry.extend(rows, "extended")
    return out.select("ref_id", *(F.round(f"next_{a}.{c}", 4).alias(f"{a}_{c}") for a in ("n", "ca", "c", "o") for c in "xyz"))


def rigid_transform(s, d):
    out = geometry.transform(_points(s, d), (1.0, 2.0, 2.0), 30.0, (1.0, -2.0, 0.5))
    return out.select("ref_id", "pos", *(F.round(c, 6).alias(c) for c in "xyz"))


def clash_pairs(s, d):
    return geometry.clashes(_points(s, d), 0.8).select("ref_id", "i", "j", F.round("distance", 6).alias("distance"))


def clash_flags(s, d):
    p = _points(s, d)
    hit = geometry.clashes(p, 0.8).select("ref_id").distinct().withColumn("clash", F.lit(True))
    return p.select("ref_id").distinct().join(hit, "ref_id", "left").na.fill(False)


_RADII = (("N", 1.55), ("CA", 1.7), ("C", 1.7))


def atom_clashes(s, d):
    """Points as N, CA, C in turn with their radii, 0.4 of whose sum is too near."""
    radius = F.element_at(F.array(*(F.lit(r) for _, r in _RADII)), (F.col("pos") % 3 + 1).cast("int"))
    out = geometry.atom_clashes(_points(s, d).withColumn("radius", radius), share=0.4)
    return out.select("ref_id", "i", "j", F.round("distance", 6).alias("distance"))


def proline_coil(s, d):
    """Secondary structure where residues have letters: each fifth one, by structure in turn, is a proline."""
    p = _points(s, d)
    letters = p.where("pos % 3 = 0").selectExpr("ref_id", "CAST(pos DIV 3 AS LONG) AS residue", "IF((pos DIV 3 + ref_id) % 5 = 0, 'P', 'A') AS letter")
    return geometry.secondary_structure(p, letters).select("ref_id", "residue", "ss")


def _ends(s, d):
    """(ref_id, k, p): each vector's points as structs by place."""
    p = _points(s, d)
    return p.groupBy("ref_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x", "y", "z"))), lambda v: F.struct(*((v[c] * 4).alias(c) for c in "xyz"))).alias("p"))


def closed_insertions(s, d):
    """An insertion of three to six residues behind each vector's first three points, towards its fourth."""
    letters = F.expr("substring('AVLMKD', 1, CAST(3 + ref_id % 4 AS INT))")
    rows = _ends(s, d).select("ref_id", letters.alias("letters"), F.lit("C").alias("ss"), *(F.col("p")[k].alias(c) for k, c in enumerate(("n", "ca", "c", "target"))))
    return loops.close_insertions(rows).select("ref_id", F.round("gap", 1).alias("gap"), "status", F.size("atoms").cast("long").alias("n"))


def placed_fragments(s, d):
    """Each vector's points but its ends as a fragment between these."""
    rows = _ends(s, d).select("ref_id", F.slice("p", 2, 19).alias("points"), F.col("p")[0].alias("pre"), F.col("p")[20].alias("post"))
    return loops.place_fragments(rows).select("ref_id", F.round("off", 3).alias("off"), "status", F.size("points").cast("long").alias("n"))


_EDITS = (("MKVLA", "MKVLA"), ("MK-LA", "MKVLA"), ("MKAVLA", "MK-VLA"), ("AMKVLA", "-MKVLA"), ("MKVLAF", "MKVLAF"), ("MKAAAAAAVLA", "MK------VLA"))


def class_b_builds(s, d):
    """Chains built along edits, by vector in turn, over its points as N, CA, C and O of five residues."""
    p = _points(s, d)
    edits = F.array(*(F.struct(F.lit(q).alias("q"), F.lit(t).alias("s")) for q, t in _EDITS))
    pairs = p.select("ref_id").distinct().select("ref_id", F.element_at(edits, (F.col("ref_id") % len(_EDITS) + 1).cast("int")).alias("e")).select("ref_id", "e.q", "e.s")
    atom = F.element_at(F.array(*map(F.lit, ("N", "CA", "C", "O"))), (F.col("pos") % 4 + 1).cast("int"))
    backbone = p.where("pos < 20").select("ref_id", F.expr("pos DIV 4").alias("res"), atom.alias("atom"), *(F.col(c) * 3 for c in "xyz")).toDF("ref_id", "pos", "atom", "x", "y", "z")
    ss = F.when(F.col("x") > 1.5, "E").when(F.col("x") < -1.5, "H").otherwise("C")
    states = backbone.where("atom = 'CA'").select("ref_id", "pos", ss.alias("ss"))
    return loops.build_class_b(pairs, backbone, states).select("ref_id", "status", F.size("atoms").cast("long").alias("n"))


def segment_centroids(s, d):
    out = structures.segment_centroids(structures.chain_breaks(_points(s, d), 1.5))
    return out.select("ref_id", F.col("segment").cast("long").alias("segment"), *(F.round(f"c{c}", 6).alias(f"c{c}") for c in "xyz"), "nearest")


def pae_subsample(s, d):
    c = _cells(s, d).where("i % 2 = 0 AND j % 2 = 0")
    return c.selectExpr("ref_id", "i DIV 2 AS i", "j DIV 2 AS j", "round(pae, 4) AS pae")


def _graph(s, d):
    return structures.pae_edges(_cells(s, d), 1.0)


def domain_components(s, d):
    return domains.domain_components(_graph(s, d))


def domains_by_size(s, d):
    return domains.by_size(domains.domain_components(_graph(s, d)))


def domain_best(s, d):
    marks = _cells(s, d).where("j = 0").select("ref_id", F.col("i").alias("ref_pos"), F.when(F.col("pae") > 0.8, "|").otherwise(".").alias("mark"))
    return domains.best_over_cutoffs(_cells(s, d), marks, (0.4, 0.7, 1.0))


def domain_status(s, d):
    n = domains.by_size(domains.domain_components(_graph(s, d)))
    return domains.qualified(n.withColumn("plddt", F.when(F.col("first") > 0, F.col("n") * 20.0)), 4, 90.0).select("ref_id", "first", "n", "status")


def trimmed_template(s, d):
    p = _points(s, d)
    spans = p.select("ref_id").distinct().withColumn("lead", F.col("ref_id") % 7).withColumn("q", F.lit("MKLVFACDEFGH"))
    return geometry.trim_template(p, spans).select("ref_id", "pos", "letter", F.round("x", 6).alias("x"))


def rebuilt_chain(s, d):
    """Chains rebuilt along made-up edits: a deletion of two and an insertion of three positions."""
    p = _points(s, d)
    edits = [(0, "M", 0, 0, 6), (1, "D", 6, 6, 2), (2, "M", 8, 6, 5), (3, "I", 13, 11, 3), (4, "M", 13, 14, 8)]
    each = F.array(*(F.struct(*(F.lit(v).cast("long" if k != "op" else "string").alias(k) for k, v in zip(("run", "op", "ref_pos", "q_pos", "n"), e, strict=True))) for e in edits))
    runs = p.select("ref_id").distinct().select("ref_id", F.inline(each))
    return geometry.rebuild(p, runs).select("ref_id", "q_pos", "from_ref", *(F.round(c, 6).alias(c) for c in "xyz"))


def edit_sizes(s, d):
    """Whether an alignment's longest indel and number of indels leave it buildable."""
    r = aligned.edit_runs(_pairs(s, d)).where("op <> 'M'")
    return r.groupBy("ref_id").agg(F.count("*").alias("indels"), F.max("n").alias("longest"))


_NAMES = (secondary_structure, structure_counts, placed_residue, rigid_transform, clash_pairs, clash_flags, atom_clashes, proline_coil, closed_insertions, placed_fragments, class_b_builds, segment_centroids, pae_subsample, domain_components, domains_by_size, domain_best, domain_status, trimmed_template, rebuilt_chain, edit_sizes)
QUERIES = {f.__name__: f for f in _NAMES}


def _sub(a: str, b: str) -> list[str]:
    return [f"({c}{a} - {c}{b})" for c in "xyz"]


def _x(a: list[str], b: list[str]) -> list[str]:
    return [f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})", f"({a[0]} * {b[1]} - {a[1]} * {b[0]})"]


def _dot(a: list[str], b: list[str]) -> str:
    return f"({a[0]} * {b[0]} + {a[1]} * {b[1]} + {a[2]} * {b[2]})"


def _torsion(a: str, b: str, c: str, e: str) -> str:
    axis = _sub(c, b)
    n1, n2 = _x(_sub(a, b), axis), _x(_sub(e, c), axis)
    return f"degrees(atan2({_dot(_x(axis, n1), n2)} / sqrt({_dot(axis, axis)}), {_dot(n1, n2)}))"


_SHIFTED = ", ".join(f"lag({c}, 1) OVER w AS {c}0, {c} AS {c}1, lead({c}, 1) OVER w AS {c}2, lead({c}, 2) OVER w AS {c}3, lead({c}, 3) OVER w AS {c}4" for c in "xyz")
_ANGLES = _POINTS + f""", l AS (SELECT ref_id, pos, {_SHIFTED} FROM p WINDOW w AS (PARTITION BY ref_id ORDER BY pos)),
a AS (SELECT ref_id, pos // 3 AS residue, {_torsion('0', '1', '2', '3')} AS phi, {_torsion('1', '2', '3', '4')} AS psi FROM l WHERE pos % 3 = 0),
s AS (SELECT *, CASE WHEN phi BETWEEN -100 AND -30 AND psi BETWEEN -80 AND 0 THEN 'H' WHEN phi <= -40 AND psi >= 90 THEN 'E' ELSE 'C' END AS ss FROM a)"""


def _placed() -> str:
    """Each atom in a step of its own: unit axis, normal, third axis, position."""
    steps, tables = [("n", ("P", "Q", "R"), "C-N", "CA-C-N", 135.0), ("ca", ("Q", "R", "n"), "N-CA", "C-N-CA", 180.0), ("c", ("R", "n", "ca"), "CA-C", "N-CA-C", -120.0), ("o", ("n", "ca", "c"), "C-O", "CA-C-O", 180.0)], []
    at, have = "t0", "*"
    for k, (name, (a, b, c), length, angle, torsion) in enumerate(steps):
        size, bend, turn = geometry.LENGTHS[length], math.radians(geometry.ANGLES[angle]), math.radians(torsion)
        u = _sub(c, b)
        tables.append(f"u{k} AS (SELECT {have}, " + ", ".join(f"{u[i]} / sqrt({_dot(u, u)}) AS {v}u" for i, v in enumerate("xyz")) + f" FROM {at})")
        n = _x(_sub(b, a), ["xu", "yu", "zu"])
        tables.append(f"n{k} AS (SELECT *, " + ", ".join(f"{n[i]} / sqrt({_dot(n, n)}) AS {v}v" for i, v in enumerate("xyz")) + f" FROM u{k})")
        m = _x(["xv", "yv", "zv"], ["xu", "yu", "zu"])
        along, side, up = -size * math.cos(bend), size * math.sin(bend) * math.cos(turn), size * math.sin(bend) * math.sin(turn)
        tables.append(f"t{k + 1} AS (SELECT * EXCLUDE (xu, yu, zu, xv, yv, zv), " + ", ".join(f"{v}{c} + ({along!r}::DOUBLE) * {v}u + ({side!r}::DOUBLE) * {m[i]} + ({up!r}::DOUBLE) * {v}v AS {v}{name}" for i, v in enumerate("xyz")) + f" FROM n{k})")
        at = f"t{k + 1}"
    first = ", ".join(f"max({c}) FILTER (pos = {k}) AS {c}{n}" for k, n in enumerate("PQR") for c in "xyz")
    columns = ", ".join(f"round({c}{a}, 4) AS {a}_{c}" for a in ("n", "ca", "c", "o") for c in "xyz")
    return _POINTS + f", t0 AS (SELECT ref_id, {first} FROM p WHERE pos < 3 GROUP BY ref_id), {', '.join(tables)} SELECT ref_id, {columns} FROM {at}"


def _turned() -> str:
    axis, (cos, sin) = [v / 3 for v in (1.0, 2.0, 2.0)], (math.cos(math.radians(30)), math.sin(math.radians(30)))
    out, move = [], (1.0, -2.0, 0.5)
    for i in range(3):
        row = []
        for j in range(3):
            skew = {(0, 1): -axis[2], (0, 2): axis[1], (1, 0): axis[2], (1, 2): -axis[0], (2, 0): -axis[1], (2, 1): axis[0]}.get((i, j), 0.0)
            row.append(axis[i] * axis[j] * (1 - cos) + sin * skew + (cos if i == j else 0.0))
        out.append(" + ".join(f"({v!r}::DOUBLE) * {c}" for v, c in zip(row, "xyz", strict=True)) + f" + ({move[i]!r}::DOUBLE)")
    return ", ".join(f"round({e}, 6) AS {c}" for e, c in zip(out, "xyz", strict=True))


_CELLS = "c AS (SELECT vec_id AS ref_id, k // 8 AS i, k % 8 AS j, abs(embedding[k + 1]::DOUBLE) * 10 AS pae FROM (SELECT *, unnest(range(0, 64)) AS k FROM embeddings))"
_LINKED = f"""WITH RECURSIVE {_CELLS}, e AS (SELECT ref_id, i, j FROM c WHERE pae < 1 AND i < j UNION SELECT ref_id, j, i FROM c WHERE pae < 1 AND i < j),
r AS (SELECT DISTINCT ref_id, i AS pos, i AS first FROM e UNION SELECT r.ref_id, r.pos, e.j FROM r JOIN e ON e.ref_id = r.ref_id AND e.i = r.first),
m AS (SELECT ref_id, min(first) AS first, pos FROM r GROUP BY ref_id, pos), n AS (SELECT ref_id, first, count(*) AS n FROM m GROUP BY 1, 2)"""
_DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
_CLASH = _POINTS + f", h AS (SELECT a.ref_id, a.pos AS i, b.pos AS j, {_DIST} AS distance FROM p a JOIN p b ON a.ref_id = b.ref_id AND b.pos >= a.pos + 2 WHERE {_DIST} < 0.8)"
_MISSING = ", ".join(f"round(CASE WHEN q_pos < 11 OR q_pos > 13 THEN {c} ELSE l{c} + (r{c} - l{c}) * (q_pos - 10) / 4.0::DOUBLE END, 6) AS {c}" for c in "xyz")

SQL = {
    "secondary_structure": _ANGLES + " SELECT ref_id, residue, round(phi, 3) AS phi, round(psi, 3) AS psi, ss FROM s",
    "structure_counts": _ANGLES + " SELECT ss, count(*) AS n FROM s GROUP BY ss",
    "placed_residue": _placed(),
    "rigid_transform": _POINTS + f" SELECT ref_id, pos, {_turned()} FROM p",
    "clash_pairs": _CLASH + " SELECT ref_id, i, j, round(distance, 6) AS distance FROM h",
    "clash_flags": _CLASH + " SELECT DISTINCT ref_id, ref_id IN (SELECT ref_id FROM h) AS clash FROM p",
    "atom_clashes": _POINTS + f""", r AS (SELECT *, [1.55, 1.7, 1.7][(pos % 3 + 1)::INT]::DOUBLE AS radius FROM p)
SELECT a.ref_id, a.pos AS i, b.pos AS j, round({_DIST}, 6) AS distance FROM r a JOIN r b ON a.ref_id = b.ref_id AND b.pos >= a.pos + 2 WHERE {_DIST} < 0.4::DOUBLE * (a.radius + b.radius)""",
    "proline_coil": _ANGLES + " SELECT ref_id, residue, CASE WHEN (residue + ref_id) % 5 = 0 THEN 'C' ELSE ss END AS ss FROM s",
    "segment_centroids": _POINTS + """, s AS (SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w) + (z - lag(z) OVER w) * (z - lag(z) OVER w)) AS step FROM p WINDOW w AS (PARTITION BY ref_id ORDER BY pos)),
b AS (SELECT *, least(sum(CASE WHEN step > 1.5 THEN 1 ELSE 0 END) OVER (PARTITION BY ref_id ORDER BY pos), 25)::BIGINT AS segment FROM s),
m AS (SELECT *, avg(x) OVER g AS cx, avg(y) OVER g AS cy, avg(z) OVER g AS cz FROM b WINDOW g AS (PARTITION BY ref_id, segment)),
d AS (SELECT *, round((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz), 9) AS dd FROM m)
SELECT ref_id, segment, round(any_value(cx), 6) AS cx, round(any_value(cy), 6) AS cy, round(any_value(cz), 6) AS cz, (min((dd, pos)))[2] AS nearest FROM d GROUP BY 1, 2""",
    "pae_subsample": f"WITH {_CELLS} SELECT ref_id, i // 2 AS i, j // 2 AS j, round(pae, 4) AS pae FROM c WHERE i % 2 = 0 AND j % 2 = 0",
    "domain_components": _LINKED + " SELECT ref_id, first, pos FROM m",
    "domains_by_size": _LINKED + " SELECT ref_id, first, n, row_number() OVER (PARTITION BY ref_id ORDER BY n DESC, first) AS place FROM n",
    "domain_best": f"""WITH RECURSIVE {_CELLS}, k AS (SELECT unnest([0.4::DOUBLE, 0.7::DOUBLE, 1.0::DOUBLE]) AS cutoff),
e AS (SELECT ref_id, cutoff, i, j FROM c JOIN k ON pae < cutoff WHERE i < j UNION SELECT ref_id, cutoff, j, i FROM c JOIN k ON pae < cutoff WHERE i < j),
r AS (SELECT DISTINCT ref_id, cutoff, i AS pos, i AS first FROM e UNION SELECT r.ref_id, r.cutoff, r.pos, e.j FROM r JOIN e ON e.ref_id = r.ref_id AND e.cutoff = r.cutoff AND e.i = r.first),
m AS (SELECT ref_id, cutoff, min(first) AS first, pos FROM r GROUP BY ref_id, cutoff, pos),
s AS (SELECT m.ref_id, cutoff, first, count(*) AS n, count(*) FILTER (c.pae > 0.8) AS score FROM m LEFT JOIN c ON c.ref_id = m.ref_id AND c.i = m.pos AND c.j = 0 GROUP BY 1, 2, 3)
SELECT ref_id, cutoff, first, n, score FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, cutoff, first) AS k FROM s) WHERE k = 1""",
    "domain_status": _LINKED + " SELECT ref_id, first, n, CASE WHEN n < 4 THEN 'domain_too_small' WHEN first > 0 AND n * 20 < 90 THEN 'low_plddt' ELSE 'ok' END AS status FROM n",
    "trimmed_template": _POINTS + " SELECT ref_id, pos - ref_id % 7 AS pos, substr('MKLVFACDEFGH', (pos - ref_id % 7 + 1)::INT, 1) AS letter, round(x, 6) AS x FROM p WHERE pos >= ref_id % 7 AND pos < ref_id % 7 + 12",
    "rebuilt_chain": _POINTS + f""", q AS (SELECT ref_id, q_pos, CASE WHEN q_pos < 6 THEN q_pos WHEN q_pos < 11 THEN q_pos + 2 WHEN q_pos > 13 THEN q_pos - 1 END AS src
  FROM (SELECT DISTINCT ref_id FROM p) CROSS JOIN (SELECT unnest(range(0, 22)) AS q_pos)),
f AS (SELECT q.ref_id, q_pos, src, p.x, p.y, p.z, l.x AS lx, l.y AS ly, l.z AS lz, r.x AS rx, r.y AS ry, r.z AS rz FROM q LEFT JOIN p ON p.ref_id = q.ref_id AND p.pos = src
  JOIN p l ON l.ref_id = q.ref_id AND l.pos = 12 JOIN p r ON r.ref_id = q.ref_id AND r.pos = 13)
SELECT ref_id, q_pos, src IS NOT NULL AS from_ref, {_MISSING} FROM f""",
    "edit_sizes": _RUN + " SELECT ref_id, count(*) AS indels, max(n) AS longest FROM r WHERE op <> 'M' GROUP BY ref_id",
}
