"""Geometry of chains as column arithmetic: angles, placing, rotation, clashes.

Points are (ref_id, pos, x, y, z); a window runs over one structure, whose length
bounds it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]

#: fixed values: ideal backbone lengths (angstrom) and angles (degrees)
LENGTHS = {"C-N": 1.335, "N-CA": 1.460, "CA-C": 1.522, "C-O": 1.229}
ANGLES = {"CA-C-N": 116.6, "C-N-CA": 121.9, "N-CA-C": 111.2, "CA-C-O": 120.8}
#: fixed values: phi and psi of residues built without a template
TORSIONS = {"extended": (-120.0, 135.0), "helix": (-57.0, -47.0)}


def vector(*columns: str) -> Vector:
    return tuple(F.col(c) for c in columns)


def minus(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def scaled(a: Vector, k) -> Vector:
    return tuple(x * k for x in a)


def plus(*vectors: Vector) -> Vector:
    out = vectors[0]
    for v in vectors[1:]:
        out = tuple(x + y for x, y in zip(out, v, strict=True))
    return out


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def unit(a: Vector) -> Vector:
    return scaled(a, 1 / F.sqrt(dot(a, a)))


def dihedral(a: Vector, b: Vector, c: Vector, d: Vector) -> Column:
    """The angle in degrees between the planes of a, b, c and b, c, d."""
    back, axis, ahead = minus(a, b), minus(c, b), minus(d, c)
    n1, n2 = cross(back, axis), cross(ahead, axis)
    return F.degrees(F.atan2(dot(cross(axis, n1), n2) / F.sqrt(dot(axis, axis)), dot(n1, n2)))


def _point(v: Vector) -> Column:
    return F.struct(*(c.alias(k) for c, k in zip(v, "xyz", strict=True)))


def _fields(p: Column) -> Vector:
    return p["x"], p["y"], p["z"]


def _let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def place(a: Column, b: Column, c: Column, length: float, angle: Column, torsion: Column) -> Column:
    """A point (x, y, z) at ``length`` from c, at ``angle`` to b and at dihedral ``torsion`` to a (radians); a straight line takes any plane."""
    a, b, c = map(_fields, (a, b, c))

    def normal(along: Vector) -> Column:
        n = cross(minus(b, a), along)
        flat = F.abs(along[0]) < 0.9
        side = tuple(F.when(flat, x).otherwise(y) for x, y in (((F.lit(1.0), F.lit(0.0))), (F.lit(0.0), F.lit(1.0)), (F.lit(0.0), F.lit(0.0))))
        straight = dot(n, n) <= 1e-20
        return _point(tuple(F.when(straight, x).otherwise(y) for x, y in zip(cross(side, along), n, strict=True)))

    def at(along: Vector, n: Vector) -> Column:
        steps = (c, scaled(along, -length * F.cos(angle)), scaled(cross(n, along), length * F.sin(angle) * F.cos(torsion)), scaled(n, length * F.sin(angle) * F.sin(torsion)))
        return _point(plus(*steps))

    line = _point(unit(minus(c, b)))
    return _let(line, lambda u: _let(_let(normal(_fields(u)), lambda n: _point(unit(_fields(n)))), lambda n: at(_fields(u), _fields(n))))


def extend(rows: DataFrame, form: str | None = None) -> DataFrame:
    """Rows (n, ca, c: points of a residue; phi, psi in degrees unless ``form`` names them) with the next residue's N, CA, C and O."""
    phi, psi = (F.lit(x) for x in TORSIONS[form]) if form else (F.col("phi"), F.col("psi"))
    for name, of, length, angle, torsion in (
        ("next_n", ("n", "ca", "c"), "C-N", "CA-C-N", psi), ("next_ca", ("ca", "c", "next_n"), "N-CA", "C-N-CA", F.lit(180.0)),
        ("next_c", ("c", "next_n", "next_ca"), "CA-C", "N-CA-C", phi), ("next_o", ("next_n", "next_ca", "next_c"), "C-O", "CA-C-O", F.lit(180.0)),
    ):
        rows = rows.withColumn(name, place(*map(F.col, of), LENGTHS[length], F.lit(math.radians(ANGLES[angle])), F.radians(torsion)))
    return rows


def rotate(p: Vector, axis: Vector, angle: Column) -> Vector:
    """p turned by ``angle`` (radians) about a unit axis through the origin."""
    cos, sin = F.cos(angle), F.sin(angle)
    return plus(scaled(p, cos), scaled(cross(axis, p), sin), scaled(axis, dot(axis, p) * (1 - cos)))


def transform(points: DataFrame, axis: tuple[float, float, float], degrees: float, move: tuple[float, float, float]) -> DataFrame:
    """Points rotated about an axis through the origin, then moved."""
    size = math.sqrt(sum(v * v for v in axis))
    turned = rotate(vector("x", "y", "z"), tuple(F.lit(v / size) for v in axis), F.lit(math.radians(degrees)))
    return points.withColumns({c: v + k for c, v, k in zip("xyz", turned, move, strict=True)})


def secondary_structure(points: DataFrame, letters: DataFrame | None = None) -> DataFrame:
    """(ref_id, residue, phi, psi, ss) of chains whose points are N, CA, C of residue after residue: helix, strand or coil by the backbone's angles; ends are coil.

    With ``letters`` (ref_id, residue, letter) prolines are coil, whatever their angles.
    """
    by = Window.partitionBy("ref_id").orderBy("pos")
    at = lambda k: tuple(F.lead(c, k).over(by) if k >= 0 else F.lag(c, -k).over(by) for c in "xyz")
    rows = points.withColumns({f"{c}{k + 1}": v for k in (-1, 0, 1, 2, 3) for c, v in zip("xyz", at(k), strict=True)}).where("pos % 3 = 0")
    p = [vector(*(f"{c}{k}" for c in "xyz")) for k in range(5)]
    rows = rows.withColumn("phi", dihedral(*p[:4])).withColumn("psi", dihedral(*p[1:])).withColumn("residue", (F.col("pos") / 3).cast("long"))
    phi, psi = F.col("phi"), F.col("psi")
    ss = F.when(phi.between(-100, -30) & psi.between(-80, 0), "H").when((phi <= -40) & (psi >= 90), "E").otherwise("C")
    if letters is not None:
        rows = rows.join(letters.select("ref_id", "residue", "letter"), ["ref_id", "residue"], "left")
        ss = F.when(F.col("letter") == "P", "C").otherwise(ss)
    return rows.select("ref_id", "residue", "phi", "psi", ss.alias("ss"))


def clashes(points: DataFrame, reach: float) -> DataFrame:
    """(ref_id, i, j, distance) of points at least two apart in the chain and closer than ``reach``."""
    return _near(points.withColumn("radius", F.lit(reach / 2)), reach, 1.0)


def atom_clashes(atoms: DataFrame, widest: float = 1.7, share: float = 0.72) -> DataFrame:
    """(ref_id, i, j, distance) of atoms (ref_id, pos, x, y, z, radius), at least two apart in ``pos``, closer than a share of their radii's sum; no radius exceeds ``widest``."""
    return _near(atoms.where(F.col("radius") <= widest), 2 * share * widest, share)


def _near(points: DataFrame, reach: float, share: float) -> DataFrame:
    """Pairs by cells as wide as the reach: each point meets those of its own and the 26 cells around, so rows are linear in the points where these keep some distance."""
    cell = [F.floor(F.col(c) / reach).alias(f"c{c}") for c in "xyz"]
    a = points.select("ref_id", F.col("pos").alias("i"), *(F.col(c).alias(f"a{c}") for c in "xyz"), F.col("radius").alias("ar"), *cell)
    b = points.select("ref_id", F.col("pos").alias("j"), *(F.col(c).alias(f"b{c}") for c in "xyz"), F.col("radius").alias("br"), *cell)
    for c in "xyz":
        a = a.withColumn(f"c{c}", F.explode(F.sequence(F.col(f"c{c}") - 1, F.col(f"c{c}") + 1)))
    d = "sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by) + (az - bz) * (az - bz))"
    rows = a.join(b, ["ref_id", "cx", "cy", "cz"]).where("j >= i + 2").withColumn("distance", F.expr(d))
    return rows.where(F.col("distance") < share * (F.col("ar") + F.col("br"))).select("ref_id", "i", "j", "distance")


def trim_template(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(ref_id, pos, letter, x, y, z): a template's points under the query's letters, from ``lead`` on; spans are (ref_id, lead, q); positions outside go."""
    rows = points.join(spans, "ref_id").where("pos >= lead AND pos < lead + length(q)")
    return rows.selectExpr("ref_id", "pos - lead AS pos", "substring(q, CAST(pos - lead AS INT) + 1, 1) AS letter", "x", "y", "z")


def rebuild(points: DataFrame, runs: DataFrame, step: float = 3.8) -> DataFrame:
    """(ref_id, q_pos, from_ref, x, y, z): points copied under matches (runs as of ``aligned.edit_runs``), deletions left out, insertions on the line between their neighbours."""
    from .structures import interpolate

    each = F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")))
    q = runs.where("op <> 'D'").select("ref_id", "op", "ref_pos", "q_pos", each.alias("k")).selectExpr("ref_id", "q_pos + k AS pos", "IF(op = 'M', ref_pos + k, NULL) AS at")
    rows = q.join(points.selectExpr("ref_id", "pos AS at", "x", "y", "z"), ["ref_id", "at"], "left").withColumn("from_ref", F.col("x").isNotNull())
    for c in "xyz":
        rows = interpolate(rows, "from_ref", c, step)
    return rows.selectExpr("ref_id", "pos AS q_pos", "from_ref", "x", "y", "z")


def close_loops(loops: DataFrame, tolerance: float = 0.15, turns: int = 200) -> DataFrame:
    """(ref_id, pos, x, y, z, distance) of loops whose last point is brought to its target by cyclic coordinate descent.

    Loops are (ref_id, pos, x, y, z, tx, ty, tz): points in order, the target on each
    row.  Each bond in turn is the axis about which all that follows turns as close to
    the target as it can; a loop is one group, bounded by its length.
    """
    import numpy as np
    import pyarrow as pa

    schema = pa.schema([("ref_id", pa.int64()), ("pos", pa.int64()), *((c, pa.float64()) for c in ("x", "y", "z", "distance"))])

    def close(table):
        table = table.sort_by("pos")
        p = np.stack([table[c].to_numpy() for c in "xyz"], axis=1)
        goal = np.array([table[c][0].as_py() for c in ("tx", "ty", "tz")])
        for _ in range(turns):
            if np.linalg.norm(p[-1] - goal) <= tolerance:
                break
            for k in range(len(p) - 2):
                axis = p[k + 1] - p[k]
                size = np.linalg.norm(axis)
                if size < 1e-10:
                    continue
                axis = axis / size
                have, want = (v - (v @ axis) * axis for v in (p[-1] - p[k], goal - p[k]))
                angle = np.arctan2(np.cross(axis, have) @ want, have @ want)
                rest = p[k + 2 :] - p[k]
                p[k + 2 :] = p[k] + rest * np.cos(angle) + np.cross(axis, rest) * np.sin(angle) + np.outer(rest @ axis, axis) * (1 - np.cos(angle))
        off = np.full(len(p), np.linalg.norm(p[-1] - goal))
        return pa.Table.from_arrays([table["ref_id"].combine_chunks(), table["pos"].combine_chunks(), *(pa.array(p[:, k]) for k in range(3)), pa.array(off)], schema=schema)

    rows = loops.selectExpr("CAST(ref_id AS LONG) AS ref_id", "CAST(pos AS LONG) AS pos", *(f"CAST({c} AS DOUBLE) AS {c}" for c in ("x", "y", "z", "tx", "ty", "tz")))
    return rows.groupBy("ref_id").applyInArrow(close, "ref_id long, pos long, x double, y double, z double, distance double")
