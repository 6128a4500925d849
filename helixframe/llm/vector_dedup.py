"""Embedding near-dedup with iterative quantisation and multi-index Hamming tables.

Rotations that balance binary codes are learned on a bounded sample (``sample``
vectors of the smallest hashes of their ids); every vector is coded.  Sets of
about log2(n) bits of the codes are each the key of a table; a vector looks up
its own key and those one bit away.  Wider keys find fewer pairs, so tables are
added until they find the share ``recall`` of pairs made at the threshold from
the sample, and keys get narrower where ``most`` tables don't.  A pair is taken
in the first table that has it, passes if its codes differ in at most ``radius``
bits (more if pairs at the threshold do), and is reranked with the original
vectors in double precision.  Equal vectors are one node with a multiplicity, so
copies never become pairs.

Defined cases: an empty table gives none; a cosine equal to the threshold links; vectors that are null, zero, hold null or non-finite components,
or a null id link with nothing; vectors link with those of their own length, each
length with rotations and tables of its own; repeated rows count as vectors;
extra columns are left out.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf, lean
from .components import components


def learn_rotation(x: np.ndarray, seed: int, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Mean and rotation: principal directions turned so that signs quantise best."""
    mean = x.mean(axis=0)
    x = x - mean
    _, _, axes = np.linalg.svd(x.T @ x if len(x) else np.eye(x.shape[1]))
    v = x @ axes.T
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1],) * 2))[0]
    for _ in range(rounds):
        b = np.where(v @ r >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(v.T @ b)
        r = left @ right
    return mean, axes.T @ r


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows as doubles, and which of them count."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    ok = n == dim
    out = np.zeros((len(n), dim))
    values = column.filter(pa.array(ok)).flatten().cast(pa.float64())
    out[ok] = values.fill_null(math.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
    ok &= np.isfinite(out).all(axis=1) & (out != 0).any(axis=1)
    return out, ok


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x / big, axis=1, keepdims=True) / big


def _bits(u: np.ndarray, rotations: list, bits: int) -> np.ndarray:
    """The codes' bits, one code after the other."""
    return np.hstack([((u - mean) @ rotation)[:, :bits] >= 0 for mean, rotation in rotations])


def pairs_at(x: np.ndarray, cosine: float, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors at a cosine: the first half towards other rows of ``x``, the second in random directions."""
    rng = np.random.default_rng(seed)
    u, away = x[rng.integers(len(x), size=n)], rng.normal(size=(n, x.shape[1]))
    away[: n // 2] = x[rng.integers(len(x), size=n // 2)]
    away -= (away * u).sum(axis=1, keepdims=True) * u
    norm = np.linalg.norm(away, axis=1, keepdims=True)
    away = np.where(norm > 1e-9, away / np.maximum(norm, 1e-9), 0)
    return u, _unit(cosine * u + math.sqrt(max(0.0, 1 - cosine * cosine)) * away)


def plan_tables(x: np.ndarray, rotations: list, width: int, threshold: float, radius: int, seed: int, recall: float, most: int) -> tuple[list[np.ndarray], int]:
    """The tables' bits among those of the codes, and the radius, by which pairs at the threshold are found."""
    bits = min(x.shape[1], 64)
    rng = np.random.default_rng(seed)
    u, v = pairs_at(x, min(threshold, 1.0), 4000, seed)
    apart = _bits(u, rotations, bits) != _bits(v, rotations, bits)
    radius = max(radius, int(apart.sum(axis=1).max()))
    while True:
        tables, missed, at = [], np.ones(len(u), bool), [c * bits + k * width for c in range(len(rotations)) for k in range(bits // width)]
        while len(tables) < len(at) or max(h.mean() for h in np.array_split(missed, 2)) > 1 - recall and len(tables) < max(most, len(at)):
            k = len(tables)
            tables.append(np.arange(at[k], at[k] + width) if k < len(at) else np.sort(rng.permutation(apart.shape[1])[:width]))
            missed &= apart[:, tables[-1]].sum(axis=1) > 1
        if width == 1 or max(h.mean() for h in np.array_split(missed, 2)) <= 1 - recall:
            return tables, radius
        width -= 1


def near_vectors(df: DataFrame, threshold: float = 0.95, sample: int = 10_000, radius: int = 30, seed: int = 7, recall: float = 0.98, most: int = 48, width: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of each vector of ``df`` (vec_id, embedding); ``width`` of keys, else about log2 of the vectors."""
    spark, shelf = df.sparkSession, Shelf(df.sparkSession, "vectors")
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    plans, tables, word = {}, [], lambda at: sum(1 << int(k) for k in at) - (1 << 64 if 63 in at else 0)
    for dim, n in rows.where("size(embedding) > 0").groupBy(F.size("embedding").alias("d")).count().where("count > 1").orderBy("d").collect():
        fit = rows.where(F.size("embedding") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()
        x, ok = _matrix(fit["embedding"], dim)
        x = _unit(x[ok]) if ok.any() else np.eye(dim)[:1]
        plans[dim] = [learn_rotation(x, seed + k) for k in range(2)]
        bits = min(dim, 64)
        wide = max(1, min(bits, 32, width or max(8, math.ceil(math.log2(n)))))
        chosen, far = plan_tables(x, plans[dim], wide, threshold, radius, seed, recall, most)
        masks = [(word([k for k in t if k < bits]), word([k - bits for k in t if k >= bits])) for t in chosen]
        flips = [[(0, 0), *((word([k]), 0) if k < bits else (0, word([k - bits])) for k in t)] for t in chosen]
        tables.append((dim, far, masks, flips))
    schema = pa.schema([("vec_id", pa.int64()), ("key", pa.binary()), ("unit", pa.list_(pa.float64())), ("c0", pa.int64()), ("c1", pa.int64())])

    @lean
    def code(batches):
        for batch in batches:
            size = batch["embedding"].value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            other = batch["vec_id"].filter(pa.array(~np.isin(size, list(plans))))
            yield pa.RecordBatch.from_arrays([other, *(pa.nulls(len(other), f.type) for f in list(schema)[1:])], schema=schema)
            for dim in set(size.tolist()) & set(plans):
                part = batch.filter(pa.array(size == dim))
                x, ok = _matrix(part["embedding"], dim)
                ok &= part["vec_id"].is_valid().to_numpy(zero_copy_only=False)
                x[~ok] = 1
                u, bits = _unit(x), min(dim, 64)
                b = np.zeros((len(u), 2, 64), np.uint8)
                b[:, :, :bits] = _bits(u, plans[dim], bits).reshape(len(u), 2, bits)
                codes = np.packbits(b, axis=2, bitorder="little").view(np.int64)[:, :, 0]
                keys = [hashlib.blake2b((r + 0.0).tobytes(), digest_size=16).digest() if k else None for r, k in zip(x, ok, strict=True)]
                units = pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1, dtype=np.int32) * dim), pa.array(u.ravel()))
                yield pa.RecordBatch.from_arrays([part["vec_id"], pa.array(keys, pa.binary()), units, *(pa.array(np.ascontiguousarray(codes[:, k])) for k in range(2))], schema=schema)

    coded = shelf.put(rows.mapInArrow(code, "vec_id long, key binary, unit array<double>, c0 long, c1 long"))
    nodes = coded.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("vec_id", "c0", "c1", "unit")).alias("s"), F.count("*").alias("copies"))
    nodes = shelf.put(nodes.selectExpr("s.vec_id AS id", "key", "copies", "s.unit AS unit", "s.c0 AS c0", "s.c1 AS c1"))

    pair = "struct<x:long,y:long>"
    plan = F.broadcast(spark.createDataFrame(tables, f"dim int, far int, masks array<{pair}>, flips array<array<{pair}>>"))
    short = nodes.selectExpr("id", "c0", "c1", "size(unit) AS dim")
    each = F.broadcast(plan.selectExpr("dim", "posexplode(arrays_zip(masks, flips)) AS (t, at)").selectExpr("dim", "t", "at.masks AS m", "at.flips AS f"))
    key = "xxhash64(dim, c0 & m.x, c1 & m.y) AS s"
    home = short.join(each, "dim").selectExpr("dim", "id AS a", "c0 AS a0", "c1 AS a1", "t", key)
    probe = short.join(each, "dim").selectExpr("id AS b", "c0 AS b0", "c1 AS b1", "dim", "t", "m", "explode(f) AS flip")
    probe = probe.selectExpr("b", "b0", "b1", "t", "xxhash64(dim, (b0 ^ flip.x) & m.x, (b1 ^ flip.y) & m.y) AS s")
    pairs = home.join(probe, ["t", "s"]).where("a < b").join(plan.drop("flips"), "dim").where("bit_count(a0 ^ b0) + bit_count(a1 ^ b1) <= far")
    pairs = pairs.where("t = array_position(transform(masks, m -> bit_count((a0 ^ b0) & m.x) + bit_count((a1 ^ b1) & m.y) <= 1), true) - 1").select("a", "b")
    pairs = pairs.join(nodes.selectExpr("id AS a", "unit AS x", "copies AS na"), "a").join(nodes.selectExpr("id AS b", "unit AS y", "copies AS nb"), "b")
    links = shelf.put(pairs.where(f"aggregate(zip_with(x, y, (p, q) -> p * q), 0D, (s, p) -> s + p) >= {threshold!r}D").select("a", "b", "na", "nb"))

    joined = components(links.select("a", "b"), shelf)
    degree = links.selectExpr("a AS id", "nb AS n").unionAll(links.selectExpr("b AS id", "na AS n")).groupBy("id").agg(F.sum("n").alias("n"))
    found = nodes.select("id", "key", "copies").join(degree, "id", "left").join(joined, "id", "left")
    found = shelf.put(found.selectExpr("key", "copies - 1 + coalesce(n, 0L) AS n_links", "coalesce(component, id) AS component_id"))
    shelf.keep(coded, found)
    out = coded.select("vec_id", "key").join(found, "key", "left")
    return out.selectExpr("vec_id", "coalesce(n_links, 0L) AS n_links", "coalesce(component_id, vec_id) AS component_id", "vec_id <=> coalesce(component_id, vec_id) AS kept")
