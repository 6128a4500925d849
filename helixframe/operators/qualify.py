"""Domains of a template that an alignment may be built on: candidates as rows, gates before scores, one status a row.

An alignment row is (ref_id, structure, q, s): two gapped strings, the second the
structure's sequence.  Several rows may share a structure, whose communities are
found once; a row meets its structure's residues and candidates as arrays, and is read in one piece.  Structures are (structure, pos, ss, plddt), a row a residue; error cells (structure, i, j, pae)
may stand for ``step`` residues each.

Statuses: ``no_pdb`` without residues; ``no_domain`` where no candidate passes the
gates; of those that pass, the one with most equal residues is taken (at the smaller
cutoff, then the larger, then the one that begins first, among equals), and is
``domain_too_small`` or ``domain_low_plddt`` if it is; else ``ok``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alignment
from . import aligned, domains, leiden

CUTOFFS = (5.0, 8.0, 12.0)


def candidate_edges(cells: DataFrame, lengths: DataFrame, cutoffs: tuple[float, ...] = CUTOFFS, power: float = 1.0, resolution: float = 1.0, resolution_large: float = 2.0, large: int = 500) -> DataFrame:
    """(structure, cutoff, i, j, weight, resolution): each cell below a cutoff is an edge, so two for a pair whose cells both are; larger structures have a resolution of their own.

    Resolutions are hundredths, as error weights are small numbers.
    """
    cut = F.explode(F.array(*map(F.lit, sorted(set(cutoffs))))).alias("cutoff")
    rows = cells.where((F.col("pae") < max(cutoffs)) & (F.col("i") != F.col("j"))).select("structure", "i", "j", "pae", cut).where("pae < cutoff")
    value = F.when(F.col("n") > large, resolution_large).otherwise(resolution) / 100
    rows = rows.join(lengths.select("structure", value.alias("resolution")), "structure")
    return rows.select("structure", "cutoff", "i", "j", (1 / F.pow(F.greatest("pae", F.lit(1e-6)), F.lit(power))).alias("weight"), "resolution")


def spans(found: DataFrame, lengths: DataFrame, cutoffs: tuple[float, ...] = CUTOFFS) -> DataFrame:
    """(structure, cutoff, first, start, stop): the residues from ``start`` up to ``stop`` that each cell stands for, and cells without an edge alone; lengths are (structure, n, step)."""
    cut = F.explode(F.array(*map(F.lit, sorted(set(cutoffs))))).alias("cutoff")
    every = lengths.where("n > 0").select("structure", "n", "step", cut).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) DIV step"))).alias("at"))
    rows = every.join(found.withColumnRenamed("pos", "at"), ["structure", "cutoff", "at"], "left")
    start, stop = F.col("at") * F.col("step"), F.least((F.col("at") + 1) * F.col("step"), F.col("n"))
    return rows.select("structure", "cutoff", (F.coalesce("first", "at") * F.col("step")).alias("first"), start.alias("start"), stop.alias("stop"))


def expanded(found: DataFrame, lengths: DataFrame, cutoffs: tuple[float, ...] = CUTOFFS) -> DataFrame:
    """(structure, cutoff, first, pos): ``spans`` residue by residue."""
    return spans(found, lengths, cutoffs).select("structure", "cutoff", "first", F.explode(F.sequence("start", F.col("stop") - 1)).alias("pos"))


def candidate_domains(cells: DataFrame, lengths: DataFrame, cutoffs: tuple[float, ...] = CUTOFFS, **how) -> DataFrame:
    """(structure, cutoff, first, pos): the Leiden communities of each structure at each cutoff."""
    found = leiden.communities(candidate_edges(cells, lengths, cutoffs, **how), ("structure", "cutoff"))
    return expanded(found, lengths, cutoffs)


def component_domains(cells: DataFrame, lengths: DataFrame, cutoffs: tuple[float, ...] = CUTOFFS) -> DataFrame:
    """``candidate_domains`` with connected components instead of communities."""
    return component_spans(cells, lengths, cutoffs).select("structure", "cutoff", "first", F.explode(F.sequence("start", F.col("stop") - 1)).alias("pos"))


def component_spans(cells: DataFrame, lengths: DataFrame, cutoffs: tuple[float, ...] = CUTOFFS) -> DataFrame:
    """``component_domains`` as ``spans``."""
    edges, place = candidate_edges(cells, lengths, cutoffs), sorted(set(cutoffs))
    number = F.coalesce(*(F.when(F.col("cutoff") == c, F.lit(k)) for k, c in enumerate(place)))
    # a structure's cutoffs are graphs of their own: their nodes are numbered apart
    apart = edges.select(F.col("structure").alias("ref_id"), *((F.col(c) * len(place) + number).alias(c) for c in "ij"))
    named = F.element_at(F.array(*map(F.lit, place)), (F.col("first") % len(place) + 1).cast("int"))
    found = domains.domain_components(apart).select(F.col("ref_id").alias("structure"), named.alias("cutoff"), F.expr(f"first DIV {len(place)}").alias("first"), F.expr(f"pos DIV {len(place)}").alias("pos"))
    return spans(found, lengths, cutoffs)


_RESIDUES = {"r_pos": "pos", "r_strand": "strand", "r_plddt": "plddt"}
_SPANS = {"c_cutoff": "cutoff", "c_first": "first", "c_start": "start", "c_stop": "stop"}


def _with_profiles(pairs: DataFrame, residues: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Each of ``pairs`` with its structure's residues, and candidates, as arrays beside each other; null where there are none."""
    strand = F.coalesce(F.col("ss") == "E", F.lit(False)).alias("strand")
    one = residues.select("structure", F.col("pos").cast("long").alias("pos"), strand, F.col("plddt").cast("double").alias("plddt"))
    one = one.groupBy("structure").agg(F.sort_array(F.collect_list(F.struct("pos", "strand", "plddt"))).alias("x"))
    rows = pairs.select("ref_id", "structure", "q", "s").join(one.select("structure", *(F.col("x")[v].alias(k) for k, v in _RESIDUES.items())), "structure", "left")
    if candidates is not None:
        if "start" not in candidates.columns:
            candidates = candidates.select("structure", "cutoff", "first", F.col("pos").alias("start"), (F.col("pos") + 1).alias("stop"))
        two = candidates.select("structure", F.col("cutoff").cast("double").alias("cutoff"), *(F.col(c).cast("long").alias(c) for c in ("first", "start", "stop")))
        two = two.groupBy("structure").agg(F.sort_array(F.collect_list(F.struct(*_SPANS.values()))).alias("x"))
        rows = rows.join(two.select("structure", *(F.col("x")[v].alias(k) for k, v in _SPANS.items())), "structure", "left")
    return rows


def _lists(batch, names) -> list[list]:
    """Of each row its arrays, or None; nulls within become NaN."""
    columns = []
    for name in names:
        c = batch[name]
        bounds, values = c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)
        columns.append([None if gone else values[x:y] for x, y, gone in zip(bounds[:-1].tolist(), bounds[1:].tolist(), c.is_null().to_pylist(), strict=True)])
    return columns


class _Walk:
    """What an alignment has along its structure's positions up to ``size``: marks in order, whether they are insertions, and bad ones, indels within a strand."""

    def __init__(self, q: str, s: str, strands: np.ndarray, size: int):
        raw = [np.frombuffer(x.encode("ascii"), np.uint8) for x in (q, s)]
        c = aligned._Chunk(np.zeros(1, np.int64), *raw, np.array([len(q)]))
        first, n = c.runs()
        op, ref = c.op[first], c.ref[first]
        strand = np.zeros(max(size, int(strands.max(initial=-1)) + 1) + 2, bool)  # one place more at each end
        strand[strands[strands >= 0] + 1] = True
        left, right = (strand[np.minimum(p + 1, len(strand) - 1)] for p in (ref - 1, ref + np.where(op == 1, n, 0)))
        near = int(np.searchsorted(c.ref, size, "right"))
        self.pos, self.mark, self.inserted = c.ref[:near], c.marks()[:near], c.op[:near] == 2
        self.bad = np.repeat((op > 0) & left & right, n)[:near]
        self.size = size

    def of(self, spans) -> np.ndarray:
        """The columns that touch the positions; an insertion touches with either neighbour."""
        inside = np.zeros(self.size + 2, bool)  # position p at p + 1
        for start, stop in spans:
            inside[start + 1 : stop + 1] = True
        return inside[self.pos + 1] | (self.inserted & inside[self.pos])


def _windows_pass(marks: np.ndarray, window: int, threshold: float) -> bool:
    return alignment.windows_pass(marks.tobytes().decode(), window, threshold)


def _best(q, s, residues, spans, window: int, threshold: float):
    """(cutoff, first, n, score, plddt) of the best candidate with no indel within a strand whose windows all pass, or None; a residue without a plddt doesn't count in its mean."""
    if not q or not s or spans is None:
        return None
    pos, strand, plddt = residues if residues[0] is not None else (np.empty(0, np.int64), np.empty(0, bool), np.empty(0))
    groups: dict[tuple, list] = {}
    for cutoff, first, start, stop in zip(*(x.tolist() for x in spans), strict=True):
        groups.setdefault((cutoff, first), []).append((start, stop))
    walk = _Walk(q, s, pos[strand.astype(bool)], int(spans[3].max()))
    top = None
    for (cutoff, first), group in groups.items():
        at = walk.of(group)
        marks = walk.mark[at]
        if walk.bad[at].any() or not _windows_pass(marks, window, threshold):
            continue
        n, score = sum(y - x for x, y in group), int((marks == 124).sum())
        key = (-score, cutoff, -n, first)
        if top is None or key < top[0]:
            top = key, group
    if top is None:
        return None
    (score, cutoff, n, first), group = top
    values = np.concatenate([plddt[(pos >= x) & (pos < y)] for x, y in group])
    values = values[~np.isnan(values)]
    return cutoff, first, -n, -score, float(values.mean()) if len(values) else None


def _status(n: Column, plddt: Column, least: int, sure: float) -> Column:
    return F.when(n.isNull(), "no_domain").when(n < least, "domain_too_small").when(plddt < sure, "domain_low_plddt").otherwise("ok")


def qualified(pairs: DataFrame, candidates: DataFrame, residues: DataFrame, window: int = 40, threshold: float = 0.4, least: int = 30, sure: float = 70.0) -> DataFrame:
    """(ref_id, cutoff, first, n, score, plddt, status), one row for each of ``pairs``; candidates are (structure, cutoff, first, pos), or ``spans``."""
    kinds = [("ref_id", pa.int64()), ("cutoff", pa.float64()), ("first", pa.int64()), ("n", pa.int64()), ("score", pa.int64()), ("plddt", pa.float64()), ("known", pa.bool_())]
    schema = pa.schema(kinds)

    def run(batches):
        for batch in batches:
            lists = list(zip(*_lists(batch, (*_RESIDUES, *_SPANS)), strict=True))
            texts = zip(batch["q"].to_pylist(), batch["s"].to_pylist(), strict=True)
            found = [_best(q, s, x[:3], x[3:] if x[3] is not None else None, window, threshold) or (None,) * 5 for (q, s), x in zip(texts, lists, strict=True)]
            columns = zip(*found, strict=True) if found else [()] * 5
            yield pa.RecordBatch.from_arrays([batch["ref_id"], *(pa.array(c, k) for c, (_, k) in zip(columns, kinds[1:6], strict=True)), batch["r_pos"].is_valid()], schema=schema)

    rows = _with_profiles(pairs, residues, candidates)
    text = (F.when(F.col("c_cutoff").isNotNull(), F.col(c)).alias(c) for c in "qs")  # others can't have a domain
    rows = rows.select(F.col("ref_id").cast("long").alias("ref_id"), *text, *_RESIDUES, *_SPANS).mapInArrow(run, "ref_id long, cutoff double, first long, n long, score long, plddt double, known boolean")
    status = F.when(~F.col("known"), "no_pdb").otherwise(_status(F.col("n"), F.col("plddt"), least, sure))
    return rows.select("ref_id", "cutoff", "first", "n", "score", "plddt", status.alias("status"))


def matched(pairs: DataFrame, residues: DataFrame, least: int = 30, sure: float = 70.0) -> DataFrame:
    """The same columns where all matched positions are the domain (rows of C1): ``cutoff`` is null, a row without matches too small."""
    schema = pa.schema([("ref_id", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("score", pa.int64()), ("plddt", pa.float64()), ("known", pa.bool_())])

    def one(row, pos, plddt):
        """Matches, equal ones, the first and the mean; a position with several residues counts for each."""
        ref, equal = row
        if not len(ref):
            return None, 0, 0, None
        if pos is None:
            return int(ref[0]), len(ref), int(equal.sum()), None
        place = np.searchsorted(ref, pos)
        there = ref[np.minimum(place, len(ref) - 1)] == pos
        times = np.maximum(np.bincount(place[there], minlength=len(ref)), 1)
        values = plddt[there]
        values = values[~np.isnan(values)]
        return int(ref[0]), int(times.sum()), int(times[equal].sum()), float(values.mean()) if len(values) else None

    def run(batches):
        for batch in batches:
            rows = {}
            place = pa.array(np.arange(len(batch)), pa.int64())
            for c in aligned._chunks(pa.RecordBatch.from_arrays([place, batch["q"], batch["s"]], names=["ref_id", "q", "s"])):
                both = c.op == 0
                ends = np.cumsum(c.totals(both))[:-1]
                rows |= dict(zip(c.ids.tolist(), zip(np.split(c.ref[both], ends), np.split((c.marks() == 124)[both], ends), strict=True), strict=True))
            none = (np.empty(0, np.int64), np.empty(0, bool))
            found = [one(rows.get(k, none), pos, plddt) for k, (pos, plddt) in enumerate(zip(*_lists(batch, ("r_pos", "r_plddt")), strict=True))]
            columns = zip(*found, strict=True) if found else [()] * 4
            yield pa.RecordBatch.from_arrays([batch["ref_id"], *(pa.array(c, k) for c, k in zip(columns, schema.types[1:5], strict=True)), batch["r_pos"].is_valid()], schema=schema)

    rows = _with_profiles(pairs, residues).select(F.col("ref_id").cast("long").alias("ref_id"), "q", "s", "r_pos", "r_plddt")
    rows = rows.mapInArrow(run, "ref_id long, first long, n long, score long, plddt double, known boolean")
    status = F.when(~F.col("known"), "no_pdb").otherwise(_status(F.col("n"), F.col("plddt"), least, sure))
    return rows.select("ref_id", F.lit(None).cast("double").alias("cutoff"), "first", "n", "score", "plddt", status.alias("status"))


def whole_chains(pairs: DataFrame, residues: DataFrame, window: int = 40, threshold: float = 0.4, least: int = 30) -> DataFrame:
    """(ref_id, n, status) where a structure has no error cells: the whole chain is the domain, gated by its windows alone."""
    schema = pa.schema([("ref_id", pa.int64()), ("n", pa.int64()), ("passes", pa.bool_())])

    def passes(q, s, n):
        if not q or not s or n is None:
            return False
        walk = _Walk(q, s, np.empty(0, np.int64), n)
        return _windows_pass(walk.mark[walk.of([(0, n)])], window, threshold)

    def run(batches):
        for batch in batches:
            n = batch["n"].to_pylist()
            ok = [passes(*x) for x in zip(batch["q"].to_pylist(), batch["s"].to_pylist(), n, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["ref_id"], pa.array(n, pa.int64()), pa.array(ok, pa.bool_())], schema=schema)

    sizes = residues.groupBy("structure").agg(F.count("*").alias("n"))
    rows = pairs.select("ref_id", "structure", "q", "s").join(sizes, "structure", "left")
    text = (F.when(F.col("n") >= least, F.col(c)).alias(c) for c in "qs")  # others have their status already
    rows = rows.select(F.col("ref_id").cast("long").alias("ref_id"), *text, "n").mapInArrow(run, "ref_id long, n long, passes boolean")
    status = F.when(F.col("n").isNull(), "no_pdb").when(F.col("n") < least, "domain_too_small").when(~F.col("passes"), "no_domain").otherwise("ok")
    return rows.select("ref_id", "n", status.alias("status"))


def local_pairs(rows: DataFrame) -> DataFrame:
    """(ref_id, structure, q, s, pairs, same, length) of rows with their whole sequences (full_q, full_s), aligned locally.

    The structure's letters before the local span stand against dashes, so that positions stay those of the structure.
    """
    from .cascade import pair_shares

    rows = rows.withColumn("x", alignment.aligner(local=True)("full_q", "full_s")).where("x.q <> ''")
    lead = F.expr("substring(full_s, 1, CAST(locate(replace(x.s, '-', ''), full_s) - 1 AS INT))")
    rows = rows.withColumn("c", pair_shares(F.col("x.q"), F.col("x.s"))).withColumn("lead", lead)
    return rows.select("ref_id", "structure", F.concat(F.repeat(F.lit("-"), F.length("lead")), "x.q").alias("q"), F.concat("lead", "x.s").alias("s"), "c.pairs", "c.same", F.length("full_q").alias("length"))


def with_rescue(first: DataFrame, rows: DataFrame, candidates: DataFrame, residues: DataFrame, coverage: float = 0.7, threshold: float = 0.4, **how) -> DataFrame:
    """``qualified``'s rows with ``rescue``: those without a domain are tried again on a local alignment.

    A local alignment that covers and equals enough makes all its matches the domain;
    others are gated as before.  ``rescue`` is ``c1`` or ``c2`` where the second try is ok.
    """
    again = local_pairs(rows.join(first.where("status = 'no_domain'").select("ref_id"), "ref_id", "left_semi"))
    sizes = {k: how[k] for k in ("least", "sure") if k in how}
    full = (F.col("pairs") >= coverage * F.col("length")) & (F.col("same") >= threshold * F.col("pairs"))
    one = matched(again.where(full), residues, **sizes).withColumn("rescue", F.when(F.col("status") == "ok", "c1"))
    two = qualified(again.where(~full), candidates, residues, threshold=threshold, **how).withColumn("rescue", F.when(F.col("status") == "ok", "c2"))
    second = one.unionByName(two)
    rest = first.join(second.select("ref_id"), "ref_id", "left_anti").withColumn("rescue", F.lit(None).cast("string"))
    return rest.unionByName(second)
