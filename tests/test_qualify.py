"""Qualification of domains against a plain program over sets of positions."""

import random
from collections import Counter, defaultdict

from helixframe.functions.alignment import ORDER, compare, edit_ops, windows_pass
from helixframe.operators import qualify

_WINDOW, _SHARE, _LEAST, _SURE = 10, 0.5, 8, 70.0


def plain(q, s, groups, ss, plddt):
    """(cutoff, first, n, score, status) of one row: each group gated, then the best."""
    _, ops = edit_ops(q, s)
    comp, marks, at = compare(q, s), {}, 0
    for k, c in enumerate(s):
        if c != "-":
            if q[k] != "-":
                marks[at] = comp[k]
            at += 1
    state = lambda p: ss.get(p, "C")
    good = []
    for cutoff, group in groups:
        text, bad = "", False
        for op in ops:
            if op["op"] == "match":
                text += marks[op["ref_pos"]] if op["ref_pos"] in group else ""
                continue
            gone = op["op"] == "deletion"
            left, right = (op["ref_pos"] - 1, op["ref_pos"] + op["count"]) if gone else (op["left"], op["right"])
            inside = [p for p in range(left + 1, right) if p in group] if gone else [p for p in (left, right) if p in group]
            if inside:
                text += "-" * (len(inside) if gone else op["count"])
                bad |= state(left) == state(right) == "E"
        if not bad and windows_pass(text, _WINDOW, _SHARE):
            good.append((sum(marks.get(p) == "|" for p in group), -cutoff, len(group), -min(group), group))
    if not good:
        return None, None, None, None, "no_domain"
    score, cutoff, n, first, group = max(good)
    mean = sum(plddt[p] for p in group) / n
    return -cutoff, -first, n, score, "domain_too_small" if n < _LEAST else "domain_low_plddt" if mean < _SURE else "ok"


def rows(seed, count):
    rng, out = random.Random(seed), []
    for _ in range(count):
        s = "".join(rng.choices(ORDER, k=rng.randrange(20, 60)))
        q = "".join(c if rng.random() < 0.8 else rng.choice(ORDER) for c in s)
        for _ in range(rng.randrange(3)):
            k, n = rng.randrange(2, len(q) - 2), rng.randrange(1, 4)
            if rng.random() < 0.5:
                q = q[:k] + "-" * n + q[k + n :]
            else:
                q, s = q[:k] + "".join(rng.choices(ORDER, k=n)) + q[k:], s[:k] + "-" * n + s[k:]
        out.append((q[: len(s)].ljust(len(s), "-"), s))
    return out


def test_gates_and_statuses(spark):
    rng = random.Random(4)
    pairs, candidates, residues, want, seen = [], [], [], {}, Counter()
    for ref, (q, s) in enumerate(rows(1, 60)):
        structure, n = 1000 + ref, len(s.replace("-", ""))
        pairs.append((ref, structure, q, s))
        ss, plddt, groups = {p: rng.choice("HEC" if ref % 2 else "EE") for p in range(n)}, {p: rng.uniform(50, 95) for p in range(n)}, []
        residues += [(structure, p, ss[p], plddt[p]) for p in range(n)]
        for cutoff in (5.0, 8.0):
            labels = [rng.randrange(3) for _ in range(n)] if ref % 3 else [p * 3 // n for p in range(n)]
            parts = defaultdict(set)
            for p, k in enumerate(labels):
                parts[k].add(p)
            groups += [(cutoff, g) for g in parts.values()]
            candidates += [(structure, cutoff, min(g), p) for g in parts.values() for p in g]
        want[ref] = plain(q, s, groups, ss, plddt)
        seen[want[ref][4]] += 1
    pairs.append((99, 5, "MK", "MK"))
    want[99] = (None, None, None, None, "no_pdb")
    df = spark.createDataFrame(pairs, "ref_id long, structure long, q string, s string").repartition(3)
    found = qualify.qualified(df, spark.createDataFrame(candidates, "structure long, cutoff double, first long, pos long"), spark.createDataFrame(residues, "structure long, pos long, ss string, plddt double"), _WINDOW, _SHARE, _LEAST, _SURE)
    assert {r.ref_id: (r.cutoff, r.first, r.n, r.score, r.status) for r in found.collect()} == want
    assert set(seen) == {"ok", "no_domain", "domain_too_small", "domain_low_plddt"}


def test_communities_of_cells(spark):
    """Two blocks of small errors are two domains at the small cutoff and one at the large; cells stand for two residues, the last for one."""
    cells = [(7, i, j, 1.0 if (i < 5) == (j < 5) else 7.0) for i in range(10) for j in range(10)]
    lengths = spark.createDataFrame([(7, 19, 2), (8, 3, 2)], "structure long, n long, step long")
    out = qualify.candidate_domains(spark.createDataFrame(cells, "structure long, i long, j long, pae double"), lengths, (5.0, 12.0))
    got = defaultdict(list)
    for r in out.collect():
        got[r.structure, r.cutoff, r.first].append(r.pos)
    assert {k: sorted(v) for k, v in got.items()} == {(7, 5.0, 0): list(range(10)), (7, 5.0, 10): list(range(10, 19)), (7, 12.0, 0): list(range(19)), **{(8, c, f): p for c in (5.0, 12.0) for f, p in ((0, [0, 1]), (2, [2]))}}


def test_rescue(spark):
    """A row without a domain: a local alignment covers it after all (c1), finds a domain (c2), or doesn't help."""
    rng = random.Random(9)
    seq = lambda n: "".join(rng.choices(ORDER, k=n))
    core, part, none = seq(60), seq(40), seq(50)
    full = {1: (core, seq(30) + core + seq(10)), 2: (part + seq(80), seq(25) + part + seq(60)), 3: (none, seq(80))}
    spaced = [(k, 10 + k, q, s) for k, (q, s) in full.items()]
    rows_ = spark.createDataFrame(spaced, "ref_id long, structure long, full_q string, full_s string")
    first = spark.createDataFrame([(k, None, None, None, None, None, "no_domain") for k in full] + [(4, 5.0, 0, 40, 30, 80.0, "ok")], "ref_id long, cutoff double, first long, n long, score long, plddt double, status string")
    residues = spark.createDataFrame([(10 + k, p, "C", 90.0) for k, (_, s) in full.items() for p in range(len(s))], "structure long, pos long, ss string, plddt double")
    candidates = spark.createDataFrame([(10 + k, 5.0, 25 * (p >= 25) + 40 * (p >= 65), p) for k, (_, s) in full.items() for p in range(len(s))], "structure long, cutoff double, first long, pos long")
    out = qualify.with_rescue(first, rows_, candidates, residues, window=20, least=30)
    got = {r.ref_id: r for r in out.collect()}
    assert {k: (r.status, r.rescue) for k, r in got.items()} == {1: ("ok", "c1"), 2: ("ok", "c2"), 3: ("no_domain", None), 4: ("ok", None)}
    assert (got[1]["first"], got[1].n) == (30, 60) and (got[2]["first"], got[2].score) == (25, 40)


def test_whole_chains(spark):
    pairs = spark.createDataFrame([(1, 1, "MKVLAA", "MKVLAA"), (2, 2, "MKVLAA", "GGGGGG"), (3, 3, "MK", "MK"), (4, 4, "MK", "MK")], "ref_id long, structure long, q string, s string")
    residues = spark.createDataFrame([(s, p, "C", None) for s, n in ((1, 6), (2, 6), (3, 2)) for p in range(n)], "structure long, pos long, ss string, plddt double")
    out = qualify.whole_chains(pairs, residues, 4, 0.5, least=3).collect()
    assert {r.ref_id: r.status for r in out} == {1: "ok", 2: "no_domain", 3: "domain_too_small", 4: "no_pdb"}
