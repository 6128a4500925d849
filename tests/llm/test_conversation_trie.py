"""The conversation trie against a plain one."""

import hashlib
import random
import zlib

import pytest

from helixframe.llm import conversation_trie
from helixframe.llm.conversation_trie import prefix_trie

_DDL = "conv_id long, turn long, role string, text string, depth int, x1 string, saved int"


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(r[2], r[4]) for r in sorted(t)] for c, t in convs.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        whole[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members = {}
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    children = {p: [q for q in members if len(q) == len(p) + 1 and q[:-1] == p] for p in members}

    def below(p):
        yield p
        for q in children[p]:
            yield from below(q)

    out = []
    for p, ids in members.items():
        tree = list(below(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in tree if q)
        ends = ",".join(str(c) for c in sorted(ids) if len(whole[c]) == len(p))
        out.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), len(children[p]), sum(not children[q] for q in tree), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame([(*r, 7, "x", 1) for r in rows], _DDL).repartition(3)
    got = prefix_trie(df)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("block", [2, 4096])
def test_random(spark, monkeypatch, block):
    """Few distinct turns, so that prefixes are shared far beyond the rebuilt starts."""
    monkeypatch.setattr(conversation_trie, "_BLOCK", block)
    rng, rows = random.Random(3), []
    for c in [*range(0, 12), *range(95, 125), *range(300, 330, 7), -5, -105, -100]:
        for k in range(rng.choice([1, 2, 3, 6, 9])):
            rows.append((c, k if rng.random() < 0.95 else None, rng.choice(["user", None, ""]), rng.choice(["a", "bb", "", None, "é漢"]) if rng.random() < 0.9 else f"own {c} {k}"))
    rows += rng.sample(rows, 8) + [(None, 0, "user", "left out")]
    check(spark, rows)


def test_chains(spark):
    """Conversations that are prefixes of each other, in both orders of ids: runs hang from runs."""
    rows = [(1000 + i, k, "u", f"t{k}") for i in range(9) for k in range(i + 3)] + [(2000 - i, k, "v", f"t{k}") for i in range(9) for k in range(i + 3)]
    check(spark, rows)


def test_many_end_at_one_node(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "_BLOCK", 4)
    check(spark, [(c, 0, "u", "same") for c in range(-9, 40)] + [(c, 1, "u", "more") for c in range(0, 40, 3)])


def test_cases(spark):
    """No row, only rows without an id, a long text, a conversation without turns."""
    assert prefix_trie(spark.createDataFrame([], _DDL)).count() == 0
    assert prefix_trie(spark.createDataFrame([(None, 1, "u", "x", 1, "", 1)], _DDL)).count() == 0
    short = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    check(spark, [(short, 0, "u", "gone"), (300, None, None, "long " * 100_000)])
