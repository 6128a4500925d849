"""Row patterns against a plain backtracking search, over chunks that matches cross."""

import hashlib
import math
import random
from datetime import datetime, timedelta

import pytest

from helixframe.llm.row_patterns import match_pieces, row_matches

_DDL = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
_GAP = timedelta(minutes=10)


def brute(rows):
    """Matches by trying each start and each end, rows being distinct and keys without ties."""
    clients = {}
    for r in set(rows):
        if r[3] is not None and r[1] is not None:
            clients.setdefault(r[3], []).append(r)
    out = []
    for c, seq in clients.items():
        seq.sort(key=lambda r: (r[1], r[0]))
        cents = [None if r[5] is None or not math.isfinite(r[5]) else math.floor(100 * r[5] + 0.5) for r in seq]

        def letters(k, first):
            if seq[k][1] - seq[k - 1][1] > _GAP or cents[k] is None:
                return ""
            found = "P" if seq[k][4] == "purchase" and cents[k] >= cents[first] else ""
            if seq[k][4] not in (None, "error") and cents[k - 1] is not None and cents[k] != cents[k - 1]:
                found += "D" if cents[k] < cents[k - 1] else "U"
            return found

        i, no = 0, 0
        while i < len(seq):
            label, k, done = "A", i + 1, False
            while cents[i] is not None and k < len(seq) and (fits := letters(k, i)):
                label += fits[0]
                if fits[0] == "P":
                    done = True
                    break
                k += 1
            if done:
                no += 1
                out.append((c, no, seq[i][0], seq[k][0], k + 1 - i, sum(cents[i : k + 1]), hashlib.sha256(label.encode()).hexdigest()))
            i = k + 1 if done else i + 1
    return sorted(out)


def clicks(seed, n, clients=3, prices=60, purchases=0.15):
    rng, at, rows = random.Random(seed), datetime(2024, 1, 1), []
    for i in range(n):
        at += timedelta(seconds=rng.choice([0, 1, 30, 200, 599]) if rng.random() < 0.97 else 601)
        kind = "purchase" if rng.random() < purchases else rng.choice(["view"] * 20 + ["click"] * 20 + ["error", None])
        value = rng.choice([None, float("nan")]) if rng.random() < 0.02 else rng.randrange(prices) / 4
        rows.append((i, at, at, rng.choice([1] * 8 + list(range(clients))), kind, value, "{}"))
    rows += rng.sample(rows, n // 10)
    rows += [(n, None, at, 1, "view", 1.0, ""), (n + 1, at, at, None, "view", 1.0, "")]
    rng.shuffle(rows)
    return rows


def check(spark, rows, chunk):
    got = row_matches(spark.createDataFrame(rows, _DDL).repartition(4), chunk=chunk, parts=5)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


@pytest.mark.parametrize(("seed", "chunk"), [(1, 1), (2, 3), (3, 7), (4, 1 << 16)])
def test_chunks(spark, seed, chunk):
    check(spark, clicks(seed, 400), chunk)


def test_matches_across_many_chunks(spark):
    """Few purchases and one client: starts stay in flight over many chunks."""
    check(spark, clicks(5, 600, clients=2, prices=1000, purchases=0.02), 5)


def test_rising_goals(spark):
    """Every row outbids the last: the longest staircase."""
    at = datetime(2024, 1, 1)
    rows = [(i, at + timedelta(seconds=i), at, 1, "purchase" if i % 3 else "view", float(i if i % 2 else 2 * i), "") for i in range(200)]
    check(spark, rows, 4)


def test_one_long_match(spark):
    """A start whose only goal is the last row, with rows of falling and rising values between."""
    at = datetime(2024, 1, 1)
    rows = [(i, at + timedelta(seconds=i), at, 1, "view", [500.0, 1.0][i % 2] if i else 1000.0, "") for i in range(99)] + [(99, at + timedelta(seconds=99), at, 1, "purchase", 1000.0, "")]
    check(spark, rows, 8)
    pieces = match_pieces(spark.createDataFrame(rows, _DDL), chunk=8, parts=5).orderBy("at").collect()
    assert len(pieces) >= 13
    assert "".join(p.labels for p in pieces) == "A" + "DU" * 49 + "P"
    assert [pieces[0].first_id, pieces[-1].last_id] == [0, 99]


def test_cases(spark):
    """Empty table, extra columns, ties of all keys, a null id, the gap's end exactly."""
    empty = spark.createDataFrame([], _DDL)
    assert row_matches(empty, parts=5).count() == 0
    at = datetime(2024, 1, 1)
    rows = [(None, at, at, 1, "view", 1.0, ""), (5, at + _GAP, at, 1, "purchase", 1.0, ""), (6, at + 2 * _GAP, at, 1, "view", 0.0, ""), (7, at + 3 * _GAP + timedelta(microseconds=1), at, 1, "purchase", 9.0, "")]
    df = spark.createDataFrame(rows + rows, _DDL).selectExpr("*", "1 AS at", "2 AS cents", "'x' AS blob")
    assert [tuple(r)[:6] for r in row_matches(df, parts=5).collect()] == [(1, 1, None, 5, 2, 200)]
    ties = [(1, at, at, 1, "view", 2.0, "a"), (1, at, at, 1, "purchase", 3.0, "b"), (1, at, at, 1, "view", 1.0, "c")]
    assert [tuple(r)[:6] for r in row_matches(spark.createDataFrame(ties, _DDL), parts=5).collect()] == [(1, 1, 1, 1, 3, 600)]
