import random
from itertools import combinations

from helixframe.llm.jaccard_join import _apart, _sized

_DDL = "sig long, id long, need long"


def _kept(spark, held, needs):
    rows = [(s, i, 2 * needs[i]) for i, sigs in held.items() for s in sigs]
    out = {i: set() for i in held}
    for r in _apart(_sized(spark.createDataFrame(rows, _DDL)), 16).collect():
        out[r.id].add(r.p)
    return out


def test_sets_leave_out_the_pivots_of_passages(spark):
    """Sets share eight buckets with those of their text, and in a larger one a passage whose pivot is no like of them."""
    held = {i: {10 * (i // 20) + k for k in range(8)} | {500 + i % 5} for i in range(200)}
    held |= {1000 + k: {500 + k, *range(3000, 3010)} for k in range(5)}
    held |= {2000 + k: set(range(3000, 3020)) for k in range(25)}
    out = _kept(spark, held, {i: 4 for i in held})
    assert all(len(out[i]) == 1 and out[i] == out[i - i % 20] for i in range(200))


def test_sets_that_share_enough_keep_a_pivot(spark):
    rng = random.Random(3)
    held = {i: set(rng.sample(range(24), rng.randrange(4, 20))) for i in range(90)}
    needs = {i: rng.randrange(1, len(x) + 1) for i, x in held.items()}
    size = {s: sum(s in x for x in held.values()) for s in range(24)}
    assert min(size.values()) > 16
    out = _kept(spark, held, needs)
    assert all(out[i] & out[j] for i, j in combinations(held, 2) if len(held[i] & held[j]) > max(needs[i], needs[j]) // 2)
    assert sum(map(len, out.values())) < sum(map(len, held.values())) / 2
