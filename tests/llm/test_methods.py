import random

import numpy as np

from helixframe.llm.jaccard_join import near_duplicates
from helixframe.llm.licenses import evaluate, postfix, scan
from helixframe.llm.packing import best_fit, lower_bound
from helixframe.llm.substring_dedup import COVER, PERIOD, is_cover


def test_cover():
    assert is_cover(PERIOD, COVER)


def test_license_expression():
    assert postfix("(MIT OR Apache-2.0) AND GPL-3.0-only") == ["mit", "apache-2.0", "or", "gpl-3.0-only", "and"]
    assert evaluate(postfix("MIT OR GPL-3.0-only")) == 1.0
    assert scan("cc by cc by")[:4] == (4, 2, 0, 2) and scan("")[:4] == (0, 0, None, None)


def test_bins_meet_the_bound():
    x = np.random.default_rng(1).integers(1, 900, 2000)
    bins, _ = best_fit(x, 2048)
    assert np.bincount(bins, x).max() <= 2048 and bins.max() + 1 >= lower_bound(x, 2048)


def _reach(texts):
    """Smallest id reachable by links, by comparing all pairs."""
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    own = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if 100 * both >= 80 * (len(x) + len(sets[j]) - both) and own[i] != own[j]:
                low, high = sorted((own[i], own[j]))
                own = [low if o == high else o for o in own]
    return own


def test_near_copies_of_all_sizes(spark):
    rng, texts = random.Random(7), []
    for length in (6, 9, 14, 30, 61, 200):
        base = [f"w{rng.randrange(400)}" for _ in range(length)]
        for _ in range(40):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy[: len(copy) - rng.randrange(3)]))
    rng.shuffle(texts)
    found = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.component_id for r in sorted(found)] == _reach(texts)


def test_large_buckets_by_differences(spark):
    """Near copies that meet in buckets of over two sets only through their differences, some linked to the text they were made from and some not."""
    rng, texts = random.Random(11), []
    for length, edits in ((40, 2), (90, 4), (120, 9)):
        base = [f"b{rng.randrange(300)}" for _ in range(length)]
        for k in range(90):
            copy = list(base)
            for _ in range(rng.randrange(edits + 1)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(2)] = rng.choice(([], [f"x{rng.randrange(8)}"], [f"y{rng.randrange(10**6)}"]))
            texts.append(" ".join(copy if k % 7 else copy[: -rng.randrange(1, 9)]))
    rng.shuffle(texts)
    want = _reach(texts)
    rows = list(enumerate(texts))
    for order in (rows, rows[::-1]):
        for few in (2, 16):
            found = near_duplicates(spark.createDataFrame(order, "doc_id long, text string"), few=few).collect()
            assert [r.component_id for r in sorted(found)] == want
    assert len(set(want)) > 20
