"""Quality rules against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from helixframe.llm.divergence import distances, divergence_rules

_DDL = "doc_id long, text string, lang string, class int, sha string, counts string, n_words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    repeats = len({i + j for i, x in enumerate(windows) if often[x] > 1 for j in range(3)})
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeats, len(w) < 50 or 100 * repeats > 50 * len(w)


def prose(rng, n, words):
    return " ".join(rng.choice(words) if rng.random() < 0.5 else "".join(rng.choices("abcdefghij", k=6)) for _ in range(n)) + ".\n"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], _DDL).repartition(3)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    de, en = ["der", "die", "und", "ist"], ["the", "and", "of", "is"]
    rows = [(i, prose(rng, rng.choice([60, 90, 200, 900]), en if i % 3 else de), "en" if i % 3 else "de") for i in range(240)]
    junk = [" | ".join("".join(rng.choices("abcdefghij", k=9)) for _ in range(120)), prose(rng, 150, en).upper(), prose(rng, 200, de), "1 2 3 4 5 6 7 8 9 0 " + " ".join(str(rng.random()) for _ in range(90))]
    return rows, [(900 + i, t, "en") for i, t in enumerate(junk)]


def test_counts(spark):
    texts = [None, "", " \t\n", "one", "a b c a b c", "x\nx\n\n \n x\nx", "## é漢 <b>|  z", "same " * 400, " ".join(f"w{i}" for i in range(60)) + "\n" + "w1 w2 w3", "y" * 400_000, " ".join(f"l{i % 5000}" for i in range(20_000)), "a b a\x1cb a\x85b"]
    rows = [(i if i else None, t, [None, "en", ""][i % 3]) for i, t in enumerate(texts)]
    got = divergence_rules(frame(spark, [*rows, rows[4]])).collect()
    want = Counter((i, *plain(t)) for i, t, _ in [*rows, rows[4]])
    assert Counter((r["doc_id"], *(r[c] for c in BASE)) for r in got) == want
    assert all(r["kept"] == (not r["base_failed"]) for r in got)  # too few texts for a reference


def test_empty(spark):
    assert divergence_rules(frame(spark, [])).count() == 0


def test_junk_goes_and_prose_stays(spark, corpus):
    rows, junk = corpus
    kept = {r["doc_id"]: r["kept"] for r in divergence_rules(frame(spark, rows + junk)).collect()}
    assert all(kept[i] for i, *_ in rows)
    assert not any(kept[i] for i, *_ in junk)


def test_copies_do_not_move_the_reference(spark, corpus):
    rows, junk = corpus
    copies = [(2000 + i, junk[2][1], "en") for i in range(300)]
    kept = {r["doc_id"]: r["kept"] for r in divergence_rules(frame(spark, rows + copies)).collect()}
    assert all(kept[i] for i, *_ in rows)
    assert not any(kept[i] for i, *_ in copies)


def test_distances_by_hand(spark, corpus):
    p, q = np.array([[1.0, 3.0, 0.0], [2.0, 2.0, 4.0]]), np.array([4.0, 0.0, 4.0])
    for row, got in zip(p, distances(p, q), strict=True):
        a, b = row / row.sum(), q / q.sum()
        m = (a + b) / 2
        want = sum(x * math.log2(x / y) for z in (a, b) for x, y in zip(z, m, strict=True) if x) / 2
        assert got == pytest.approx(want)
    assert distances(np.array([[1.0, 0.0]]), np.array([0.0, 2.0]))[0] == 1
    # a language's word histogram, from plain counts
    rows, _ = corpus
    got = {r["doc_id"]: r["word_distance"] for r in divergence_rules(frame(spark, rows)).collect()}
    for lang in ("de", "en"):
        own = [(i, Counter(WORD.findall(t))) for i, t, x in rows if x == lang]
        whole = sum((c for _, c in own), Counter())
        common = [w for w, n in whole.items() if n * 1024 >= whole.total()]
        ref = np.array([*(whole[w] for w in common), whole.total() - sum(whole[w] for w in common)], float)
        for i, c in own[:20]:
            hist = np.array([[*(c[w] for w in common), c.total() - sum(c[w] for w in common)]], float)
            assert got[i] == pytest.approx(math.sqrt(distances(hist, ref)[0]))


def test_languages_beyond_the_limit_share_a_reference(spark, corpus):
    rows, _ = corpus
    small = [(3000 + i, t, f"x{i % 9}") for i, (_, t, lang) in enumerate(rows) if lang == "de"]
    got = divergence_rules(frame(spark, [r for r in rows if r[2] == "en"] + small), languages=1).collect()
    assert all(r["kept"] and r["word_distance"] is not None for r in got)
