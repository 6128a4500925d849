"""Sketches by counted codes and by joins are the same."""

import random

import pytest

from helixframe.functions import alphabet
from helixframe.operators import search


@pytest.mark.parametrize("segmented", [True, False])
@pytest.mark.parametrize("max_freq", [3, 0.5])
def test_both_ways(spark, monkeypatch, segmented, max_freq):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices("ACDEFGHIKLMNPQRSTVWYX ", k=rng.randrange(0, 90))) * rng.randrange(1, 3)) for i in range(60)] + [(90, None), (91, "")]
    df = spark.createDataFrame(rows, "row_idx long, text string").repartition(3)
    ours = {tuple(r) for r in search.target_sketches(df, 4, 20, max_freq, segmented=segmented).collect()}
    plain = alphabet.distinct_kmers(df, "row_idx", "text", 4, segmented=segmented)
    counts = {tuple(r) for r in search.document_frequency(plain).collect()}
    assert {tuple(r) for r in alphabet.kmer_frequency(df, "text", 4, segmented=segmented).collect()} == counts
    monkeypatch.setattr(search, "DENSE", 1)
    assert ours and {tuple(r) for r in search.target_sketches(df, 4, 20, max_freq, segmented=segmented).collect()} == ours
