"""Residue alphabets and k-mers: columns for recoding, an Arrow kernel for distinct k-mers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stage import spread

# fixed values: residue classes of the reduced alphabets
SCHEMES = {
    "murphy2000_4": ("LVIMC", "AGSTP", "FYW", "EDNQKRH"),
    "murphy2000_5": ("LVIMC", "AGSTP", "FYW", "EDNQ", "KRH"),
    "murphy2000_8": ("LVIMC", "GA", "TS", "P", "FYW", "EDNQ", "KR", "H"),
    "dayhoff1978_6": ("ILMV", "AGPST", "FWY", "DENQ", "HKR", "C"),
}
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
# fixed values: three-letter names of residues
THREE = {
    "A": "ALA", "C": "CYS", "D": "ASP", "E": "GLU", "F": "PHE", "G": "GLY", "H": "HIS", "I": "ILE", "K": "LYS", "L": "LEU",
    "M": "MET", "N": "ASN", "P": "PRO", "Q": "GLN", "R": "ARG", "S": "SER", "T": "THR", "V": "VAL", "W": "TRP", "Y": "TYR",
}


def strip(text: Column) -> Column:
    """The 20 residue letters of a text, upper case; stripped first, as upper() may change other characters' number."""
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{RESIDUES}{RESIDUES.lower()}]", ""))


def recode(seq: Column, scheme: str) -> Column:
    classes = SCHEMES[scheme]
    return F.translate(seq, "".join(classes), "".join(str(i) * len(c) for i, c in enumerate(classes)))


def three_letters(seq: Column, default: str = "UNK") -> Column:
    """Names of a sequence's residues; other letters get the default."""
    names = F.create_map(*(F.lit(x) for pair in THREE.items() for x in pair))
    return F.transform(F.split(seq, ""), lambda c: F.coalesce(names[c], F.lit(default)))


def one_letter(name: Column, default: str = "X") -> Column:
    names = F.create_map(*(F.lit(x) for a, b in THREE.items() for x in (b, a)))
    return F.coalesce(names[name], F.lit(default))


def _table(scheme: str) -> np.ndarray:
    t = np.full(256, 255, np.uint8)
    for i, letters in enumerate(SCHEMES[scheme]):
        for c in letters + letters.lower():
            t[ord(c)] = i
    return t


def kmer_codes(raw: np.ndarray, table: np.ndarray, k: int, base: int, segmented: bool) -> np.ndarray:
    """Sorted distinct codes (base ``base``, first letter highest) of a text's k-mers.

    What is outside the alphabet ends a segment, which no k-mer spans, or is skipped when not ``segmented``.
    """
    d = table[raw]
    if not segmented:
        d = d[d != 255]
    n = len(d) - k + 1
    if n <= 0:
        return np.empty(0, np.int64)
    code, ok = np.zeros(n, np.int32 if base**k < 1 << 31 else np.int64), np.ones(n, bool)
    for j in range(k):
        part = d[j : j + n]
        code *= base
        code += part
        ok &= part != 255
    return np.unique(code[ok])


#: Codes that a task counts in one array, and whose keep list goes to all tasks as a bit each (1 MB).
DENSE = 1 << 23


def distinct_kmers(df: DataFrame, key: str, text: str, k: int = 9, scheme: str = "murphy2000_5", segmented: bool = True, first: int | None = None, kept: np.ndarray | None = None) -> DataFrame:
    """(key, codes): each row's distinct k-mer codes in order, only those whose bit in ``kept`` is set if given, the ``first`` smallest if given.

    Distinctness needs no shuffle: it is settled in the row.
    """
    table, base = _table(scheme), len(SCHEMES[scheme])
    src = df.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias("t"))
    schema = pa.schema([(key, pa.int64()), ("codes", pa.list_(pa.int64()))])

    def of(t) -> np.ndarray:
        c = kmer_codes(np.frombuffer(t.as_buffer(), np.uint8), table, k, base, segmented)
        return (c if kept is None else c[(kept[c >> 3] >> (c & 7).astype(np.uint8)) & 1 > 0])[:first]

    def codes(batches):
        for batch in batches:
            out = [of(t) for t in batch["t"]]
            at = np.r_[0, np.cumsum([len(c) for c in out])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch[key], lists], schema=schema)

    return spread(src).mapInArrow(codes, f"{key} long, codes array<long>")


def kmer_frequency(df: DataFrame, text: str, k: int = 9, scheme: str = "murphy2000_5", segmented: bool = True) -> DataFrame:
    """(h, df): how many rows have each k-mer; a task counts all of its rows before anything is shuffled.  Only for at most DENSE codes."""
    table, base = _table(scheme), len(SCHEMES[scheme])
    if base**k > DENSE:
        raise ValueError(f"{base}^{k} codes are more than {DENSE}")
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64())])

    def count(batches):
        n = np.zeros(base**k, np.int64)
        for batch in batches:
            for t in batch["t"]:
                n[kmer_codes(np.frombuffer(t.as_buffer(), np.uint8), table, k, base, segmented)] += 1
        h = np.flatnonzero(n)
        for s in range(0, len(h), 1 << 16):
            part = h[s : s + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n[part])], schema=schema)

    rows = df.select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = spread(rows).mapInArrow(count, "h long, n long")
    return rows.groupBy("h").agg(F.sum("n").alias("df"))
