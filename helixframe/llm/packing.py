"""Best-fit packing of token sequences, certified by lower bounds.

Documents longer than a sequence are cut into full pieces, the first piece
taking the remainder; full pieces are sequences of their own.  The others are
dealt evenly over partitions, and each partition packs its pieces best-fit
decreasing.  Dual-feasible functions bound from below the bins that any packing
of its pieces needs.  Where a partition meets its bound only its emptiest bin
may still be improved by others' pieces; where it has a gap, its emptiest bins
(``spare`` a gap bin, and one) are opened, as long as their pieces make up no more
than a ``fan``-th of a partition.  The pieces of opened bins move on to a
partition that takes those of ``fan`` others, and are packed again, until one
partition is left.  So no partition ever has more than ``per_partition`` pieces (or, if
that is more, ``fan`` bins of them), whatever the gaps are: bounds that no
packing can meet open bins in vain, but never gather them.

Defined cases: null text is empty, one end token; a null doc_id's pieces have a null
doc_id; repeated rows are packed each for itself; pieces of one length stand in the
order of doc_id, piece and check sum; an empty table gives none; texts of any length
are encoded whole; extra columns are left out.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf, lean, slices

TOKENIZER = "byte_bpe_50k"


# ---------------------------------------------------------------- tokens


class _Words(dict):
    """Token ids, as bytes, of text between two spaces; None where the pattern could look beyond it."""

    most = 100_000

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes | None:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            ids = None
        else:
            ids = np.array(self.encode(" " + piece), "<u4").tobytes()
        if len(self) >= self.most:
            self.clear()
        if len(piece) <= 48:
            self[piece] = ids
        return ids


@lru_cache(1)
def _encoder(name: str):
    """Text to ids as little-endian 32-bit bytes.

    The ids are those of the tokenizer file without special tokens around them.
    Text that holds one of the file's added tokens goes through the tokenizer
    itself, which gives it its id; for other text the vocabulary's rank file gives
    the same ids.  Its pattern always breaks before a single space between other
    characters, so such parts are encoded once and looked up.
    """
    import base64
    import json
    import re

    import public_tokenizers as public
    import tiktoken
    from tokenizers import Tokenizer

    with open(public.path(f"{name}.json"), encoding="utf-8") as f:
        added = [t["content"] for t in json.load(f).get("added_tokens", ()) if t["content"]]
    whole: list[Tokenizer] = []  # made when first needed

    def slow(text: str) -> list[int]:
        if not whole:
            with open(public.path(f"{name}.json"), encoding="utf-8") as f:
                whole.append(Tokenizer.from_str(f.read()))
            whole[0].no_truncation()
            whole[0].no_padding()
        return whole[0].encode(text, add_special_tokens=False).ids

    special = re.compile("|".join(map(re.escape, added)) or r"(?!)").search
    with open(public.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding(name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    words = _Words(encode)

    def ids(text: str) -> bytes:
        if special(text):
            return np.array(slow(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        if rest and first and not first[0].isspace() and not first[-1].isspace():
            try:
                return np.array(encode(first), "<u4").tobytes() + b"".join(map(words.__getitem__, rest))
            except TypeError:
                pass
        return np.array(encode(text), "<u4").tobytes()

    ids.forget = words.clear
    return ids


def cut_documents(df: DataFrame, size: int = 2048, end: int = 0, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and seq, a number of its own for each piece."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("seq", pa.int64())])

    @lean
    def cut(batches):
        encode, tail, n, base = _encoder(tokenizer), np.array([end], "<u4").tobytes(), 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch):
                rows = []
                for i, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    ids = encode(text or "") + tail
                    total = len(ids) // 4
                    at, length = 0, total % size or size
                    k = 0
                    while at < total:
                        rows.append((i, k, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), base + n))
                        n += 1
                        at, k, length = at + length, k + 1, size
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        encode.forget()

    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, seq long")


# ---------------------------------------------------------------- bins


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece: longest first, each into the fullest bin that takes it."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(size + 1)]
    have, n = 0, 0  # have: a bit for each free space that some bin has
    for i, x in zip(order.tolist(), lengths[order].tolist(), strict=True):
        if fits := have >> x:
            space = x + (fits & -fits).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                have ^= 1 << space
        else:
            b, space, n = n, size, n + 1
        bins[i], offsets[i] = b, size - space
        free[space - x].append(b)
        have |= 1 << (space - x)
    return bins, offsets


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """The best bound of three families of dual-feasible functions on the number of bins."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    x = np.arange(size + 1)
    best = -(-int((count * x).sum()) // size)
    many, words = np.cumsum(count), np.cumsum(count * x)
    # over x > size - a: one bin; below a: nothing; between: as they are
    a = np.arange(size // 2 + 1)
    large, middle = many[size] - many[size - a], words[size - a] - np.where(a > 0, words[a - 1], 0)
    best = max(best, int((large + -(-middle // size)).max()))
    # over half: at least one bin each, small ones in the space that they leave
    half, total = many[size - a] - many[size // 2], words[size - a] - words[size // 2]
    small = words[size // 2] - np.where(a > 0, words[a - 1], 0)
    best = max(best, int((large + half + np.maximum(0, -(-(small - (half * size - total)) // size))).max()))
    # k parts: floor((k + 1) x) of k unless (k + 1) x is whole
    for k in range(2, 21):
        whole = x * (k + 1) % size == 0
        scaled = np.where(whole, x * k, x * (k + 1) // size * size)  # of k * size
        best = max(best, -(-int((count * scaled).sum()) // (k * size)))
    return best


def certified(lengths: np.ndarray, size: int, spare: int, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Bins, offsets, whether each piece's bin is opened, and the gap to the bound; opened bins hold ``room`` pieces, or are one bin."""
    bins, offsets = best_fit(lengths, size)
    n = int(bins.max()) + 1 if len(bins) else 0
    gap = n - lower_bound(lengths, size)
    filled = np.bincount(bins, lengths, n)
    opened, emptiest = np.zeros(n, bool), np.argsort(filled, kind="stable")[: 1 + spare * gap]
    within = np.cumsum(np.bincount(bins, minlength=n)[emptiest]) <= room
    opened[emptiest[within]], opened[emptiest[:1]] = True, True
    opened &= filled < size
    return bins, offsets, opened[bins], gap


def pack_documents(df: DataFrame, size: int = 2048, end: int = 0, tokenizer: str = TOKENIZER, per_partition: int = 100_000, fan: int = 16, spare: int = 8) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece of ``df`` (doc_id, text)."""
    shelf = Shelf(df.sparkSession, "packing")
    return pack_pieces(shelf.put(cut_documents(df, size, end, tokenizer)), shelf, size, per_partition, fan, spare)


def pack_pieces(pieces: DataFrame, shelf: Shelf, size: int = 2048, per_partition: int = 100_000, fan: int = 16, spare: int = 8) -> DataFrame:
    """The places of pieces (doc_id, piece, start, length, ids_crc32, and seq, each piece's own number)."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    out = pieces.where(f"length = {size}").selectExpr(*columns, "seq * 2 + 1 AS sequence_id", "0L AS offset")
    rest = pieces.where(f"length < {size}")
    parts = max(1, -(-rest.count() // per_partition))
    # evenly, by a hash of each row's own number, so that rows that repeat spread too
    rest = rest.select(*columns, F.expr(f"CAST(pmod(xxhash64(seq), {parts}) AS INT)").alias("part"))
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("opened", pa.bool_())]
    schema, ddl = pa.schema(kinds), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, sequence_id long, offset long, opened boolean"
    turn = 0

    def packer(turn, last):
        @lean
        def pack_part(table):
            table = table.select([n for n, _ in kinds[:6]]).sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "ids_crc32")])
            bins, offsets, opened, _ = certified(table["length"].to_numpy(), size, spare, per_partition // fan)
            seq = (((turn << 24 | table["part"][0].as_py()) << 32) + bins) * 2
            return pa.Table.from_arrays([*table.columns, pa.array(seq), pa.array(offsets), pa.array(opened & (not last))], schema=schema)

        return pack_part

    while True:
        packed = shelf.put(rest.groupBy("part").applyInArrow(packer(turn, parts == 1), ddl))
        out = out.unionAll(packed.where("NOT opened").select(*columns, "sequence_id", "offset"))
        if parts == 1:
            return out
        parts, turn = -(-parts // fan), turn + 1
        rest = packed.where("opened").select(*columns, F.expr(f"CAST(part DIV {fan} AS INT)").alias("part"))
