"""Substring dedup by difference-cover anchors.

A *window* is ``window`` consecutive words of one document.  A word goes when a
window that covers it also starts in a document with a smaller ``doc_id``.

1. Anchors.  Words at places p of a document with ``p mod period`` in a
   difference cover begin an anchor of ``window - period + 1`` words.  A cover
   holds, for any two offsets, a common shift at which both land on it, so two
   equal windows share an aligned anchor wherever they start.  Only anchors are
   hashed and dealt: a fifth of all places.
2. Extension.  Windows that hold a shared anchor are hashed in 128 bits and
   dealt by content (the least hash of the shingles in them, so that a run of
   windows stays together); the smallest ``doc_id`` with a window owns it.

Tasks aggregate before they deal: of an anchor or window that several documents
of a task hold, one record travels, and the others are settled in the task.  So
a passage that a third of all documents hold costs a reducer one record a task.
Nothing is collected, and each table in between is one row a document or less.

Defined cases: an empty table gives none; texts of any length are read whole; null
text has no words; a null ``doc_id`` is compared with nothing and keeps all its
words; rows that repeat a ``doc_id`` are the same document and get the same places
removed; extra columns are left out.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Dealer, Shelf, U, dealt, hash_words, lean, mix, n_buckets, release, runs, slices, windows_at

#: A perfect difference set: every offset mod 31 is a difference of two members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
_A, _B1, _B2 = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3
_FLUSH = 1 << 20


def is_cover(period: int, cover: tuple[int, ...]) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def _places(words_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of a slice: its row and its place in the row."""
    n = np.diff(words_at)
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(words_at[-1] if len(words_at) else 0) - np.repeat(words_at[:-1], n)


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    c = batch["doc_id"]
    return c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), c.is_valid().to_numpy(zero_copy_only=False)


#: Words of the shingles whose least in a window gives the window's bucket.
_ROUTE = 8
_AT = pa.schema([("doc_id", pa.int64()), ("at", pa.int32())])
_OUT = pa.schema([("doc_id", pa.int64()), ("at", pa.list_(pa.int32()))])


def _by_doc(doc: np.ndarray, at: np.ndarray) -> pa.Table:
    order = np.argsort(doc, kind="stable")
    doc, at = doc[order], at[order].astype(np.int32)
    first = runs(doc)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(doc)].astype(np.int32)), pa.array(at, pa.int32()))
    return pa.Table.from_arrays([pa.array(doc[first], pa.int64()), lists], schema=_OUT)


def _routes(words: np.ndarray, window: int) -> np.ndarray:
    """For each place the least shingle hash of the window from there: neighbours and equal windows mostly share it."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    size = min(_ROUTE, window)
    low, have, want = windows_at(words, np.arange(len(words) - size + 1), size, _A), 1, window - size + 1
    while have < want:
        step = min(have, want - have)
        low, have = np.minimum(low[: len(low) - step], low[step:]), have + step
    return mix(low)


def _shared_anchors(df: DataFrame, window: int, period: int, cover: tuple[int, ...], buckets: int) -> DataFrame:
    width = window - period + 1
    on_cover = np.zeros(period, bool)
    on_cover[[c % period for c in cover]] = True

    def settle(h, doc, at):
        o = np.lexsort((doc, h))
        h, doc, at = h[o], doc[o], at[o]
        f = runs(h)
        size = np.diff(np.r_[f, len(h)])
        several = np.repeat(np.minimum.reduceat(doc, f) != np.maximum.reduceat(doc, f), size)
        lone = np.flatnonzero(~several)
        head = f[several[f]]
        send = np.sort(np.concatenate([lone, head]))
        place = np.where(several[send], -1, at[send]).astype(np.int32)
        return (h[send], doc[send], place), (doc[several], at[several])

    @lean
    def anchors(batches):
        out = Dealer(buckets, settle, _FLUSH)
        for batch in batches:
            for part in slices(batch):
                ids, known = _ids(part)
                words, words_at = hash_words(part["text"])
                row, place = _places(words_at)
                n = np.diff(words_at)
                good = known & (n >= window)
                g = np.flatnonzero(good[row] & on_cover[place % period] & (place <= n[row] - width))
                yield from out.add(windows_at(words, g, width, _A), ids[row[g]], place[g].astype(np.int32))
        yield from out.flush()

    @lean
    def reduce(table):
        (h, doc, at), (d1, a1) = dealt(table, (np.uint64, np.int64, np.int32), (np.int64, np.int32))
        o = np.argsort(h, kind="stable")
        h, doc, at = h[o], doc[o], at[o]
        if len(h):
            f = runs(h)
            shared = (np.minimum.reduceat(doc, f) != np.maximum.reduceat(doc, f)) | (np.minimum.reduceat(at, f) < 0)
            keep = np.repeat(shared, np.diff(np.r_[f, len(h)])) & (at >= 0)
            d1, a1 = np.concatenate([d1, doc[keep]]), np.concatenate([a1, at[keep]])
        return pa.Table.from_arrays([pa.array(d1, pa.int64()), pa.array(a1, pa.int32())], schema=_AT)

    return df.mapInArrow(anchors, Dealer.ddl).groupBy("bucket").applyInArrow(reduce, "doc_id long, at int")


def _repeated_windows(df: DataFrame, window: int, period: int, buckets: int) -> DataFrame:
    """df: doc_id, text, at (places of shared anchors); result: places of windows that a smaller doc_id has too."""
    def settle(h, g, doc, at):
        o = np.lexsort((doc, g, h))
        h, g, doc, at = h[o], g[o], doc[o], at[o]
        new = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]
        f = np.flatnonzero(new)
        own = np.repeat(doc[f], np.diff(np.r_[f, len(h)])) == doc
        return (h[own], g[own], doc[own], at[own]), (doc[~own], at[~own])

    @lean
    def extend(batches):
        out = Dealer(buckets, settle, _FLUSH)
        for batch in batches:
            for part in slices(batch):
                ids, _ = _ids(part)
                words, words_at = hash_words(part["text"])
                row, place = _places(words_at)
                lists = part["at"]
                q = lists.flatten().to_numpy().astype(np.int64)
                q_row = np.repeat(np.arange(part.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
                q = q + words_at[q_row]
                ok = q < words_at[q_row + 1]
                q, q_row = q[ok], q_row[ok]
                step = np.zeros(len(words) + 1, np.int32)
                np.add.at(step, np.maximum(q - period + 1, words_at[q_row]), 1)
                np.add.at(step, q + 1, -1)
                n = np.diff(words_at)
                g = np.flatnonzero((np.cumsum(step[:-1]) > 0) & (place <= n[row] - window)) if len(words) else np.empty(0, np.int64)
                low = _routes(words, window) & U(0xFFFF << 48)
                for s in range(0, len(g), _FLUSH):
                    x = g[s : s + _FLUSH]
                    yield from out.add(low[x] | windows_at(words, x, window, _B1) >> U(16), windows_at(words, x, window, _B2), ids[row[x]], place[x].astype(np.int32))
        yield from out.flush()

    @lean
    def reduce(table):
        mine, (d1, a1) = dealt(table, (np.uint64, np.uint64, np.int64, np.int32), (np.int64, np.int32))
        d2, a2 = settle(*mine)[1] if len(mine[0]) else mine[2:]
        return _by_doc(np.concatenate([d1, d2]), np.concatenate([a1, a2]))

    return df.mapInArrow(extend, Dealer.ddl).groupBy("bucket").applyInArrow(reduce, "doc_id long, at array<int>")


def remove_repeats(df: DataFrame, window: int = 50, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and the removed word spans [begin, end) of each document of ``df``."""
    if not is_cover(period, cover) or period >= window:
        raise ValueError("cover must be a difference cover of its period, the period shorter than the window")
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets, shelf = n_buckets(docs), Shelf(df.sparkSession, "substring")
    anchors = shelf.put(_shared_anchors(docs, window, period, cover, buckets))
    found = shelf.put(_repeated_windows(docs.join(anchors.groupBy("doc_id").agg(F.collect_list("at").alias("at")), "doc_id"), window, period, buckets))
    shelf.drop(anchors)
    release(df.sparkSession)

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))])

    @lean
    def cut(batches):
        for batch in batches:
            for part in slices(batch):
                rows = []
                for i, text, at in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), part["at"], strict=True):
                    words = (text or "").encode().split()
                    n, spans = len(words), []
                    if at.is_valid:
                        p = np.unique(at.values.to_numpy())
                        step = np.zeros(n + 1, np.int32)
                        p = p[p + window <= n]
                        step[p] += 1
                        np.add.at(step, p + window, -1)
                        gone = np.cumsum(step[:-1]) > 0
                        edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                        spans = [{"begin": int(b), "end": int(e)} for b, e in edge.reshape(-1, 2)]
                        words = list(compress(words, (~gone).tolist()))
                    rows.append((i, n, n - len(words), b" ".join(words).decode(), spans))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    found = found.groupBy("doc_id").agg(F.flatten(F.collect_list("at")).alias("at"))
    return docs.join(found, "doc_id", "left").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<begin: int, end: int>>")
