"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of word pairs.

Training.  Words are ``[^\\x20\\x09-\\x0D]+`` as they stand, each document between
a start and an end mark, each language a model of its own.  With ``repeats`` a word that repeats the
one before it is never counted and always scored as an unknown one: a rule of
ours, no part of Kneser-Ney, against texts of one word.  All documents that
``labels`` trust are counted but one in ``folds``, which is held out.  A task sums
its pairs and deals them by pair; a second exchange sums, by word, how often it
is a context and after how many different words it stands.  Discounts of 1, 2
and 3 or more come from the counts of counts.  With D for the discount,

    p(w | v) = (n(vw) - D) / n(v) + back(v) p(w),   p(w) = (N(w) - D') / N + rest / (V + 1)

where N(w) counts different words before w.  All that was counted stays in the model,
unless ``least`` is raised: pairs and words seen less often then leave it, the mass of
such pairs goes to back(v), that of such words to the unknown ones, of which they then are.

Scoring.  The logarithm of a document's probability is a sum of independent terms:
of an unknown word for each place, and for each known word and each kept pair
what it adds to that.  So the model is one table of n-gram and gain, in shards.
Each document's n-grams and their counts are dealt to the shards and joined with
them there; the gains found go back to the document and are summed.  Documents are
scored in ``rounds``, each all of a share told by a hash of id and length, so that what is on
the way to the shards at once is that share.  N-grams that
are at least 2^-``head`` of the training text (2^head at most, by their share) are
looked up in the task, so no shard gets a row for each document; a Bloom filter of
``2^bloom`` bits keeps those at home that no shard has.  None of these changes a result.

A document is rejected when its perplexity exceeds ``margin`` times the
``quantile`` of its language's held-out trusted documents, which the model has not
seen.  Short texts are shrunk to the language's mean by ``prior`` words.

The statistics of a language, a dozen numbers, go to all tasks: ``languages`` with
most trusted documents have a model of their own, others share one.

Defined cases: an empty table gives none; null or blank text, and text in a
language without trusted documents (null counts as a language), have no perplexity
and stay; a language whose trusted documents are all counted takes its threshold
from these; texts of any length are read whole; a repeated row is scored, and
counts for training, each time; a null doc_id is scored but never trusted; a
perplexity equal to the threshold stays; extra columns are left out.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf, U, cut_by_bucket, hash_words, input_bytes, lean, mix, n_buckets, pack, release, runs, slices, unpack, unpack_all

_START, _END, _AGAIN, _PAIR = U(0x51A7C0DE12345671), U(0xE2DC0DE987654323), U(0xA6A1A6A1A6A1A6A3), U(0x9FB21C651E98DF25)
_ROW = pa.schema([("bucket", pa.int32()), ("blob", pa.binary()), ("stat", pa.list_(pa.float64()))])
_DDL = "bucket int, blob binary, stat array<double>"
#: Arrays of a pair (context, word, class, count) and of a word (key, class, N, n, kept).
_PAIRS = (np.uint64, np.uint64, np.uint16, np.int64)
_WORDS = (np.uint64, np.uint16, np.int64, np.int64, np.float64)
_FLUSH = 1 << 20


def _rows(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


class Sequences:
    """Keys of a batch's words, each row's between its marks, and of the pairs."""

    def __init__(self, classes: dict, other: int | None, bits: int, repeats: bool = True):
        self.classes, self.other, self.mask, self.repeats = classes, other, U((1 << 64) - (1 << (64 - bits))), repeats

    def __call__(self, part: pa.RecordBatch):
        """Class and number of words of each row; row and key of each word; context, word and row of each pair, and whether it has no repeat."""
        cls = np.array([self.classes.get(x, self.other if self.other is not None else -1) for x in part["lang"].to_pylist()], np.int64)
        words, at = hash_words(part["text"])
        n = np.diff(at)
        row = np.repeat(np.arange(len(n)), n + 2)
        place = np.arange(len(row)) - (at[:-1] + 2 * np.arange(len(n)))[row]
        seq = np.empty(len(row), np.uint64)
        inner = (place > 0) & (place <= n[row])
        again = np.r_[False, (words[1:] == words[:-1])] if len(words) else np.empty(0, bool)
        again[at[:-1][n > 0]] = False
        again &= self.repeats
        words[again] = _AGAIN
        known = np.ones(len(row), bool)
        known[inner] = ~again
        seq[inner], seq[place == 0], seq[place == n[row] + 1] = words, _START, _END
        seq = mix(seq ^ mix((cls[row] + 2).astype(np.uint64))) & self.mask
        good = (n > 0) & (cls >= 0)
        pair = np.flatnonzero(good[row[:-1]] & (row[1:] == row[:-1])) if len(row) else np.empty(0, np.int64)
        ok = good[row]
        return np.where(good, cls, -1), n, (row[ok], seq[ok]), (seq[pair], seq[pair + 1], row[pair], known[pair] & known[pair + 1])

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return mix(left * _PAIR + mix(right)) & self.mask


def _summed(key: np.ndarray, same: tuple, add: tuple) -> list[np.ndarray]:
    """Sorted distinct keys, the columns equal for a key, and sums of the others."""
    o = np.argsort(key, kind="stable")
    f = runs(key[o])
    return [key[o][f], *(a[o][f] for a in same), *(np.add.reduceat(a[o], f) if len(f) else a for a in add)]


def _dealt(arrays: list[np.ndarray], nbits: int) -> pa.RecordBatch:
    """Arrays, the first sorted keys, as a blob for each bucket."""
    return _rows([(b, pack(*(a[s] for a in arrays)), None) for b, s in cut_by_bucket(arrays[0], nbits)], _ROW)


def _occurring(n: np.ndarray, cls: np.ndarray, classes: int, gone: np.ndarray) -> list[float]:
    """By class: the number of counts 1 to 4, the counts' sum and number; of those left out the number of 1, 2, and all, and the sum."""
    at = [np.bincount(cls[n == k], minlength=classes) for k in (1, 2, 3, 4)]
    at += [np.bincount(cls, n, classes), np.bincount(cls[n > 0], minlength=classes)]
    at += [np.bincount(cls[gone & ok], minlength=classes) for ok in (n == 1, n == 2, n > 0)] + [np.bincount(cls[gone], n[gone], classes)]
    return np.stack(at, axis=1).astype(float).ravel().tolist()


def _statistics(df: DataFrame, classes: int) -> np.ndarray:
    rows = df.select(F.posexplode("stat").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(classes * 10)
    for r in rows:
        out[r["at"]] = r["x"]
    return out.reshape(classes, 10)


def discounts(stat: np.ndarray) -> np.ndarray:
    """By class the discount of a count of 0, 1, 2 and 3 or more."""
    n = np.maximum(stat[:, :4], 0)
    y = n[:, 0] / np.maximum(n[:, 0] + 2 * n[:, 1], 1)
    d = [np.clip(k - (k + 1) * y * n[:, k] / np.maximum(n[:, k - 1], 1), 0, k) for k in (1, 2, 3)]
    return np.stack([np.zeros(len(n)), *d], axis=1)


def _cut(n: np.ndarray, cls: np.ndarray, d: np.ndarray) -> np.ndarray:
    return n - d[cls, np.minimum(n, 3).astype(np.int64)]


def _rare(n: np.ndarray, least: int) -> np.ndarray:
    """Words too rare for the model; the end mark, which is no context, isn't."""
    return (n < least) & (n > 0)


def _found(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys among the sorted known ones, and whether they are there."""
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return i, known[i] == keys


class Trainer:
    def __init__(self, df: DataFrame, shelf: Shelf, seqs: Sequences, classes: int, buckets: int, least: int, head: int):
        self.shelf, self.seqs, self.classes, self.nbits, self.least, self.head = shelf, seqs, classes, buckets.bit_length() - 1, least, head
        self.pairs = shelf.put(self._pairs(df))
        release(shelf.spark)
        stat = _statistics(self.pairs, classes)
        self.d, self.total = discounts(stat), stat[:, 4].sum()
        self.words = shelf.put(self._words())
        release(shelf.spark)
        stat = _statistics(self.words, classes)
        self.low, self.many = discounts(stat), np.maximum(stat[:, 4], 1)
        d = self.low[:, 1:]
        mass = lambda one, two, every, total: total - one * d[:, 0] - two * d[:, 1] - (every - one - two) * d[:, 2]
        kept = mass(stat[:, 0], stat[:, 1], stat[:, 5], stat[:, 4]) - mass(*stat[:, 6:].T)
        #: Probability of an unknown word, by class.
        self.unknown = np.maximum(1 - kept / self.many, 1e-6) / (stat[:, 5] - stat[:, 8] + 1)

    def _pairs(self, df: DataFrame) -> DataFrame:
        seqs, classes, nbits, least = self.seqs, self.classes, self.nbits, self.least

        def summed(left, right, cls, n):
            """Distinct pairs by bucket, in it by context and word, which packs best; with the first place of each bucket."""
            k, left, right, cls, n = _summed(seqs.pair(left, right), (left, right, cls), (n,))
            top = (k >> U(64 - nbits)).astype(np.int64) if nbits else np.zeros(len(k), np.int64)
            o = np.lexsort((right, left, top))
            return top[o], left[o], right[o], cls[o], n[o]

        def sent(held):
            top, *arrays = summed(*map(np.concatenate, zip(*held, strict=True)))
            f = runs(top)
            return _rows([(int(top[s]), pack(*(a[s:e] for a in arrays)), None) for s, e in zip(f, np.r_[f[1:], len(top)], strict=True)], _ROW)

        @lean
        def count(batches):
            held, size = [], 0
            for batch in batches:
                for part in slices(batch):
                    cls, _, _, (left, right, row, known) = seqs(part)
                    left, right, row = left[known], right[known], row[known]
                    held.append((left, right, cls[row].astype(np.uint16), np.ones(len(row), np.int64)))
                    size += len(row)
                    if size >= _FLUSH:
                        yield sent(held)
                        held, size = [], 0
            if size:
                yield sent(held)

        @lean
        def merge(table):
            _, left, right, cls, n = summed(*unpack_all(table["blob"], *_PAIRS))
            stat = _occurring(n, cls.astype(np.int64), classes, n < least)
            return pa.Table.from_batches([_rows([(table["bucket"][0].as_py(), pack(left, right, cls, n), stat)], _ROW)])

        return df.select("text", "lang").mapInArrow(count, _DDL).groupBy("bucket").applyInArrow(merge, _DDL)

    def _words(self) -> DataFrame:
        """By word: different words before it (N), uses as a context (n) and what of these the kept pairs keep."""
        classes, nbits, least, d = self.classes, self.nbits, self.least, self.d

        @lean
        def count(batches):
            for batch in batches:
                for blob in batch["blob"].to_pylist():
                    left, right, cls, n = unpack(blob, *_PAIRS)
                    none, one = np.zeros(len(n), np.int64), np.ones(len(n), np.int64)
                    kept = np.where(n >= least, _cut(n, cls, d), 0.0)
                    both = [np.concatenate(x) for x in ((left, right), (cls, cls), (none, one), (n, none), (kept, np.zeros(len(n))))]
                    yield _dealt(_summed(both[0], (both[1],), tuple(both[2:])), nbits)

        @lean
        def merge(table):
            k, cls, before, n, kept = unpack_all(table["blob"], *_WORDS)
            got = _summed(k, (cls,), (before, n, kept))
            stat = _occurring(got[2], got[1].astype(np.int64), classes, _rare(got[3], least))
            return pa.Table.from_batches([_rows([(table["bucket"][0].as_py(), pack(*got), stat)], _ROW)])

        return self.pairs.mapInArrow(count, _DDL).groupBy("bucket").applyInArrow(merge, _DDL)

    def valued(self):
        """A function of a word blob to its keys, n, n(v) back(v), p(w) and gain."""
        low, many, unknown, least = self.low, self.many, self.unknown, self.least

        def values(blob):
            k, cls, before, n, kept = unpack(blob, *_WORDS)
            s = ~_rare(n, least)
            k, cls, before, n, kept = k[s], cls[s], before[s], n[s], kept[s]
            back = np.where(n > 0, np.maximum(1 - kept / np.maximum(n, 1), 1e-6), 1.0)
            p = np.maximum(_cut(before, cls, low), 0) / many[cls] + unknown[cls]
            gain = np.where(before > 0, np.log(p / unknown[cls]), 0) + np.log(back)
            return k, n, n * back, p, gain

        return values

    def frequent(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, n(v) back(v) and p(w) of words that are a 2^-head of all contexts."""
        values, few, schema = self.valued(), self.total / (1 << self.head), pa.schema([("k", pa.int64()), ("a", pa.float64()), ("p", pa.float64())])

        def pick(batches):
            for batch in batches:
                for blob in batch["blob"].to_pylist():
                    k, n, a, p, _ = values(blob)
                    s = n >= max(1, few)
                    yield pa.RecordBatch.from_arrays([pa.array(k[s].view(np.int64)), pa.array(a[s]), pa.array(p[s])], schema=schema)

        got = self.words.mapInArrow(pick, "k long, a double, p double").toArrow()
        k, a, p = got["k"].to_numpy().view(np.uint64), got["a"].to_numpy(), got["p"].to_numpy()
        o = np.argsort(k)
        return k[o], a[o], p[o]

    def model(self) -> DataFrame:
        """(bucket, blob) of n-gram keys, gains and whether an n-gram is frequent, and of nothing else."""
        values, nbits, least, d, few, pair = self.valued(), self.nbits, self.least, self.d, self.total / (1 << self.head), self.seqs.pair
        sent = self.words.sparkSession.sparkContext.broadcast(self.frequent())

        def gains(k, gain, n):
            o = np.argsort(k)
            return _dealt([k[o], gain[o].astype(np.float32), (n[o] >= max(1, few)).astype(np.uint8)], nbits)

        def singles(batches):
            for batch in batches:
                for blob in batch["blob"].to_pylist():
                    k, n, _, _, gain = values(blob)
                    yield gains(k, gain, n)

        def kept(blob):
            left, right, cls, n = unpack(blob, *_PAIRS)
            s = n >= least
            return pair(left[s], right[s]), left[s], right[s], _cut(n[s], cls[s], d), n[s]

        def routed(stage):
            """Kept pairs whose context (0), or whose word (1), must be looked up in its shard, or that are done (2)."""

            @lean
            def route(batches):
                known, a, p = sent.value
                for batch in batches:
                    for blob in batch["blob"].to_pylist():
                        k, left, right, mass, n = kept(blob)
                        i, has_left = _found(left, known)
                        j, has_right = _found(right, known)
                        if stage == 0:
                            s = np.flatnonzero(~has_left)
                            s = s[np.argsort(left[s])]
                            yield _dealt([left[s], k[s], right[s], mass[s], n[s]], nbits)
                        elif stage == 1:
                            s = np.flatnonzero(has_left & ~has_right)
                            s = s[np.argsort(right[s])]
                            yield _dealt([right[s], k[s], mass[s] / a[i[s]], n[s]], nbits)
                        else:
                            s = np.flatnonzero(has_left & has_right)
                            yield gains(k[s], np.log1p(mass[s] / a[i[s]] / p[j[s]]), n[s])

            return self.pairs.mapInArrow(route, _DDL)

        def shard(table):
            got = [values(b) for b in table["blob"].to_pylist()]
            return got[0] if got else (np.empty(0, np.uint64), *(np.empty(0),) * 4)

        @lean
        def contexts(asks, words):
            known, _, a, _, _ = shard(words)
            left, k, right, mass, n = unpack_all(asks["blob"], np.uint64, np.uint64, np.uint64, np.float64, np.int64)
            i, ok = _found(left, known)
            s = np.flatnonzero(ok)
            s = s[np.argsort(right[s])]
            return pa.Table.from_batches([_dealt([right[s], k[s], mass[s] / a[i[s]], n[s]], nbits)], _ROW)

        @lean
        def targets(asks, words):
            known, _, _, p, _ = shard(words)
            right, k, share, n = unpack_all(asks["blob"], np.uint64, np.uint64, np.float64, np.int64)
            i, ok = _found(right, known)
            s = np.flatnonzero(ok)
            return pa.Table.from_batches([gains(k[s], np.log1p(share[s] / p[i[s]]), n[s])], _ROW)

        words = self.words.groupBy("bucket")
        step = routed(0).groupBy("bucket").cogroup(words).applyInArrow(contexts, _DDL)
        step = routed(1).unionAll(step).groupBy("bucket").cogroup(words).applyInArrow(targets, _DDL)
        out = self.shelf.put(self.words.mapInArrow(singles, _DDL).unionAll(routed(2)).unionAll(step).select("bucket", "blob"))
        sent.destroy()
        self.shelf.drop(self.pairs, self.words)
        return out


def bloom_bits(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(keys ^ _PAIR)
    return (h >> U(64 - bits)).astype(np.int64), (h & U((1 << bits) - 1)).astype(np.int64)


def bloom_of(df: DataFrame, keys, bits: int) -> np.ndarray:
    """A filter of 2^bits bits over what ``keys`` finds in the batches; its size doesn't depend on their number."""
    schema = pa.schema([("slice", pa.int32()), ("task", pa.int32()), ("blob", pa.binary())])
    width = 1 << max(0, bits - 3 - 6)

    @lean
    def mark(batches):
        field = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            for k in keys(batch):
                for at in bloom_bits(k, bits):
                    np.bitwise_or.at(field, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for s in range(0, len(field), width):
            if field[s : s + width].any():
                yield _rows([(s // width, TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=1).compress(field[s : s + width].tobytes()))], schema)

    def merge(table):
        """One slice of several: they are read one after the other."""
        field = np.zeros(width, np.uint8)
        for b in table["blob"]:
            field |= np.frombuffer(zstandard.ZstdDecompressor().decompress(b.as_py()), np.uint8)
        blob = zstandard.ZstdCompressor(level=1).compress(field.tobytes())
        return pa.Table.from_batches([_rows([(table["slice"][0].as_py(), table["task"][0].as_py(), blob)], schema)])

    ddl, out = "slice int, task int, blob binary", np.zeros(1 << (bits - 3), np.uint8)
    rows = df.mapInArrow(mark, ddl)
    for _ in range(2):  # 64 tasks' slices at a time, so that no group has more than a few megabytes
        rows = rows.withColumn("task", F.expr("task DIV 64")).groupBy("slice", "task").applyInArrow(merge, ddl)
    for r in rows.groupBy("slice").applyInArrow(merge, ddl).collect():
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["blob"]), np.uint8)
    return out


def in_bloom(field: np.ndarray, keys: np.ndarray) -> np.ndarray:
    ok = np.ones(len(keys), bool)
    for at in bloom_bits(keys, len(field).bit_length() + 2):
        ok &= (field[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
    return ok


_MODEL = (np.uint64, np.float32, np.uint8)
_STATS = (np.int64, np.uint8, np.int64, np.int64, np.int64, np.float64)


def _scored(docs: DataFrame, model: DataFrame, shelf: Shelf, seqs: Sequences, buckets: int, bloom: int, rounds: int) -> list[DataFrame]:
    """doc_id, mark, class, words and gain (over unknown words) of each document, a table on the shelf for each round."""
    spark, nbits = docs.sparkSession, buckets.bit_length() - 1

    def every(batch):
        for blob in batch["blob"].to_pylist():
            yield unpack(blob, *_MODEL)[0]

    def head(batches):
        for batch in batches:
            for blob in batch["blob"].to_pylist():
                k, gain, often = unpack(blob, *_MODEL)
                yield pa.RecordBatch.from_arrays([pa.array(k[often > 0].view(np.int64)), pa.array(gain[often > 0])], names=["k", "gain"])

    got = model.mapInArrow(head, "k long, gain float").toArrow()
    often, gain = got["k"].to_numpy().view(np.uint64), got["gain"].to_numpy()
    o = np.argsort(often)
    sent = spark.sparkContext.broadcast((often[o], gain[o], bloom_of(model, every, bloom)))
    release(spark)
    schema = pa.schema([("bucket", pa.int32()), ("base", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])
    ddl = "bucket int, base long, kind int, blob binary"

    @lean
    def ask(batches):
        known, gain, field = sent.value
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, most=2 << 20):
                cls, n, (row, seq), (left, right, at, _) = seqs(part)
                row, key = np.r_[row, at], np.r_[seq, seqs.pair(left, right)]
                i, here = _found(key, known)
                local = np.bincount(row[here], gain[i[here]], part.num_rows)
                s = np.flatnonzero(~here)
                s = s[in_bloom(field, key[s])]
                s = s[np.argsort(key[s], kind="stable")]
                key, row = key[s], row[s].astype(np.uint32)
                f = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])]) if len(key) else np.empty(0, np.int64)
                count = np.diff(np.r_[f, len(key)]).astype(np.uint32)
                yield _rows([(b, base, 0, pack(key[f][x], row[f][x], count[x])) for b, x in cut_by_bucket(key[f], nbits)], schema)
                ids = part["doc_id"]
                mine = pack(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8), part["mark"].to_numpy(), cls, n, local)
                yield _rows([(int(mix(np.array([base], np.uint64))[0] >> U(64 - nbits)) if nbits else 0, base, 1, mine)], schema)
                base += part.num_rows

    @lean
    def answer(asks, shards):
        known, gain, _ = unpack_all(shards["blob"], *_MODEL)
        o = np.argsort(known)
        known, gain, rows = known[o], gain[o], []
        for base, kind, blob in zip(*(asks[c].to_pylist() for c in ("base", "kind", "blob")), strict=True):
            home = int(mix(np.array([base], np.uint64))[0] >> U(64 - nbits)) if nbits else 0
            if kind == 0:
                key, row, count = unpack(blob, np.uint64, np.uint32, np.uint32)
                i, ok = _found(key, known)
                if not ok.any():
                    continue
                total = np.bincount(row[ok], gain[i[ok]] * count[ok])
                row = np.flatnonzero(np.bincount(row[ok])).astype(np.uint32)
                blob = pack(row, total[row].astype(np.float32))
            rows.append((home, base, kind, blob))
        return pa.Table.from_batches([_rows(rows, schema)])

    out = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("class", pa.int64()), ("words", pa.int64()), ("gain", pa.float64())])

    @lean
    def total(table):
        done, rows = {}, table.to_pydict()
        for base, kind, blob in zip(rows["base"], rows["kind"], rows["blob"], strict=True):
            if kind:
                done[base] = [np.array(x) for x in unpack(blob, *_STATS)]
        for base, kind, blob in zip(rows["base"], rows["kind"], rows["blob"], strict=True):
            if not kind:
                row, gain = unpack(blob, np.uint32, np.float32)
                done[base][5][row] += gain
        parts = [pa.RecordBatch.from_arrays([pa.array(i, mask=ok == 0), pa.array(mark), pa.array(cls), pa.array(n), pa.array(gain)], schema=out) for i, ok, mark, cls, n, gain in done.values()]
        return pa.Table.from_batches(parts, out)

    done = []
    for k in range(rounds):
        share = docs.where(F.expr(f"pmod(xxhash64(doc_id, octet_length(text)), {rounds}) = {k}"))
        asks = share.select("doc_id", "mark", "text", "lang").mapInArrow(ask, ddl)
        answers = asks.groupBy("bucket").cogroup(model.groupBy("bucket")).applyInArrow(answer, ddl)
        done.append(shelf.put(answers.groupBy("bucket").applyInArrow(total, "doc_id long, mark long, class long, words long, gain double")))
        release(spark)  # the next round's n-grams take the place of this one's
    sent.destroy()
    return done


def perplexities(df: DataFrame, labels: DataFrame, quantile: float = 0.99, margin: float = 1.15, prior: int = 8, least: int = 1, folds: int = 4, head: int = 20, bloom: int = 27, languages: int = 1000, repeats: bool = True, rounds: int = 4) -> DataFrame:
    """doc_id, mark (a hash of the text), lang (null without a model), n_words, perplexity, threshold and kept of each document of ``df`` (doc_id, text, lang); labels (doc_id, quality)."""
    spark, shelf = df.sparkSession, Shelf(df.sparkSession, "quality")
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    trust = shelf.put(labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id")).distinct().withColumn("held", F.expr(f"pmod(xxhash64(id, 17), {folds}) = 0")))
    counts = docs.select("doc_id", "lang").join(trust, F.col("doc_id") == F.col("id"), "left_semi").groupBy("lang").count()
    ranked = [r["lang"] for r in counts.orderBy(F.desc("count"), F.col("lang").asc_nulls_last()).limit(languages + 1).collect()]
    classes = {x: k for k, x in enumerate(ranked[:languages])}
    other = languages if len(ranked) > languages else None
    n_classes = max(1, len(classes) + (other is not None))
    size = input_bytes(docs)
    seqs = Sequences(classes, other, min(64, max(48, 8 * -(-(18 + size.bit_length()) // 8))), repeats)
    buckets = n_buckets(docs, each=8 << 20)

    counted = trust.where("NOT held")
    few = bloom_of(counted, lambda b: [b["id"].to_numpy().view(np.uint64)], min(bloom, 26))
    sent = spark.sparkContext.broadcast(few)

    @lean
    def likely(batches):
        for batch in batches:
            ids = batch["doc_id"]
            yield batch.filter(pa.array(ids.is_valid().to_numpy(zero_copy_only=False) & in_bloom(sent.value, ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64))))

    maybe = docs.mapInArrow(likely, "doc_id long, text string, lang string")
    # by the same join at every size: no broadcast of ids while they are few
    trained = maybe.join(counted.hint("merge"), F.col("doc_id") == F.col("id"), "left_semi")
    trainer = Trainer(trained, shelf, seqs, n_classes, buckets, least, head)
    model = trainer.model()
    sent.destroy()
    release(spark)
    unknown = np.log(trainer.unknown)
    names = {k: x for x, k in classes.items()}
    table = [(k, names.get(k), float(unknown[k])) for k in range(n_classes)]
    table = F.broadcast(spark.createDataFrame(table, "class long, lang string, unknown double"))

    # a table of a few megabytes takes little disk in one round
    gains = _scored(docs.withColumn("mark", F.xxhash64("text")), model, shelf, seqs, buckets, bloom, rounds if size >= 8 << 20 else 1)
    shelf.drop(model)
    sums = reduce(DataFrame.unionAll, gains).join(table, "class", "left").withColumn("loss", F.expr("-gain - (words + 1) * unknown"))
    sums = shelf.put(sums.join(trust.selectExpr("id AS doc_id", "held"), "doc_id", "left"))
    shelf.drop(*gains, trust)
    # by class and whether held out; held-out documents count where there are any
    means = sums.where("held IS NOT NULL AND loss IS NOT NULL").groupBy("class").agg(F.expr("coalesce(sum(loss) FILTER (WHERE held) / sum(words + 1) FILTER (WHERE held), sum(loss) / sum(words + 1))").alias("mean"))
    scored = sums.join(F.broadcast(means), "class", "left").withColumn("perplexity", F.expr(f"exp((loss + {prior} * mean) / (words + 1 + {prior}))"))
    cut = scored.where("held IS NOT NULL AND perplexity IS NOT NULL").groupBy("class").agg(
        F.percentile_approx(F.when(F.col("held"), F.col("perplexity")), quantile, 10_000).alias("unseen"), F.percentile_approx("perplexity", quantile, 10_000).alias("seen"))
    cut = shelf.put(cut.select("class", (margin * F.coalesce("unseen", "seen")).alias("threshold")))
    shelf.keep(sums, cut)
    out = scored.join(F.broadcast(cut), "class", "left")
    return out.selectExpr("doc_id", "mark", "lang", "words AS n_words", "perplexity", "threshold", "coalesce(perplexity <= threshold, true) AS kept")
