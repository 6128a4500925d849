"""Quality rules: plain counts, and the divergence of a document from its language.

Counts of words, repeats and symbols come from one pass over the texts, together with
two histograms of each document: its characters by class, and its words by the common
words of its language (those that make up one of ``common`` words or more of all
its texts, so at most ``common`` of them), all others being one bin.  A language's
reference is the sum of these histograms over its distinct texts that pass the base
rules, so a text that stands there many times counts once.  A document is rejected
when the Jensen-Shannon distance (base 2, 0 to 1) of either histogram from its
language's reference exceeds its limit.

Short texts are far from any reference by chance.  A histogram of n draws from a
reference with k bins in use has an expected divergence of about (k - 1) / (8 n)
nats, less where n is small beside k; the limit on the squared distance is raised by
``char_slack`` or ``word_slack`` times that.  Texts with
fewer than ``least_words`` words, or languages with fewer than ``least_texts``
distinct texts, are not judged by distance.

At most ``languages`` languages, those with most documents, have references of their
own; all others share one.  These references are all that goes to the driver
and to each task: at most (languages + 1) * (common + 10) numbers.

Defined cases: null text has no words and fails the base rules; a null ``lang`` is a
language of its own; a repeated row is judged each time; texts of any length are read
whole; an empty table gives none; a null ``doc_id`` is kept as null; a distance equal
to its limit stays; extra columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shelf, U, hash_words, lean, mix, slices, text_buffers, windows_at

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
#: Classes of characters: lower case, upper case, digits, spaces, line ends, punctuation, symbols, other ASCII, beyond ASCII.
CLASSES = 9
_CLASS = np.full(256, 7, np.int64)
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\x0b\x0c\r", "\n", ".,;:!?'\"()-", _SYMBOLS)):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[0x80:0xC0], _CLASS[0xC0:] = 9, 8  # bytes that follow the first of a code point are no characters
_ROW = mix(np.array([0x51ED2701], np.uint64))[0]


def _language(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.expr("coalesce('=' || CAST(lang AS STRING), '')").alias("lang"))


def common_words(docs: DataFrame, shelf: Shelf, common: int = 1024, languages: int = 256) -> DataFrame:
    """(class, lang, word, n) of each language's common words; languages beyond the first ``languages`` are one class, without ``lang``."""
    rank = Window.orderBy(F.desc("rows"), "lang")
    ranked = docs.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(languages)
    ranked = ranked.select("lang", F.row_number().over(rank).alias("class"))
    words = docs.where("text IS NOT NULL").select("lang", F.explode(F.split("text", "[ \\t-\\r]+")).alias("word")).where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))
    words = words.join(F.broadcast(ranked), "lang", "left").select(F.coalesce("class", F.lit(0)).alias("class"), F.when(F.col("class").isNotNull(), F.col("lang")).alias("lang"), "word", "n")
    words = shelf.put(words.groupBy("class", "lang", "word").agg(F.sum("n").alias("n")))
    total = words.groupBy("class").agg(F.sum("n").alias("total"))
    return words.join(F.broadcast(total), "class").where(F.col("n") * common >= F.col("total")).select("class", "lang", "word", "n")


def _repeated(words: np.ndarray, at: np.ndarray, width: int = 3) -> np.ndarray:
    """Words of each row in windows of ``width`` words that occur twice or more in the row."""
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    g = np.flatnonzero(np.arange(len(words)) - at[:-1][row] <= n[row] - width)
    key = mix(windows_at(words, g, width, 0x2545F4914F6CDD1D) ^ mix(row[g].astype(np.uint64) + _ROW))
    o = np.argsort(key, kind="stable")
    same = key[o][1:] == key[o][:-1]
    hit = g[o[np.r_[False, same] | np.r_[same, False]]] if len(g) else g
    inside = np.zeros(len(words) + 1, bool)
    for j in range(width):
        inside[hit + j] = True
    return np.bincount(row[inside[:-1]], minlength=len(n))


_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("class", pa.int32()), *((c, pa.int64()) for c in _STATS), ("base_failed", pa.bool_()), ("chars", pa.list_(pa.int64())), ("bins", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("sha", pa.string())])
_DDL = "doc_id long, class int, " + ", ".join(f"{c} long" for c in _STATS) + ", base_failed boolean, chars array<long>, bins array<int>, counts array<int>, sha string"


def _measure(docs: DataFrame, classes: dict[str, int], bins: dict[int, tuple[np.ndarray, np.ndarray]], least_words: int) -> DataFrame:
    """Counts and histograms of each document; ``bins`` has a class's sorted word hashes and their bins."""
    none = (np.empty(0, np.uint64), np.empty(0, np.int32))

    def rows(part: pa.RecordBatch):
        texts = [t or "" for t in part["text"].to_pylist()]
        words, at = hash_words(part["text"])
        n, repeats = np.diff(at), _repeated(words, at)
        raw, ends = text_buffers(part["text"])
        kinds = _CLASS[raw]
        for i, (doc, lang, text, sha) in enumerate(zip(part["doc_id"].to_pylist(), part["lang"].to_pylist(), texts, part["sha"].to_pylist(), strict=True)):
            chars = np.bincount(kinds[ends[i] : ends[i + 1]], minlength=10)[:CLASSES]
            lines = [x for x in text.split("\n") if x.strip(_SPACES)]
            cls = classes.get(lang, 0)
            keys, places = bins.get(cls, none)
            own = words[at[i] : at[i + 1]]
            k = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hist = np.bincount(places[k[keys[k] == own]]) if len(keys) and len(own) else np.empty(0, np.int64)
            used = np.flatnonzero(hist)
            failed = n[i] < least_words or 100 * repeats[i] > 50 * n[i]
            yield doc, cls, int(n[i]), int(chars.sum() - chars[3] - chars[4]), int(chars[6]), len(lines) - len(set(lines)), int(repeats[i]), bool(failed), chars, used, hist[used], sha

    @lean
    def measure(batches):
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows(part), strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    return docs.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).mapInArrow(measure, _DDL)


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence (base 2) of each row of ``p`` from ``q``, both of counts."""
    p, q = p / p.sum(axis=1, keepdims=True), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(x > 0, x * np.log2(x / m), 0.0).sum(axis=1) for x in (p, np.broadcast_to(q, p.shape))]
    return np.maximum(0.0, (parts[0] + parts[1]) / 2)


def divergence_rules(docs: DataFrame, most_chars: float = 0.28, most_words: float = 0.36, char_slack: float = 4.0, word_slack: float = 0.4, least_words: int = 50, least_texts: int = 20, common: int = 1024, languages: int = 256) -> DataFrame:
    """doc_id, the five counts, base_failed, kept, char_distance and word_distance (null where not judged) of each document of ``docs`` (doc_id, text, lang)."""
    docs, shelf = _language(docs), Shelf(docs.sparkSession, "divergence")
    listed = sorted(common_words(docs, shelf, common, languages).collect())
    classes = {r["lang"]: r["class"] for r in listed if r["lang"] is not None}
    names: dict[int, list[str]] = {}
    for r in listed:
        names.setdefault(r["class"], []).append(r["word"])
    bins = {}
    for cls, words in names.items():
        keys = hash_words(pa.array(words))[0]
        o = np.argsort(keys)
        bins[cls] = keys[o], o.astype(np.int32)
    stats = shelf.put(_measure(docs, classes, bins, least_words))
    trusted = stats.where("NOT base_failed").groupBy("class", "sha").agg(F.first("n_words").alias("n_words"), F.first("chars").alias("chars"), F.first(F.struct("bins", "counts")).alias("hist"))
    trusted = shelf.put(trusted)
    whole = trusted.groupBy("class").agg(F.count("*").alias("texts"), F.sum("n_words").alias("n"), *(F.sum(F.col("chars")[k]).alias(f"c{k}") for k in range(CLASSES)))
    found = trusted.select("class", F.explode(F.arrays_zip("hist.bins", "hist.counts")).alias("x")).groupBy("class", "x.bins").agg(F.sum("x.counts").alias("n"))
    texts, chars, hists = {}, {}, {}
    for r in whole.collect():
        texts[r["class"]], chars[r["class"]] = r["texts"], np.array([r[f"c{k}"] for k in range(CLASSES)], float)
        hists[r["class"]] = np.zeros(len(names.get(r["class"], ())) + 1)
        hists[r["class"]][-1] = r["n"]
    for cls, k, n in found.collect():
        hists[cls][k] += n
        hists[cls][-1] -= n
    spread = lambda h: (np.count_nonzero(h) - 1) / (8 * math.log(2))
    limits = {c: (char_slack * spread(chars[c]), word_slack * spread(hists[c])) for c in texts}
    schema = pa.schema([*list(_SCHEMA)[:1], *list(_SCHEMA)[2:8], ("kept", pa.bool_()), ("char_distance", pa.float64()), ("word_distance", pa.float64())])

    @lean
    def judge(batches):
        for batch in batches:
            cls, n, failed = batch["class"].to_numpy(), batch["n_words"].to_numpy(), batch["base_failed"].to_numpy(zero_copy_only=False)
            far = np.full((2, batch.num_rows), np.nan)
            kept = ~failed
            for c in np.unique(cls):
                own = np.flatnonzero((cls == c) & (n >= least_words))
                if texts.get(c, 0) < least_texts or not len(own):
                    continue
                seen = np.array(batch["chars"].take(pa.array(own)).to_pylist(), float)
                hist = np.zeros((len(own), len(hists[c])))
                for k, (b, x) in enumerate(zip(batch["bins"].take(pa.array(own)).to_pylist(), batch["counts"].take(pa.array(own)).to_pylist(), strict=True)):
                    hist[k, b] = x
                hist[:, -1] = n[own] - hist[:, :-1].sum(axis=1)
                by_char, by_word = distances(seen, chars[c]), distances(hist, hists[c])
                far[0, own], far[1, own] = np.sqrt(by_char), np.sqrt(by_word)
                kept[own] &= (by_char <= most_chars**2 + limits[c][0] / seen.sum(axis=1)) & (by_word <= most_words**2 + limits[c][1] / n[own])
            columns = [batch[c] for c in schema.names[:7]] + [pa.array(kept), *(pa.array(x, from_pandas=True) for x in far)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    ddl = "doc_id long, " + ", ".join(f"{c} long" for c in _STATS) + ", base_failed boolean, kept boolean, char_distance double, word_distance double"
    return stats.drop("sha").mapInArrow(judge, ddl)
