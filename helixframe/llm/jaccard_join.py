"""N-gram Jaccard join with PartEnum signatures.

A document's set is its distinct word shingles.  Sizes fall into bands, each at
most 1/threshold times as wide as its start, so similar sets lie in one band or
in neighbours.  Per band a bound k on the symmetric difference follows from the
threshold.  The feature domain is hashed into n1 groups of n2 partitions; sets
at distance k or less agree, in some group, on n2 - k2 of its partitions when
n1 * (k2 + 1) > k.  Each such subset of partitions, with the set's features in
it, is a signature.  A set signs its own band and the next.

There are more partitions than a match needs, so similar sets share not one
signature but at least ``need`` of them: what is left of all when k differences
fall where they spoil most.  A set whose shared signatures number less than its
need, less its empty subsets (which it needn't sign then), has no partner and
goes; what only it shared goes with it.  That drops sets which merely hold a
passage of others before any pair is made, and no pair is lost or bucket capped.

Equal sets are one node.  Tasks aggregate before they deal signatures, and each
bucket's sets stay rows, not pairs.  First each set is compared with the one
pivot that shares most signatures with it; what links joins, and buckets within
one component are done.  In what is left, buckets of at most ``few`` sets make
their pairs, those that share too few of them are no links, the others are
compared.  The sets of larger buckets are reduced to their differences from the
bucket's pivot, and only those meet that share rare differences (see ``_large``).
Every pair is linked, joined otherwise, ruled out or compared: the components are
exact, and a group of near copies makes no more pairs than its copies have
changes in common.

Defined cases: an empty table gives none; null or blank text has an empty set and
links with nothing; fewer words than a shingle count as one shingle; texts of any
length are read whole, in parts of bounded size; pairs at the threshold exactly
are links; a null ``doc_id`` links with nothing
and gets a null component; rows that repeat a ``doc_id`` with other text link
what both texts link; extra columns are left out.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Dealer, Shelf, U, dealt, hash_words, lean, mix, n_buckets, release, runs, slices, windows_at
from .components import components

_N, _S, _P, _C = 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xD1342543DE82EF95, 0xA24BAED4963EE407

#: The need within a member's ``need`` column.
_NEED = "((need & 4294967295) DIV 2)"


def bands(num: int, den: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the bands up to the one after the band that holds ``size``."""
    starts, ends = [1], [den // num]
    while len(ends) < 2 or ends[-2] < size:
        starts.append(ends[-1] + 1)
        ends.append(starts[-1] * den // num)
    return np.array(starts), np.array(ends)


def need_of(n1: int, n2: int, k2: int, k: int) -> int:
    """Of n1 * C(n2, k2) signatures, those that any k differences leave: a group's first spoils most, so they spread."""
    left = [comb(max(0, n2 - e), n2 - k2) for e in range(n2 + 1)]
    total, k = n1 * left[0], k
    for e in range(n2):
        hit = min(k, n1)
        total, k = total - hit * (left[e] - left[e + 1]), k - hit
    return max(0, total)


def plan(end: int, num: int, den: int, spare: float = 1.5) -> tuple[int, int, int, list[tuple[int, ...]]]:
    """n1, n2, need and subsets for the band up to ``end``: halves of groups, ``spare`` times as many as one match needs."""
    k = 2 * end * (den - num) // (den + num)
    if k == 0:
        return 1, 1, 1, [(0,)]
    n1, n2, k2 = ceil(spare * (k + 1) / 2), 2, 1
    return n1, n2, need_of(n1, n2, k2, k), list(combinations(range(n2), n2 - k2))


def _sets(part: pa.RecordBatch, size: int):
    """Of each row, the sorted distinct shingle hashes."""
    words, at = hash_words(part["text"], lower=True)
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(words)) - at[:-1][row]
    g = np.flatnonzero(place <= n[row] - size)
    h, h_at = windows_at(words, g, size, _N), np.r_[0, np.cumsum(np.maximum(n - size + 1, 0))]
    for i in range(part.num_rows):
        if n[i] >= size:
            yield np.unique(h[h_at[i] : h_at[i + 1]])
        elif n[i]:
            yield windows_at(words[at[i] : at[i + 1]], np.zeros(1, np.int64), int(n[i]), _S) + U(int(n[i]))
        else:
            yield np.empty(0, np.uint64)


def _key(u: np.ndarray, seed: int) -> int:
    return int(mix(np.add.reduce(mix(u ^ U(seed)), keepdims=True) + U(len(u))).view(np.int64)[0])


def _keys(df: DataFrame, size: int, seed: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64())])

    @lean
    def keys(batches):
        for batch in batches:
            for part in slices(batch):
                rows = []
                for i, m, u in zip(part["doc_id"].to_pylist(), part["mark"].to_pylist(), _sets(part, size), strict=True):
                    rows.append((i, m, len(u), *((_key(u, _P + seed), _key(u, _C + seed)) if len(u) and i is not None else (None, None))))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return df.withColumn("mark", F.xxhash64("text")).mapInArrow(keys, "doc_id long, mark long, n_shingles long, k1 long, k2 long")


class _Signer:
    def __init__(self, num: int, den: int):
        self.num, self.den, self.size = num, den, 0
        self.plans: dict[int, tuple] = {}

    def __call__(self, u: np.ndarray):
        """For the set's own band and the next: signatures, and (slack << 32) + 2 * need + (0 or 1); slack is what the band's end exceeds the size by."""
        if len(u) > self.size:
            self.size = 2 * len(u)
            self.starts, self.ends = bands(self.num, self.den, self.size)
        own = int(np.searchsorted(self.ends, len(u)))
        where, what = mix(u ^ U(_S)) >> U(32), mix(u ^ U(_C))
        low, high = (what & U(0x3FFFFFF)).astype(float), (what >> U(38)).astype(float)
        for step in (0, 1):
            band = own + step
            if band not in self.plans:
                self.plans[band] = plan(int(self.ends[band]), self.num, self.den)
            n1, n2, need, subsets = self.plans[band]
            p = (where % U(n1 * n2)).astype(np.int64)
            count = np.bincount(p, minlength=n1 * n2).reshape(n1, n2)
            held = np.bincount(p, low, n1 * n2).astype(np.uint64) * U(_P) + np.bincount(p, high, n1 * n2).astype(np.uint64)
            held = mix(held + np.arange(n1 * n2, dtype=np.uint64) * U(_N)).reshape(n1, n2)
            sig = np.stack([np.add.reduce(held[:, s], axis=1) + U(j) for j, s in enumerate(map(list, subsets))], axis=1)
            full = np.stack([count[:, s].sum(axis=1) > 0 for s in map(list, subsets)], axis=1)
            sig = mix(sig ^ U(band * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            empty = int(full.size - full.sum())
            slack = (int(self.ends[band]) - len(u)) << 32
            yield (sig[full], slack + 2 * (need - empty) + step) if need > empty else (sig.ravel(), slack + 2 + step)


def _shared(df: DataFrame, size: int, seed: int, num: int, den: int, buckets: int) -> DataFrame:
    """(sig, id, need): the members of each signature that different sets share."""

    def settle(sig, key, need, several):
        o = np.lexsort((key, sig))
        sig, key, need, several = sig[o], key[o], need[o], several[o]
        new = np.r_[True, (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])]
        f = np.flatnonzero(new)
        several = np.maximum.reduceat(several, f)
        sig, key, need = sig[f], key[f], need[f]
        f = runs(sig)
        n = np.diff(np.r_[f, len(sig)])
        head = np.zeros(len(sig), bool)
        head[f] = True
        return (sig[f], key[f], need[f], (np.maximum.reduceat(several, f) | (n > 1)).astype(np.uint8)), (key[~head], sig[~head], need[~head])  # dealt by set: one signature may have very many

    @lean
    def sign(batches):
        out, signer = Dealer(buckets, settle), _Signer(num, den)
        for batch in batches:
            for part in slices(batch):
                known = part["doc_id"].is_valid().to_pylist()
                for ok, u in zip(known, _sets(part, size), strict=True):
                    if ok and len(u):
                        key = _key(u, _P + seed)
                        for s, need in signer(u):
                            yield from out.add(s, np.full(len(s), key, np.int64), np.full(len(s), need, np.int64), np.zeros(len(s), np.uint8))
        yield from out.flush()

    schema = pa.schema([("sig", pa.int64()), ("id", pa.int64()), ("need", pa.int64())])

    @lean
    def reduce(table):
        mine, done = dealt(table, (np.uint64, np.int64, np.int64, np.uint8), (np.int64, np.uint64, np.int64))
        if len(mine[0]):
            (sig, key, need, several), rest = settle(*mine)
            ok = several > 0
            done = [np.concatenate(x) for x in zip(done, rest, (key[ok], sig[ok], need[ok]), strict=True)]
        return pa.Table.from_arrays([pa.array(done[1].view(np.int64)), pa.array(done[0]), pa.array(done[2])], schema=schema)

    return df.mapInArrow(sign, Dealer.ddl).groupBy("bucket").applyInArrow(reduce, "sig long, id long, need long")


def _needful(members: DataFrame, shelf: Shelf) -> DataFrame:
    """(sig, id, need) of the sets that share as many signatures as they need; again while that drops a fiftieth of the rows."""
    n = members.count()
    while True:
        enough = members.groupBy("id", "need").agg(F.count("*").alias("n")).where(f"n >= {_NEED}").select("id", "need")
        kept = members.join(enough, ["id", "need"], "left_semi")
        several = kept.groupBy("sig").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("sig")
        kept = shelf.put(kept.join(several, "sig", "left_semi").select("sig", "id", "need"))
        shelf.drop(members)
        was, n, members = n, kept.count(), kept
        if n >= 0.98 * was:
            return members.distinct()


def _hashes(df: DataFrame, size: int, seed: int) -> DataFrame:
    """(id, shingles) of rows (id, text) whose set has that key; other texts of a repeated doc_id go."""
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.binary())])

    @lean
    def hashes(batches):
        for batch in batches:
            for part in slices(batch):
                rows = [(i, u.tobytes()) for i, u in zip(part["id"].to_pylist(), _sets(part, size), strict=True) if len(u) and _key(u, _P + seed) == i]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return df.mapInArrow(hashes, "id long, shingles binary")


def _links(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    @lean
    def compare(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], schema=schema).filter(pa.array(ok, pa.bool_()))

    near = F.expr(f"{den} * least(length(x), length(y)) >= {num} * greatest(length(x), length(y))")
    sets = sets.select("id", "shingles")
    pairs = pairs.join(sets.selectExpr("id AS a", "shingles AS x"), "a").join(sets.selectExpr("id AS b", "shingles AS y"), "b")
    return pairs.where(near).mapInArrow(compare, "a long, b long")


def _named(rows: DataFrame, joined: DataFrame) -> DataFrame:
    return rows.join(joined, "id", "left").selectExpr("sig", "id", "need", "coalesce(component, id) AS component")


def _open(members: DataFrame, joined: DataFrame) -> DataFrame:
    """(sig, id, need) of buckets that hold several components, for sets that have as many such buckets as they need."""
    named = _named(members, joined)
    mixed = named.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("sig")
    rows = members.join(mixed, "sig", "left_semi")
    enough = rows.groupBy("id", "need").agg(F.count("*").alias("n")).where(f"n >= {_NEED}").select("id", "need")
    return rows.join(enough, ["id", "need"], "left_semi").select("sig", "id", "need")


def _pivots(rows: DataFrame) -> DataFrame:
    """(sig, p): of each bucket the set whose buckets are the fullest: the text that copies were made from shares all its buckets, a copy none of those it changed."""
    full = rows.groupBy("sig").agg(F.count("*").alias("f"))
    score = rows.join(full, "sig").groupBy("id").agg(F.sum("f").alias("score"))
    return rows.join(score, "id").groupBy("sig").agg(F.expr("max_by(id, struct(score, xxhash64(id)))").alias("p"))


def _quick(rows: DataFrame) -> DataFrame:
    """(a, b): each set with that pivot, one per bucket, with which it shares most buckets.

    """
    best = rows.join(_pivots(rows), "sig").where("id <> p").groupBy("id", "p").agg(F.count("*").alias("n")).groupBy("id").agg(F.max(F.struct("n", "p"))["p"].alias("p"))
    return best.selectExpr("least(id, p) AS a", "greatest(id, p) AS b").distinct()


def _sized(rows: DataFrame) -> DataFrame:
    """(sig, id, need, f) with the bucket's size ``f``."""
    return rows.join(rows.groupBy("sig").agg(F.count("*").alias("f")), "sig").select("sig", "id", "need", "f")


def _small(sized: DataFrame, joined: DataFrame, few: int, num: int, den: int) -> DataFrame:
    """(a, b): sets of different components that share enough buckets of at most ``few`` sets, so at most few / 2 pairs a row.

    What links shares as many buckets as the larger need.  Either at least half of
    these are small ones, or more than the other half are large (see ``_apart``).
    Needs are for sets as large as the band allows; smaller ones may
    differ less, so they share more: what their slacks take off the allowed
    differences.
    """
    rows = _named(sized.where(F.col("f") <= few), joined)
    others = rows.selectExpr("sig", "id AS p", "need AS m", "component AS c")
    met = rows.join(others, "sig").where("c <> component AND id < p").groupBy("id", "need", "p", "m").agg(F.count("*").alias("n"))
    most, sure = f"greatest({_NEED}, {_NEED.replace('need', 'm')})", f"(((need >> 32) + (m >> 32)) * {den - num}) DIV {den + num}"
    return met.where(f"n >= {most} + {sure} - {most} DIV 2").selectExpr("id AS a", "p AS b").distinct()


def _apart(sized: DataFrame, few: int) -> DataFrame:
    """(id, p): sets with the pivots of their buckets of more than ``few`` sets, less half as many of these buckets as a set needs.

    Two sets that must meet here share more than half of the larger need.  All sets
    leave out buckets in one order, so of those that two share the last stays with
    both.  Pivots of the fewest rows go first: sets that share a passage with many
    keep the pivot that is most like them, not one for each passage.
    """
    rows = sized.where(F.col("f") > few).select("sig", "id", "need")
    pivots = rows.join(_pivots(rows), "sig")
    named = pivots.join(pivots.groupBy("p").agg(F.count("*").alias("w")), "p")
    by = Window.partitionBy("id", "need").orderBy("w", "p", "sig")
    return named.withColumn("r", F.row_number().over(by)).where(f"r > {_NEED} DIV 2").select("id", "p").distinct()


def _differences(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(p, id, n, pn, d, outer, diff) of pairs (id, p): sizes, the shingles in which a set differs from its pivot, and whether it doesn't link with it."""
    schema = pa.schema([("p", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("pn", pa.int64()), ("d", pa.int64()), ("outer", pa.bool_()), ("diff", pa.list_(pa.int64()))])

    @lean
    def differ(batches):
        for batch in batches:
            rows = []
            for p, i, x, y in zip(batch["p"].to_pylist(), batch["id"].to_pylist(), batch["x"], batch["y"], strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                diff = np.setxor1d(x, y, assume_unique=True)
                rows.append((p, i, len(x), len(y), len(diff), (den + num) * len(diff) > (den - num) * (len(x) + len(y)), diff.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 7, schema, strict=True)], schema=schema)

    sets = sets.select("id", "shingles")
    pairs = pairs.join(sets.selectExpr("id AS p", "shingles AS y"), "p").join(sets.selectExpr("id", "shingles AS x"), "id")
    return pairs.select("p", "id", "x", "y").mapInArrow(differ, "p long, id long, n long, pn long, d long, outer boolean, diff array<long>")


def _large(sized: DataFrame, joined: DataFrame, few: int, sets: DataFrame, shelf: Shelf, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(a, b) twice: links with pivots, and pairs to compare, for buckets of more than ``few`` sets.

    Each set is reduced to its difference from the bucket's pivot.  Sets that link
    with the pivot are one component, so of a pair that matters one, y, is outer.
    Symmetric differences are d(x, y) = d(x) + d(y) - 2 |both differences|, and a
    link allows d(x, y) <= k, so x and y must share t = (d(x) + d(y) - k) / 2 or more
    of the shingles in which they differ from the pivot; as y is outer, that is
    over half of d(x).  In one order, the rarest first, the first d(x) - t + 1 of x
    and d(y) - t + 1 of y then have one in common.  What copies changed, each in its
    own way, is rare, so they meet few others, however many share the pivot.
    """
    c = f"{den - num} / {den + num}D"
    pairs = shelf.put(_apart(sized, few))
    grown = pairs.join(pairs.groupBy("p").agg(F.count("*").alias("g")), "p")
    named = pairs.join(grown.groupBy("id").agg(F.expr("max_by(p, struct(g, p))").alias("main")), "id")
    mixed = named.groupBy("p").agg(F.min("main").alias("lo"), F.max("main").alias("hi"))
    pairs = shelf.put(named.join(mixed, "p").where("id <> p AND (p = main OR lo < hi)").select("id", "p"))
    diffs = shelf.put(_differences(pairs, sets, num, den))
    links = diffs.where("NOT outer").selectExpr("least(id, p) AS a", "greatest(id, p) AS b")
    live = diffs.join(diffs.where("outer").select("p").distinct(), "p", "left_semi").where("d > 0")
    each = live.selectExpr("p", "id", "n", "d", f"d - CAST(floor((d + {c} * (pn - n)) / 2 - 1e-9) AS INT) AS short", "outer",
                           f"CAST(floor((d + {c} * (pn + n)) / 2 + 1e-9) AS INT) + 1 AS long", "explode(diff) AS s")
    each = shelf.put(each)
    freq = each.groupBy("p", "s").agg(F.count("*").alias("f")).where("f > 1")
    by = Window.partitionBy("p", "id").orderBy("f", "s")
    # a shingle of one set alone meets nothing, but takes its place before the others
    ranks = each.join(freq, ["p", "s"], "left").withColumn("f", F.coalesce("f", F.lit(1))).withColumn("r", F.row_number().over(by) - 1)
    ranks = ranks.where("f > 1 AND (r < short OR outer AND r < long)").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    ranks = shelf.put(ranks.select("p", "s", "id", "n", "d", "r", "short", "long", "outer", "component"))
    x = ranks.where("r < short").selectExpr("p", "s", "id AS a", "n AS an", "d AS ad", "r AS ar", "component AS ac")
    y = ranks.where("outer AND r < long").selectExpr("p", "s", "id AS b", "n AS bn", "d AS bd", "r AS br", "component AS bc")
    t = f"ceil((ad + bd - {c} * (an + bn)) / 2 - 1e-9)"
    met = x.join(y, ["p", "s"]).where(f"ac <> bc AND ar <= ad - {t} AND br <= bd - {t}")
    return links, met.selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct()


def near_groups(df: DataFrame, size: int = 5, percent: int = 80, few: int = 16) -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles, component_id and kept of each document of ``df``.

    Of each component the text of its smallest doc_id stays, the least mark if it
    has several; texts without links all stay.
    """
    num, den = percent, 100
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shelf, buckets, seed = Shelf(df.sparkSession, "jaccard"), n_buckets(docs), 0
    while True:  # again with other hashes should two sets share a key
        keys = shelf.put(_keys(docs, size, seed))
        nodes = shelf.put(keys.where("k1 IS NOT NULL").groupBy("k1").agg(F.min("doc_id").alias("first"), F.expr("min(struct(doc_id, mark)).mark").alias("mark"), F.min("k2").alias("lo"), F.max("k2").alias("hi")))
        if nodes.where("lo <> hi").isEmpty():
            break
        shelf.drop(keys, nodes)
        seed += 1
    members = shelf.put(_shared(docs, size, seed, num, den, buckets))
    release(df.sparkSession)
    members = shelf.put(_needful(members, shelf))
    wanted = members.select(F.col("id").alias("k1")).distinct().join(nodes, "k1").selectExpr("first AS doc_id", "k1 AS id")
    wanted = wanted.join(keys.select("doc_id", F.col("k1").alias("id")), ["doc_id", "id"], "left_semi")
    sets = shelf.put(_hashes(docs.join(wanted, "doc_id"), size, seed).dropDuplicates(["id"]))

    release(df.sparkSession)

    links = shelf.put(_links(_quick(members), sets, num, den))
    joined = components(links, shelf)
    rows = shelf.put(_open(members, joined))
    shelf.drop(members, links)
    if not rows.isEmpty():
        sized = shelf.put(_sized(rows))
        near, pairs = _large(sized, joined, few, sets, shelf, num, den)
        pairs = shelf.put(_small(sized, joined, few, num, den).unionAll(pairs).distinct())
        found = _links(pairs, sets, num, den).unionAll(near).unionAll(joined.selectExpr("component AS a", "id AS b"))
        joined = components(found, shelf)
    release(df.sparkSession)
    nodes = shelf.put(nodes.join(joined.withColumnRenamed("id", "k1"), "k1", "left").selectExpr("k1", "first", "mark", "coalesce(component, k1) AS component"))
    least = nodes.groupBy("component").agg(F.min(F.struct("first", "mark")).alias("least"))
    ends = shelf.put(nodes.join(least, "component").selectExpr("k1", "least.first AS component_id", "least.mark AS stays"))
    shelf.keep(keys, ends)
    out = keys.join(ends, "k1", "left")
    kept = "k1 IS NULL OR doc_id = component_id AND mark = stays AS kept"
    return out.selectExpr("doc_id", "mark", "n_shingles", "coalesce(component_id, doc_id) AS component_id", kept)


def near_duplicates(df: DataFrame, **how) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of each document of ``df``."""
    return near_groups(df, **how).select("doc_id", "n_shingles", "component_id")
