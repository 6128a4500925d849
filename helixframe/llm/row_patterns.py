"""Row pattern matching: ``A (D|U)*? P`` over each client's rows in order of time.

Rows are dealt by ranges of (client, time, id), so a huge client lies in several
partitions, and each partition is cut into chunks of at most ``chunk`` rows.  What
chunks must know of each other goes through two scans over a tree of chunks (``fan``
children a node), never through one task:

1. Each chunk is summarised by its first and last row, whether its rows carry a
   match on, and the largest goal (P) that a match from before could reach in it.
   These summaries are associative.  The scan gives each chunk the row before it and
   the largest goal that can be reached after it, so a start knows whether it will
   be matched beyond its chunk, before anybody knows where.
2. The search crosses a chunk's end in one of two states: fresh, or with a start in
   flight that needs a goal of at least ``x``.  A chunk maps states to states: a
   fresh search by its own chain of matches; one in flight by a staircase, whose
   steps are the rising goals at the chunk's head: the first that reaches ``x`` ends
   the match, and the chain resumes behind it.  Beyond the last step the state
   passes through.  These staircases compose, equal steps beside each other become
   one.  The scan gives each chunk the state in which the search enters it, and how
   many matches its client has begun before.

Then each chunk writes its own matches, and pieces of those that cross its ends;
pieces are read in order, each match for itself, by a streaming task.

A composed staircase has a step for each rising goal (distinct cents) that one
unbroken chain of rows offers, so it is bounded by the range of prices, not by rows.

Defined cases: rows without a client or time are left out; rows equal in all of the
columns of clicks count once; rows of one client, time and id with other contents
stand in order of cents (null first), kind and a hash of the row; a value that is
null, not a number or beyond 9e16 fits no letter; a null ``click_id`` comes first
among rows of one time and is kept as null; an empty table gives none; extra columns
are left out, so rows that differ in these alone count once.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf, lean, n_buckets, pack, unpack

_COLUMNS = ("click_id", "ts", "arrived_at", "client_id", "kind", "value", "props")
_ROW = (np.int64, np.int64, np.int64, np.int64, np.uint8)
#: Bits of a row's code: it has cents; its kind may stand between; it is a purchase; its id is null.
_VALUE, _BETWEEN, _GOAL, _NO_ID = 1, 2, 4, 8
_FRESH = -(1 << 63)


# ---------------------------------------------------------------- rows of one chunk


@dataclass
class Rows:
    """A chunk's rows in order: client, time in microseconds, id, cents and code."""

    client: np.ndarray
    ts: np.ndarray
    click: np.ndarray
    cents: np.ndarray
    code: np.ndarray

    def judged(self, before: tuple | None, gap: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether each row can stand between (D or U), and whether it can end a match (P), given the row before the chunk."""
        b = before or (self.client[0], self.ts[0] - gap - 1, 0, 0)
        prior = [np.r_[np.int64(b[k]), a[:-1]] for k, a in enumerate((self.client, self.ts, self.cents, self.code))]
        near = (self.client == prior[0]) & (self.ts - prior[1] <= gap) & (self.code & _VALUE > 0)
        between = near & (self.code & _BETWEEN > 0) & (prior[3] & _VALUE > 0) & (self.cents != prior[2])
        return between, near & (self.code & _GOAL > 0)


def _row(r: Rows, i: int) -> tuple[int, int, int, int]:
    return int(r.client[i]), int(r.ts[i]), int(r.cents[i]), int(r.code[i])


def _ends(r: Rows, between: np.ndarray, goal: np.ndarray, first: int, after: int | None) -> tuple[list[int], list[int]]:
    """Starts from ``first`` on that have a match, and where it ends: the row, or the number of rows if that lies beyond.

    From the last row back, ``keys`` holds the goals in reach, the nearest on top,
    less those that a nearer one outbids; so the first that suffices is found by bisection.
    """
    n, cents, code = len(r.client), r.cents.tolist(), r.code.tolist()
    keys, places = ([-after], [n]) if after is not None else ([], [])
    mid, end = between.tolist(), goal.tolist()
    starts, ends = [], []
    for i in range(n - 1, first - 1, -1):
        if keys and code[i] & _VALUE and (k := bisect_right(keys, -cents[i])):
            starts.append(i)
            ends.append(places[k - 1])
        if not mid[i]:
            keys, places = [], []
        if end[i]:
            key = -cents[i]
            while keys and keys[-1] >= key:
                keys.pop()
                places.pop()
            keys.append(key)
            places.append(i)
    return starts[::-1], ends[::-1]


def _stairs(r: Rows, between: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Rows at the chunk's head that end a match from before it, in order: each goal exceeds those before it."""
    stop = np.flatnonzero(~between)
    at = np.flatnonzero(goal[: stop[0] + 1 if len(stop) else len(goal)])
    top = np.maximum.accumulate(r.cents[at])
    return at[np.r_[True, top[1:] > top[:-1]]] if len(at) else at


# ---------------------------------------------------------------- the first scan: heads


@dataclass
class Head:
    """Summary of consecutive rows: ends, whether all but the first carry a match on, and the largest goal in reach behind the first."""

    first: tuple
    last: tuple
    solid: bool
    lead: int | None

    def joined(self, before: tuple | None, gap: int) -> tuple[bool, int | None]:
        """Whether its first row carries a match on from ``before``, and its cents if it ends one."""
        if before is None or before[0] != self.first[0] or self.first[1] - before[1] > gap or not self.first[3] & _VALUE:
            return False, None
        between = bool(self.first[3] & _BETWEEN and before[3] & _VALUE and self.first[2] != before[2])
        return between, self.first[2] if self.first[3] & _GOAL else None

    def reach(self, before: tuple | None, after: int | None, gap: int) -> int | None:
        """The largest goal that a match from before reaches in it or, by ``after``, beyond it."""
        on, best = self.joined(before, gap)
        return _most(best, *((self.lead, after if self.solid else None) if on else ()))

    def then(self, right: Head, gap: int) -> Head:
        on, _ = right.joined(self.last, gap)
        ahead = right.reach(self.last, None, gap) if self.solid else None
        return Head(self.first, right.last, self.solid and on and right.solid, _most(self.lead, ahead))


def _most(*values: int | None) -> int | None:
    return max((v for v in values if v is not None), default=None)


def _head(r: Rows, gap: int) -> Head:
    between, goal = r.judged(None, gap)
    stop = np.flatnonzero(~between[1:])
    reach = np.flatnonzero(goal[1 : stop[0] + 2 if len(stop) else None]) + 1
    return Head(_row(r, 0), _row(r, -1), not len(stop), int(r.cents[reach].max()) if len(reach) else None)


# ---------------------------------------------------------------- the second scan: staircases


@dataclass
class Stairs:
    """States to states.  Step 0 is for a fresh search; step k is for a start in flight that needs at most ``upto[k]``.

    ``need`` and ``origin`` are the state that a step leads to (need _FRESH: none in
    flight), ``begun`` the matches begun on the way.  ``open``: what needs more
    passes through.  ``anew``: its last client begins in it, so ``begun`` is that client's number.
    """

    upto: np.ndarray
    need: np.ndarray
    origin: np.ndarray
    begun: np.ndarray
    open: bool
    anew: bool

    def apply(self, need: np.ndarray, origin: np.ndarray, begun: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = np.where(need == _FRESH, 0, 1 + np.searchsorted(self.upto[1:], need))
        passes = k == len(self.upto)
        k = np.where(passes, 0, k)
        came = np.where(passes, 0, self.begun[k]) + np.where(self.anew, 0, begun)
        return np.where(passes, need, self.need[k]), np.where(passes, origin, self.origin[k]), came

    def then(self, right: Stairs) -> Stairs:
        need, origin, begun = right.apply(self.need, self.origin, self.begun)
        upto = self.upto
        if self.open:
            more = slice(1 + int(np.searchsorted(right.upto[1:], upto[-1], "right")), None)
            upto, need, origin, begun = (np.r_[a, b[more]] for a, b in ((upto, right.upto), (need, right.need), (origin, right.origin), (begun, right.begun)))
        same = (need[1:-1] == need[2:]) & (origin[1:-1] == origin[2:]) & (begun[1:-1] == begun[2:])
        keep = np.r_[True, ~same, True][: len(upto)]
        return Stairs(upto[keep], need[keep], origin[keep], begun[keep], self.open and right.open, self.anew or right.anew)

    def blob(self) -> bytes:
        return pack(self.upto, self.need, self.origin, self.begun)


def _chunk_stairs(r: Rows, at: int, before: tuple | None, after: int | None, gap: int) -> Stairs:
    """A chunk's staircase; only its last client's rows decide in which state the search leaves it."""
    between, goal = r.judged(before, gap)
    s = int(np.searchsorted(r.client, r.client[-1]))
    anew = s > 0 or before is None or before[0] != r.client[0]
    starts, ends = _ends(r, between, goal, s, after)
    need, begun = np.empty(len(starts) + 1, np.int64), np.zeros(len(starts) + 1, np.int64)
    need[-1] = _FRESH
    for t in range(len(starts) - 1, -1, -1):  # from each start: the state at the end, and how many matches begin
        beyond = ends[t] == len(r.client)
        on = len(starts) if beyond else bisect_left(starts, ends[t] + 1)
        need[t], begun[t] = r.cents[starts[t]] if beyond else need[on], 1 + begun[on]
    if s:
        steps, rows = np.array([s]), np.array([(1 << 63) - 1])  # whatever is in flight ends before the last client
    else:
        found = _stairs(r, between, goal)
        steps, rows = found + 1, r.cents[found]
    k = np.searchsorted(np.array(starts, np.int64), np.r_[s, steps])
    return Stairs(np.r_[_FRESH, rows], need[k], np.where(need[k] == _FRESH, 0, at), begun[k], s == 0 and bool(between.all()), anew)


# ---------------------------------------------------------------- scans over the tree


def tree_scan(table: DataFrame, shifts: list[int], read: Callable, write: Callable, fold: Callable, unfold: Callable, root: tuple, state: str, shelf: Shelf) -> DataFrame:
    """``at`` and its incoming state for each row of ``table`` (at, summary), by a tree over ``at``.

    A node at one level stands for those of the level below that agree above
    ``shift`` bits.  Upwards, ``fold`` reduces a node's children (in order) to one
    summary; downwards, ``unfold`` hands each child its state from the parent's.
    ``read`` and ``write`` turn a row of summary columns into a summary and back.
    """
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    shape = pa.schema([(f.name, {"bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in table.schema])
    kinds = pa.schema([("at", pa.int64()), *((c.split()[0], pa.bool_() if "boolean" in c else pa.int64()) for c in state.split(", "))])
    columns, fields = table.columns[1:], kinds.names[1:]

    def ordered(part: pa.Table) -> tuple[list[int], list]:
        part = part.sort_by("at")
        return part["at"].to_pylist(), [read(x) for x in zip(*(part[c].to_pylist() for c in columns), strict=True)]

    def up(shift: int):
        def reduce(part: pa.Table) -> pa.Table:
            at, summaries = ordered(part)
            row = (at[0] >> shift, *write(fold(summaries)))
            return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(row, shape, strict=True)], schema=shape)

        return reduce

    def hand(part: pa.Table, came: tuple) -> pa.Table:
        at, summaries = ordered(part)
        rows = list(zip(*unfold(summaries, came), strict=True))
        return pa.Table.from_arrays([pa.array(at, pa.int64()), *(pa.array(c, f.type) for c, f in zip(rows, list(kinds)[1:], strict=True))], schema=kinds)

    def down(part: pa.Table, parent: pa.Table) -> pa.Table:
        return hand(part, tuple(parent[c][0].as_py() for c in fields)) if part.num_rows else kinds.empty_table()

    levels = [table]
    for shift in shifts[:-1]:
        above = F.shiftright("at", shift)
        levels.append(shelf.put(levels[-1].groupBy(above).applyInArrow(up(shift), ddl)))
    came = levels[-1].groupBy(F.shiftright("at", shifts[-1])).applyInArrow(lambda part: hand(part, root), f"at long, {state}")
    for level, shift in zip(levels[-2::-1], shifts[-2::-1], strict=True):
        came = level.groupBy(F.shiftright("at", shift)).cogroup(came.groupBy("at")).applyInArrow(down, f"at long, {state}")
    return shelf.put(came)


_SUB, _FAN = 20, 6


def _shifts(top: int) -> list[int]:
    """Bits per level: a partition's chunks first, then 64 nodes at a time, until one is left."""
    shifts = [_SUB]
    while top >> sum(shifts):
        shifts.append(_FAN)
    return shifts


# ---------------------------------------------------------------- the operator


def _sorted_chunks(clicks: DataFrame, chunk: int, gap: int, parts: int | None) -> DataFrame:
    """at, blob and head of each chunk of the distinct rows, in order of client, time and id."""
    rows = clicks.select(*_COLUMNS).where("client_id IS NOT NULL AND ts IS NOT NULL")
    kind = F.col("kind").cast("string")
    cents = F.expr("IF(isnan(value) OR abs(value) > 9e16D, NULL, floor(100D * value + 0.5D))").cast("long")
    code = F.when(cents.isNotNull(), _VALUE).otherwise(0) + F.when(kind != "error", _BETWEEN).otherwise(0) + F.when(kind == "purchase", _GOAL).otherwise(0)
    code = code + F.when(F.col("click_id").isNull(), _NO_ID).otherwise(0)
    rows = rows.select(F.col("client_id").cast("long").alias("client_id"), "ts", F.col("click_id").cast("long").alias("click_id"), cents.alias("cents"), code.cast("tinyint").alias("code"), F.xxhash64(*_COLUMNS).alias("h1"), F.xxhash64(F.lit(1), *_COLUMNS).alias("h2"))
    order = ["client_id", "ts", "click_id"]
    dealt = rows.distinct().repartitionByRange(parts or n_buckets(clicks, 8 << 20), *order).sortWithinPartitions(*order, "cents", "code", "h1", "h2")
    schema = pa.schema([("at", pa.int64()), ("blob", pa.binary()), *((c, pa.int64()) for c in _HEAD[:8]), ("solid", pa.bool_()), ("lead", pa.int64())])

    def cut(n: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        numbers = (t[c].cast(pa.int64()).fill_null(0).to_numpy() for c in (*order, "cents"))
        r = Rows(*numbers, t["code"].to_numpy().astype(np.uint8))
        row = ((TaskContext.get().partitionId() << _SUB) + n, pack(r.client, r.ts, r.click, r.cents, r.code), *_head_row(_head(r, gap)))
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    @lean
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, have, n = [], 0, 0
        for batch in batches:
            while batch.num_rows:
                took = batch.slice(0, chunk - have)
                held, have, batch = [*held, took], have + took.num_rows, batch.slice(took.num_rows)
                if have == chunk:
                    yield cut(n, held)
                    held, have, n = [], 0, n + 1
        if have:
            yield cut(n, held)

    ddl = ", ".join(["at long, blob binary", *(f"{c} long" for c in _HEAD[:8]), "solid boolean, lead long"])
    return dealt.select(*order, "cents", "code").mapInArrow(chunks, ddl)


_HEAD = [f"{end}_{c}" for end in ("first", "last") for c in ("client", "ts", "cents", "code")] + ["solid", "lead"]


def _head_row(h: Head) -> tuple:
    return (*h.first, *h.last, h.solid, h.lead)


def _read_head(x: tuple) -> Head:
    return Head(tuple(x[:4]), tuple(x[4:8]), x[8], x[9])


_BEFORE = ["before_client", "before_ts", "before_cents", "before_code", "after"]


def _neighbours(chunks: DataFrame, shifts: list[int], gap: int, shelf: Shelf) -> DataFrame:
    """at, the row before each chunk, and the largest goal in reach after it."""

    def fold(heads: list[Head]) -> Head:
        whole = heads[0]
        for h in heads[1:]:
            whole = whole.then(h, gap)
        return whole

    def unfold(heads: list[Head], came: tuple) -> list[tuple]:
        before = [came[:4] if came[0] is not None else None, *(h.last for h in heads[:-1])]
        after, out = came[4], []
        for h, b in zip(heads[::-1], before[::-1], strict=True):
            out.append((*(b or (None,) * 4), after))
            after = h.reach(b, after, gap)
        return out[::-1]

    state = ", ".join(f"{c} long" for c in _BEFORE)
    return tree_scan(chunks.select("at", *_HEAD), shifts, _read_head, _head_row, fold, unfold, (None,) * 5, state, shelf)


_STATE = ["need", "origin", "begun"]


def _states(stairs: DataFrame, shifts: list[int], shelf: Shelf) -> DataFrame:
    """at, and the state in which the search enters each chunk."""

    def read(x: tuple) -> Stairs:
        return Stairs(*unpack(x[0], *(np.int64,) * 4), x[1], x[2])

    def write(s: Stairs) -> tuple:
        return s.blob(), s.open, s.anew

    def fold(each: list[Stairs]) -> Stairs:
        whole = each[0]
        for s in each[1:]:
            whole = whole.then(s)
        return whole

    def unfold(each: list[Stairs], came: tuple) -> list[tuple]:
        state, out = tuple(np.array([x], np.int64) for x in came), []
        for s in each:
            out.append(tuple(int(x[0]) for x in state))
            state = s.apply(*state)
        return out

    return tree_scan(stairs, shifts, read, write, fold, unfold, (_FRESH, 0, 0), ", ".join(f"{c} long" for c in _STATE), shelf)


def _pieces(r: Rows, at: int, before: tuple | None, after: int | None, state: tuple, gap: int) -> Iterator[tuple]:
    """A chunk's matches, and its pieces of those that cross its ends: client, number, first and last id, rows, cents, labels, origin."""
    need, origin, begun = state
    between, goal = r.judged(before, gap)
    n, clients = len(r.client), r.client.tolist()
    prior = np.r_[np.int64(before[2] if before else 0), r.cents[:-1]]
    labels = np.where(r.cents < prior, b"D", b"U").astype("S1").tobytes().decode()
    sums = np.r_[0, np.cumsum(np.where(r.code & _VALUE, r.cents, 0))].tolist()
    ids = [None if c & _NO_ID else i for i, c in zip(r.click.tolist(), r.code.tolist(), strict=True)]
    starts, ends = _ends(r, between, goal, 0, after)
    i, client = 0, before[0] if before else None
    if need != _FRESH:
        found = _stairs(r, between, goal)
        k = int(np.searchsorted(r.cents[found], need))
        if k == len(found):
            yield clients[0], None, None, None, n, sums[n], labels, origin
            return
        i = int(found[k]) + 1
        yield clients[0], None, None, ids[i - 1], i, sums[i], labels[: i - 1] + "P", origin
    t = bisect_left(starts, i)
    while t < len(starts):
        i, j = starts[t], ends[t]
        begun, client = begun + 1 if clients[i] == client else 1, clients[i]
        if j == n:
            yield client, begun, ids[i], None, n - i, sums[n] - sums[i], "A" + labels[i + 1 :], at
            return
        yield client, begun, ids[i], ids[j], j + 1 - i, sums[j + 1] - sums[i], "A" + labels[i + 1 : j] + "P", None
        t = bisect_left(starts, j + 1, t)


_PIECE = pa.schema([("client_id", pa.int64()), ("match_no", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_rows", pa.int64()), ("sum_cents", pa.int64()), ("labels", pa.string()), ("origin", pa.int64()), ("at", pa.int64())])
_PIECE_DDL = "client_id long, match_no long, first_id long, last_id long, n_rows long, sum_cents long, labels string, origin long, at long"


def match_pieces(clicks: DataFrame, gap_seconds: int = 600, chunk: int = 1 << 16, parts: int | None = None) -> DataFrame:
    """The matches in ``clicks`` with their labels, in pieces.

    client_id, match_no, first_id, last_id, n_rows, sum_cents, labels, origin and at.
    A match within a chunk is one row without ``origin``.  Others are a row a
    chunk: pieces of one ``origin`` in order of ``at``; the first has client_id,
    match_no and first_id, the last has last_id.
    """
    shelf, gap = Shelf(clicks.sparkSession, "patterns"), gap_seconds * 1_000_000
    chunks = shelf.put(_sorted_chunks(clicks, chunk, gap, parts))
    top = chunks.agg(F.max("at")).first()[0] or 0
    shifts = _shifts(top)
    known = _neighbours(chunks, shifts, gap, shelf)
    blobs = chunks.select("at", "blob").join(known, "at")

    def each(batches: Iterator[pa.RecordBatch], f: Callable, state: list[str]) -> Iterator[tuple]:
        for batch in batches:
            for at, blob, *b, after, come in zip(*(batch[c].to_pylist() for c in ("at", "blob", *_BEFORE)), list(zip(*(batch[c].to_pylist() for c in state), strict=True)) or [()] * batch.num_rows, strict=True):
                yield at, f(Rows(*unpack(blob, *_ROW)), at, None if b[0] is None else tuple(b), after, *([come] if state else []), gap)

    @lean
    def stairs(batches):
        for at, s in each(batches, _chunk_stairs, []):
            yield pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int64()), "stairs": pa.array([s.blob()], pa.binary()), "open": [s.open], "anew": [s.anew]})

    @lean
    def pieces(batches):
        for at, found in each(batches, _pieces, _STATE):
            rows = [(*x, at) for x in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECE, strict=True)], schema=_PIECE)

    states = _states(shelf.put(blobs.mapInArrow(stairs, "at long, stairs binary, open boolean, anew boolean")), shifts, shelf)
    return shelf.put(blobs.join(states, "at").mapInArrow(pieces, _PIECE_DDL))


def row_matches(clicks: DataFrame, gap_seconds: int = 600, chunk: int = 1 << 16, parts: int | None = None) -> DataFrame:
    """client_id, match_no, first_id, last_id, n_rows, sum_cents and labels_sha256 of each match in ``clicks``."""
    import hashlib

    pieces = match_pieces(clicks, gap_seconds, chunk, parts)
    names = _PIECE.names[:6]
    schema = pa.schema([*list(_PIECE)[:6], ("labels_sha256", pa.string())])

    @lean
    def digests(batches):
        """Rows come by origin, in order: a match is held as six numbers and a hasher, however long it is."""
        last, match, sha = None, [], None
        for batch in batches:
            rows = []
            for *row, labels, origin in zip(*(batch[c].to_pylist() for c in (*names, "labels", "origin")), strict=True):
                if origin != last:
                    if match:
                        rows.append((*match, sha.hexdigest()))
                    last, match, sha = origin, row, hashlib.sha256(labels.encode())
                else:
                    match[3], match[4], match[5] = row[3], match[4] + row[4], match[5] + row[5]
                    sha.update(labels.encode())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        if match:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*match, sha.hexdigest()), schema, strict=True)], schema=schema)

    whole = pieces.where("origin IS NULL").select(*names, F.sha2(F.col("labels").cast("binary"), 256).alias("labels_sha256"))
    crossing = pieces.where("origin IS NOT NULL").repartition("origin").sortWithinPartitions("origin", "at")
    return whole.unionAll(crossing.mapInArrow(digests, ", ".join([*(f"{c} long" for c in names), "labels_sha256 string"])))
