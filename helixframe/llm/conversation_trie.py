"""Conversation prefix trie: shared prefixes of rebuilt conversations, summed by leaf peeling.

A conversation c is rebuilt from the first h turns of conversation c - c % 100 and
its own turns after its first h, where h = crc32(decimal c) % 6.  A node is a distinct
sequence of turns; it is known by its depth and two 64-bit sums (exclusive or) of
hashes of its turns, each with its place, role and the text's SHA-256.  Such sums are
running aggregates, so a conversation of any length is numbered, hashed and summed in
blocks of ``_BLOCK`` turns, with one row a block for what comes before.

A node belongs to its smallest member.  A conversation's nodes then form one run that
hangs from a node of a smaller conversation, so chains of only children need no
messages of their own.  Leaves are peeled off the tree of runs: a run holds a counter of
the runs that hang from it; runs whose counter is zero send their subtree's totals
(leaves, saved tokens) to the run they hang from, which adds them and counts down,
until only the root's run finishes.  Messages are summed for each receiver
before they are joined, so a hub is one row.  There are as many rounds as runs hang
from each other in a row, at most one more than the longest shared prefix.  At last
each node's totals are sums from the run's end upwards over what hangs from it.

The ids behind ``ends_sha256`` are joined to texts in blocks of ids; one
streaming task for each node feeds these to the hasher in order (SHA-256 can't be
divided), with only its state in memory.

Defined cases: null role and text are empty; turns are numbered in order of turn
(null first), then role, then the text's SHA-256, and repeated rows are turns of
their own; rows without a conv_id are left out; ``%`` of a negative id has its sign;
texts of any length are read whole; a conversation may have no turn when rebuilt, it
then ends at the root; an empty table gives no node; extra columns are left out.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shelf, lean

#: Turns, depths or ids that one window or list holds at most, but for turns of equal number.
_BLOCK = 4096
_NODE = ["depth", "x1", "x2"]


def _before(blocks: DataFrame, key: str, block: str, sums: dict[str, str], down: bool = False) -> DataFrame:
    """(key, block) and what ``sums`` (column: aggregate) give over all earlier blocks of the key (later ones with ``down``)."""
    over = Window.partitionBy(key).orderBy(F.col(block).desc() if down else F.col(block)).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(key, block, *(F.coalesce(F.expr(f"{f}({c})").over(over), F.lit(0)).alias(f"{c}_before") for c, f in sums.items()))


def _running(df: DataFrame, key: str, by: str, sums: dict[str, str], down: bool = False) -> DataFrame:
    """``df`` with columns run_<column>: aggregates over the key's rows up to each row in order of ``by`` (from the last one back with ``down``)."""
    df = df.withColumn("block", F.expr(f"{by} DIV {_BLOCK}"))
    blocks = df.groupBy(key, "block").agg(*(F.expr(f"{f}({c})").alias(c) for c, f in sums.items()))
    several = blocks.groupBy(key).agg(F.max("block").alias("_last")).where("_last > 0").select(key)
    before = _before(blocks.join(several, key, "left_semi"), key, "block", sums, down)
    over = Window.partitionBy(key, "block").orderBy(F.col(by).desc() if down else F.col(by)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.select("*", *(F.expr(f"{f}({c})").over(over).alias(f"run_{c}") for c, f in sums.items())).join(before, [key, "block"], "left")
    for c, f in sums.items():
        own, ahead = F.col(f"run_{c}"), F.coalesce(f"{c}_before", F.lit(0))
        df = df.withColumn(f"run_{c}", own.bitwiseXOR(ahead) if f == "bit_xor" else own + ahead).drop(f"{c}_before")
    return df.drop("block")


def _numbered(conversations: DataFrame, shelf: Shelf) -> tuple[DataFrame, DataFrame]:
    """Turns as (conv_id, pos, role, sha, chars), and (conv_id, n) of each conversation."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.sha2(text.cast("binary"), 256).alias("sha"), F.char_length(text).cast("long").alias("chars"),
    )
    turns = turns.withColumn("block", F.coalesce(F.expr(f"turn DIV {_BLOCK}"), F.lit(-(1 << 60))))
    order = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "sha")
    turns = shelf.put(turns.withColumn("r", F.row_number().over(order).cast("long")).drop("turn"))
    blocks = shelf.put(turns.groupBy("conv_id", "block").agg(F.count("*").alias("n")))
    before = _before(blocks, "conv_id", "block", {"n": "sum"}).where("n_before > 0")
    turns = turns.join(before, ["conv_id", "block"], "left").withColumn("pos", F.col("r") + F.coalesce("n_before", F.lit(0)))
    return turns.select("conv_id", "pos", "role", "sha", "chars"), blocks.groupBy("conv_id").agg(F.sum("n").alias("n"))


def shared_start(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its hundred."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 6


def rebuilt_turns(conversations: DataFrame, shelf: Shelf) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, e1, e2, chars, ends) of each rebuilt turn, and (conv_id, n) of each rebuilt conversation."""
    turns, sizes = _numbered(conversations, shelf)
    turns, sizes = shelf.put(turns), shelf.put(sizes)
    convs = sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), shared_start(F.col("conv_id")).alias("h"))
    convs = convs.join(sizes.selectExpr("conv_id AS base", "n AS base_n"), "base", "left")
    convs = convs.withColumn("start", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = shelf.put(convs.select("conv_id", "base", "h", "start", (F.col("start") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")))
    start = convs.where("start > 0").join(turns.where("pos <= 5").withColumnRenamed("conv_id", "base"), "base").where("pos <= h").withColumn("depth", F.col("pos"))
    own = convs.join(turns, "conv_id").where("pos > h").withColumn("depth", F.col("start") + F.col("pos") - F.col("h"))
    what = ["conv_id", "depth", "role", "sha", "chars", "n"]
    rows = start.select(*what).unionAll(own.select(*what))
    rows = rows.select("conv_id", "depth", F.xxhash64("depth", "role", "sha").alias("e1"), F.xxhash64(F.lit(1), "depth", "role", "sha").alias("e2"), "chars", (F.col("depth") == F.col("n")).alias("ends"))
    return rows, convs.select("conv_id", "n")


def _ends(members: DataFrame) -> DataFrame:
    """Node and ends_sha256 of the conversations (node, conv_id) that end at each node."""
    block = members.groupBy(*_NODE, F.expr(f"conv_id DIV {_BLOCK}").alias("block"), F.expr("conv_id < 0").alias("sign"))
    ids = block.agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    ids = ids.select(*_NODE, F.col("ids")[0].alias("first"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    schema = pa.schema([("depth", pa.int64()), ("x1", pa.int64()), ("x2", pa.int64()), ("ends_sha256", pa.string())])

    @lean
    def digests(batches):
        last, sha = None, None
        for batch in batches:
            rows = []
            for *node, ids in zip(*(batch[c].to_pylist() for c in (*_NODE, "ids")), strict=True):
                if node == last:
                    sha.update(b"," + ids.encode())
                    continue
                if last:
                    rows.append((*last, sha.hexdigest()))
                last, sha = node, hashlib.sha256(ids.encode())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*last, sha.hexdigest()), schema, strict=True)], schema=schema)

    return ids.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(digests, "depth long, x1 long, x2 long, ends_sha256 string")


def _peeled(runs: DataFrame, shelf: Shelf) -> DataFrame:
    """(run, parent, at, saved, leaves) with the totals of each run's subtree, from (run, parent, at, saved, leaves) of its own.

    A run that waits for none of its children any more sends its totals to its parent.
    """
    waits = runs.where("parent IS NOT NULL").groupBy(F.col("parent").alias("run")).agg(F.count("*").alias("waits"))
    state = shelf.put(runs.join(waits, "run", "left").na.fill(0, ["waits"]))
    finished = []
    while True:
        done = state.where("waits = 0").drop("waits")
        finished.append(done)
        rest = state.where("waits > 0")
        if rest.isEmpty():
            break
        sent = done.groupBy(F.col("parent").alias("run")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"), F.count("*").alias("k"))
        state = rest.join(sent, "run", "left").na.fill(0, ["s", "l", "k"])
        state = shelf.put(state.selectExpr("run", "parent", "at", "saved + s AS saved", "leaves + l AS leaves", "waits - k AS waits"))
    out = finished[0]
    for more in finished[1:]:
        out = out.unionAll(more)
    return out


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node of ``conversations`` (conv_id, turn, role, text)."""
    shelf = Shelf(conversations.sparkSession, "trie")
    rows, convs = rebuilt_turns(conversations, shelf)
    rows = shelf.put(_running(rows, "conv_id", "depth", {"e1": "bit_xor", "e2": "bit_xor"}).withColumnsRenamed({"run_e1": "x1", "run_e2": "x2"}))
    nodes = rows.groupBy(*_NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.min(F.col("x1").bitwiseXOR(F.col("e1"))).alias("p1"), F.min(F.col("x2").bitwiseXOR(F.col("e2"))).alias("p2"),
        F.count_if("ends").alias("n_ends"), F.min(F.when(F.col("ends"), F.col("conv_id"))).alias("end"),
    )
    none, long = F.lit(None).cast("long"), F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if(F.col("n") == 0).alias("n_ends"), F.min(F.when(F.col("n") == 0, F.col("conv_id"))).alias("end"))
    root = root.where("n_convs > 0").select(long.alias("depth"), long.alias("x1"), long.alias("x2"), "conv_id", "n_convs", long.alias("chars"), none.alias("p1"), none.alias("p2"), "n_ends", "end")
    nodes = shelf.put(nodes.unionByName(root))
    parent = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")]
    kids = nodes.where("depth > 0").groupBy(*parent).agg(F.count("*").alias("n_children"))
    above = nodes.selectExpr("depth + 1 AS depth", "x1 AS p1", "x2 AS p2", "conv_id AS parent_conv_id")
    nodes = nodes.join(kids, _NODE, "left").na.fill(0, ["n_children"]).join(above, ["depth", "p1", "p2"], "left")
    nodes = shelf.put(nodes.select(*_NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaves"), "n_ends", "end"))
    runs = nodes.groupBy(F.col("conv_id").alias("run")).agg(F.min(F.struct("depth", "parent_conv_id")).alias("top"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    totals = _peeled(runs.selectExpr("run", "top.parent_conv_id AS parent", "top.depth - 1 AS at", "saved", "leaves"), shelf)
    hung = totals.where("parent IS NOT NULL").groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
    nodes = nodes.join(hung, ["conv_id", "depth"], "left").na.fill(0, ["s", "l"]).withColumn("saved", F.expr("saved + s")).withColumn("leaves", F.expr("leaves + l")).drop("s", "l")
    nodes = shelf.put(_running(nodes, "conv_id", "depth", {"saved": "sum", "leaves": "sum"}, down=True))
    members = rows.where("ends").select(*_NODE, "conv_id").unionAll(convs.where("n = 0").select(long, long, long, "conv_id"))
    several = _ends(members.join(nodes.where("n_ends > 1").select(*_NODE), _NODE, "left_semi"))
    few = F.sha2(F.coalesce(F.col("end").cast("string"), F.lit("")).cast("binary"), 256)
    out = nodes.join(several, _NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", few))
    return out.selectExpr("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "run_leaves AS n_leaves", "run_saved AS saved_tokens", "ends_sha256")
