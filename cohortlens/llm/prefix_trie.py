"""Conversation prefix trie (operator 12).

A node is a sequence of first turns that one conversation or several begin with; the root is the empty sequence.
A node's key is a digest of its turns, made turn by turn from the key of its parent, so rows of different
conversations that lie on one node meet by key, and each node knows its parent's key. Leaf counts and savings are
summed over subtrees by pointer jumping: after round k a node's sums cover what lies less than 2^k below it and its
pointer names its ancestor 2^k above, so each round adds sums by pointer and joins pointers with pointers. The number
of rounds is the logarithm of the greatest depth.

No conversation is held or even sorted as a whole: turns are ranged over tasks by conversation and turn, positions
are counted within a task and those of the few conversations that run over a border are shifted by a broadcast of
one row for each border. Keys are chained within blocks of BLOCK turns, and the blocks' own keys by the same function.
Members of a node that end there are written as sorted text in pieces, and only the digest itself reads these in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import discard, materialise, read

#: Fixed by the contract: conversations of a family begin with turns of its first one, up to MOST - 1 of them.
FAMILY, MOST = 5, 9
#: Turns of a conversation that are chained in one task, and bytes of a piece of member ids.
BLOCK, PIECE = 1024, 1 << 16
ROOT = b""

_NUMBERED = "conv_id bigint, key binary, n_bytes bigint, task int, at bigint"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The position of each row among its conversation's rows in this task; rows come sorted by conversation."""
    task, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not len(batch):
            continue
        conv = batch.column(0).to_numpy(zero_copy_only=False)
        start = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
        before = np.zeros(len(start), np.int64)
        before[0] = seen if conv[0] == last else 0
        runs = np.diff(np.r_[start, len(conv)])
        at = np.arange(1, len(conv) + 1) - np.repeat(start - before, runs)
        last, seen = conv[-1], int(at[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(conv), task, np.int32)), pa.array(at)], names=["conv_id", "key", "n_bytes", "task", "at"])


def number_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, key (a digest of role and text), n_bytes of the text and pos, from 1, for each turn."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("_turn"), role.alias("_role"), F.sha2(text, 256).alias("_text"), F.octet_length(text).cast("long").alias("n_bytes")
    )
    order = ("conv_id", "_turn", "_role", "_text")
    ranged = rows.repartitionByRange(int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    key = F.unhex(F.sha2(F.concat(F.octet_length("_role").cast("string"), F.lit(":"), "_role", "_text"), 256))
    turns = materialise(ranged.select("conv_id", key.alias("key"), "n_bytes").mapInArrow(_numbered, _NUMBERED), "turns")
    each = turns.groupBy("conv_id", "task").agg(F.count("*").alias("n"))
    border = each.withColumns(
        {"shift": F.sum("n").over(Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))}
    ).where("shift is not null").select("conv_id", "task", "shift")  # a row for each border between tasks at most
    out = turns.join(F.broadcast(border), ["conv_id", "task"], "left")
    return out.select("conv_id", "key", "n_bytes", (F.col("at") + F.coalesce("shift", F.lit(0))).alias("pos"))


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (conv_id, depth, key, n_bytes, ends: it is the last one), and the conversations (conv_id, length)."""
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("own")).select("conv_id", "own", base.alias("base"), (F.crc32(F.col("conv_id").cast("string")) % MOST).alias("h"))
    bases = lengths.where("conv_id = base").select("base", F.col("own").alias("base_own"))
    met = lengths.join(bases, "base", "left").withColumn("lent", F.least("h", F.coalesce("base_own", F.lit(0))))
    convs = materialise(met.select("conv_id", "base", "h", "lent", (F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "rebuilt")
    mine = turns.join(convs, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("lent")).alias("depth"), "key", "n_bytes", "length")
    head = turns.where((F.col("pos") < MOST) & (F.col("conv_id") == base)).select(F.col("conv_id").alias("base"), "pos", "key", "n_bytes")
    lent = head.join(convs, "base").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "key", "n_bytes", "length")
    rows = mine.unionByName(lent)
    return rows.select("conv_id", "depth", "key", "n_bytes", (F.col("depth") == F.col("length")).alias("ends")), convs.select("conv_id", "length")


_CHAINED = "conv_id bigint, block bigint, depth bigint, n_bytes bigint, ends boolean, node binary, parent binary"


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node: the digest of the keys up to this row within its block; parent: that of the row before it."""
    at, held = None, ROOT
    for batch in batches:
        nodes, parents = [], []
        for conv, block, key in zip(*(batch.column(c).to_pylist() for c in (0, 1, 5)), strict=True):
            if at != (conv, block):
                at, held = (conv, block), ROOT
            parents.append(held)
            held = hashlib.sha256(held + key).digest()
            nodes.append(held)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(5)), pa.array(nodes, pa.binary()), pa.array(parents, pa.binary())], names=["conv_id", "block", "depth", "n_bytes", "ends", "node", "parent"])


def _below(prefix: Column, inside: Column) -> Column:
    """The key of a row whose block comes after the blocks that prefix stands for."""
    return F.unhex(F.sha2(F.concat(prefix, inside), 256))


def prefix_keys(rows: DataFrame, longest: int, block: int = BLOCK) -> DataFrame:
    """node and parent, the keys of the first depth and of one turn less, for rows (conv_id, depth, key, n_bytes, ends)."""
    dealt = rows.withColumn("block", F.expr(f"(depth - 1) div {block}")).select("conv_id", "block", "depth", "n_bytes", "ends", "key").repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "depth")
    inside = dealt.mapInArrow(_chained, _CHAINED)
    if longest <= block:
        return inside.drop("block")
    inside = materialise(inside, "chained")
    full = inside.where(F.col("depth") % block == 0).select("conv_id", (F.col("block") + 1).alias("depth"), F.col("node").alias("key"), "n_bytes", F.lit(False).alias("ends"))
    above = prefix_keys(full, longest // block, block)
    # For the rows of the next block: what stands for all blocks before it, and the key of the row just before it.
    last = full.select("conv_id", F.col("depth").alias("block"), F.col("key").alias("last"))
    before = above.select("conv_id", F.col("depth").alias("block"), F.col("node").alias("prefix"), F.col("parent").alias("earlier")).join(last, ["conv_id", "block"])
    before = before.select("conv_id", "block", "prefix", F.when(F.length("earlier") == 0, F.col("last")).otherwise(_below(F.col("earlier"), F.col("last"))).alias("just"))
    later = inside.where("block > 0").join(before, ["conv_id", "block"])
    parent = F.when(F.length("parent") == 0, F.col("just")).otherwise(_below(F.col("prefix"), F.col("parent")))
    return inside.where("block = 0").drop("block").unionByName(later.select("conv_id", "depth", "n_bytes", "ends", _below(F.col("prefix"), F.col("node")).alias("node"), parent.alias("parent")))


def _pieces(piece: int):
    """Consecutive ids of a node joined by commas, in pieces of about piece bytes; rows come sorted by node and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, held, size = None, 0, [], 0
        for batch in batches:
            done = []
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != node or size >= piece:
                    if held:
                        done.append((node, first, ",".join(held)))
                    node, first, held, size = key, conv, [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
            yield _rows(done, ("node", "first", "ids"))
        yield _rows([(node, first, ",".join(held))] if held else [], ("node", "first", "ids"))

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's pieces, which come in order."""
    node, state = None, None
    for batch in batches:
        done = []
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if key != node:
                if state is not None:
                    done.append((node, state.hexdigest()))
                node, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _rows(done, ("node", "ends_sha256"))
    yield _rows([(node, state.hexdigest())] if state is not None else [], ("node", "ends_sha256"))


_ARROW = {"node": pa.binary(), "first": pa.int64(), "ids": pa.string(), "ends_sha256": pa.string()}


def _rows(rows: list[tuple], names: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _ARROW[n]) for i, n in enumerate(names)], names=list(names))


def id_digests(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """node and ends_sha256 for ends (node, conv_id): of each node's ids, ascending and joined by commas."""
    spark = ends.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = ends.repartitionByRange(tasks, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_pieces(piece), "node binary, first bigint, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_hashed, "node binary, ends_sha256 string")


def roll_up(nodes: DataFrame, deepest: int, root_conv: int) -> DataFrame:
    """nodes with n_leaves and saved_tokens summed over their subtrees, and parent_conv_id, by pointer jumping.

    nodes has node, parent (null: the root's), depth, conv_id, n_convs, n_children and n_bytes. A pointer is met by
    a join whose sides are both dealt by key, so that a node that many point to can be split.
    """
    state = materialise(
        nodes.select(
            "node", "depth", "conv_id", "n_convs", "n_children", F.col("parent").alias("up"),
            F.when(F.col("depth") == 1, F.lit(root_conv)).cast("long").alias("parent_conv_id"),
            F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"),
        ), "trie",
    )
    reach = 1
    while reach <= deepest:
        gain = state.where("up is not null").groupBy("up").agg(F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved")).withColumnRenamed("up", "node")
        summed = state.join(gain, "node", "left").withColumns(
            {"n_leaves": F.col("n_leaves") + F.coalesce("_leaves", F.lit(0)), "saved_tokens": F.col("saved_tokens") + F.coalesce("_saved", F.lit(0))}
        ).drop("_leaves", "_saved")
        # Pointers of nodes less deep than 2 * reach pass the root; the others jump from their ancestor to its own.
        near = summed.where(F.col("depth") < 2 * reach).withColumn("up", F.lit(None).cast("binary"))
        hop = state.where(F.col("depth") >= reach).select(F.col("node").alias("up"), F.col("up").alias("_next"), F.col("conv_id").alias("_conv"))
        far = summed.where(F.col("depth") >= 2 * reach).join(hop, "up").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_conv")).withColumn("up", F.col("_next")).drop("_next", "_conv")
        old, state = state, materialise(near.unionByName(far), "trie")
        discard(old)
        reach *= 2
    return state.drop("up")


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conversations has conv_id, turn, role and text. Turns are ordered by turn (null first), then role, then the
    text's SHA-256; repeated rows are turns each. A null role or text is an empty one; very long texts are digested
    as a whole and not moved. Rows without a conv_id take no part. Without conversations there is no node, not
    even a root. Other columns are not read, whatever their names.
    """
    turns = number_turns(conversations)
    rows, convs = rebuild(turns)
    top = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.max("length").alias("longest")).first()
    schema = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
    if not top["n"]:
        return conversations.sparkSession.createDataFrame([], schema)
    keyed = materialise(prefix_keys(rows, top["longest"], block), "keyed")
    # All rows of a node have the same parent, depth and text, which are grouped by as sums of fixed size hold the rest.
    below = keyed.groupBy("node", "parent", "depth", "n_bytes").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).select(
        F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("n_bytes"), "n_convs", "conv_id"
    )
    every = materialise(below.unionByName(root), "nodes")
    children = every.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "node")
    nodes = every.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    summed = roll_up(nodes, top["longest"], top["conv_id"])
    ends = keyed.where("ends").select("node", "conv_id").unionByName(convs.where("length = 0").select(F.lit(ROOT).alias("node"), "conv_id"))
    out = summed.join(id_digests(ends), "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"))


#: By another road: nodes are lists of turns, and each node is joined with all nodes on its own path. CRC-32 is
#: reckoned bit by bit: after each byte eight shifts, which stand as -1 in the list.
SQL = rf"""
with turn as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(coalesce(text, ''))) as pos, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) as x
  from conversations where conv_id is not null),
own as (select conv_id, list(x order by pos) as xs from turn group by conv_id),
head as (
  select conv_id, xs, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(conv_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda acc, b: case when b >= 0 then xor(acc, b) when acc & 1 = 1 then xor(acc >> 1, 3988292384::bigint) else acc >> 1 end), 4294967295::bigint) % {MOST} as h from own),
conv as (select head.conv_id, list_concat(coalesce(own.xs, [])[:h], head.xs[h + 1:]) as xs from head left join own on own.conv_id = head.conv_id - head.conv_id % {FAMILY}),
step as (select conv_id, len(xs) as length, d, md5(xs[:d]::varchar || '#' || d) as node, case when d > 0 then md5(xs[:d - 1]::varchar || '#' || (d - 1)) end as parent, case when d = 0 then 0 else octet_length(encode(xs[d].t)) end as b
  from conv, range(0, len(xs) + 1) r(d)),
node as (
  select node, parent, d, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(b) as saved, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (length = d), '') as ends from step group by node, parent, d),
child as (select parent, count(*) as n from node where parent is not null group by parent),
full_node as (select node.*, coalesce(child.n, 0) as n_children from node left join child on child.parent = node.node),
total as (select p.node, sum(case when n.n_children = 0 then 1 else 0 end) as n_leaves, sum(n.saved) as saved from full_node n join step p on p.conv_id = n.conv_id and p.d <= n.d group by p.node)
select f.conv_id, f.d::bigint as depth, up.conv_id as parent_conv_id, f.n_convs::bigint as n_convs, f.n_children::bigint as n_children, total.n_leaves::bigint as n_leaves, total.saved::bigint as saved_tokens, sha256(f.ends) as ends_sha256
from full_node f join total on total.node = f.node left join node up on up.node = f.parent
"""
