"""A trie of conversations: every shared beginning is a node, with what is saved by keeping it once.

A node belongs to its smallest member. A conversation that owns a node owns all nodes below it on its own path, so it owns
a suffix of its path, and a node is owned once. Over the rows (conversation, depth) of a node's members, what occurs at
this depth and below, less what the members own there, is what sharing saves in the whole subtree; members that own
a leaf count its leaves. Windows along each path give the running sums and mark the owned suffix; one group-by over
nodes adds the rows up.

Nodes are known by their depth and by sums, along the path, of the MD5 of (depth, turn) in four parts of 32 bits, so that
a very long conversation's sums can be taken in blocks. No step gathers a node's members or a conversation's turns: group-bys
combine before they shuffle, and lookups of keys that very many rows share go through `attach`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from shieldframe.llm.scratch import attach, stored

BLOCK_TURNS = 1024
IDS_A_ROW = 2048
#: The conversations of each hundred begin with up to five turns of the first of them.
FAMILY, MOST_HEAD = 100, 6
_SUMS = ("s0", "s1", "s2", "s3")


def _parts(hashed: Column) -> list[Column]:
    """The MD5 (hexadecimal) in four numbers of 32 bits."""
    return [F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("long").alias(s) for i, s in enumerate(_SUMS)]


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, turn_hash, tokens): the turns of each conversation with their places from 1, in order of turn (null first),
    then of their hash. The hash stands for role and text (null: empty); tokens are the text's code points.

    Rows are dealt by ranges of (conversation, turn), so a conversation of any length is spread; what a range has before
    it in its first conversation is added from counts.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    hashed = F.md5(F.concat(F.length(blank("role")).cast("string"), F.lit(":"), blank("role"), blank("text")).cast("binary"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), hashed.alias("turn_hash"), F.length(blank("text")).cast("long").alias("tokens"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first()]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order, "turn_hash")
    placed = stored(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "turns")
    counts = placed.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("conv_id", "part", (F.col("first") - before).alias("zero"))
    return placed.join(offsets, ["conv_id", "part"]).select("conv_id", (F.col("at") - F.col("zero") + 1).alias("place"), "turn_hash", "tokens")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations that the registered query looks at: each begins with the first h turns of its family's first
    conversation, h from the CRC-32 of its id, and goes on with its own after its first h. (conv_id, n_turns, tokens), and
    the turns (conv_id, depth, turn_hash, tokens)."""
    own = turns.groupBy("conv_id").agg(F.count("*").alias("own_turns"))
    convs = own.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_HEAD).alias("head"), "own_turns")
    firsts = own.select(F.col("conv_id").alias("family"), F.col("own_turns").alias("first_turns"))
    convs = stored(convs.join(firsts, "family", "left").withColumn("taken", F.least("head", F.coalesce("first_turns", F.lit(0)))).drop("first_turns"), "heads")
    heads = turns.where(F.col("place") < MOST_HEAD).withColumnRenamed("conv_id", "family")
    borrowed = convs.join(heads, "family").where("place <= taken").select("conv_id", F.col("place").alias("depth"), "turn_hash", "tokens")
    kept = attach(turns, convs.select("conv_id", "head", "taken"), "conv_id", F.col("place")).where("place > head").select("conv_id", (F.col("place") - F.col("head") + F.col("taken")).alias("depth"), "turn_hash", "tokens")
    every = borrowed.union(kept)
    sums = every.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sum("tokens").alias("tokens"))
    return convs.select("conv_id").join(sums, "conv_id", "left").na.fill(0, ["n_turns", "tokens"]), every


def paths(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """A row per conversation and node of its path: conv_id, depth (0 is the root), node, parent, tokens (of the last turn),
    above (tokens of the turns before it) and last (whether the conversation ends there). `convs` and `turns` as from `rebuilt`.

    Sums along a path are taken in blocks of `BLOCK_TURNS` turns, then over blocks.
    """
    own = turns.select("conv_id", "depth", "tokens", F.floor(F.col("depth") / BLOCK_TURNS).alias("block"), *_parts(F.md5(F.concat_ws(":", "depth", "turn_hash").cast("binary"))))
    summed = (*_SUMS, "tokens")
    totals = own.groupBy("conv_id", "block").agg(*(F.sum(s).alias(s) for s in summed))
    earlier = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("conv_id", "block", *(F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"b_{s}") for s in summed))
    along = W.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, W.currentRow)
    runs = own.select("conv_id", "block", "depth", "tokens", *_SUMS, *(F.sum(s).over(along).alias(f"r_{s}") for s in summed)).join(offsets, ["conv_id", "block"])
    total = lambda s: F.col(f"r_{s}") + F.col(f"b_{s}")
    name = lambda depth, sums: F.md5(F.concat_ws(",", depth, *sums).cast("binary"))
    nodes = runs.select(
        "conv_id", "depth", name(F.col("depth"), [total(s) for s in _SUMS]).alias("node"), name(F.col("depth") - 1, [total(s) - F.col(s) for s in _SUMS]).alias("parent"),
        "tokens", (total("tokens") - F.col("tokens")).alias("above"),
    )
    ends = attach(nodes, convs.select("conv_id", "n_turns"), "conv_id", F.col("depth")).withColumn("last", F.col("depth") == F.col("n_turns")).drop("n_turns")
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), name(zero, [zero] * 4).alias("node"), F.lit(None).cast("string").alias("parent"), zero.alias("tokens"), zero.alias("above"), (F.col("n_turns") == 0).alias("last"))
    return ends.unionByName(roots)


def _id_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): the SHA-256 of the ids (node, conv_id) of each node, in order, joined by commas.

    Ids are dealt by ranges and joined `IDS_A_ROW` at a time; a digest then reads its node's rows in order, one at a time.
    """

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, out = None, [], []

        def flush() -> None:
            if ids:
                out.append((node, ids[0], ",".join(map(str, ids))))
                ids.clear()

        def rows() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.string(), pa.int64(), pa.string()), strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["node", "first", "ids"])

        for batch in batches:
            for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n != node or len(ids) >= IDS_A_ROW:
                    flush()
                    node = n
                ids.append(c)
            yield rows()
        flush()
        yield rows()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            done = []
            for n, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if n == node:
                    sha.update(b",")
                else:
                    if sha is not None:
                        done.append((node, sha.hexdigest()))
                    node, sha = n, hashlib.sha256()
                sha.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], names=["node", "ends_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([sha.hexdigest()])], names=["node", "ends_sha256"])

    keys = ["node", "conv_id"]
    joined = ends.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(grouped, "node string, first long, ids string")
    return joined.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digested, "node string, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """A row per node: conv_id (its smallest member), depth, parent_conv_id (its parent's; null at the root), n_convs (members),
    n_children, n_leaves (childless nodes of its subtree), saved_tokens (over its subtree, each node's members but one times
    its tokens) and ends_sha256 (of the ids of members that end there, ascending and joined by commas).

    `convs` (conv_id, n_turns, tokens; one row per conversation, also those without turns) and `turns` (conv_id, depth from 1,
    turn_hash, tokens). Without conversations there is no node.
    """
    rows = stored(paths(convs, turns), "paths")
    nodes = stored(
        rows.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("above").alias("above"), F.bool_and("last").alias("leaf")),
        "nodes",
    )
    # where a conversation's own suffix begins; one without any owns nothing, and all its tokens are shared
    owned = nodes.groupBy("conv_id").agg(F.min_by("above", "depth").alias("shared"), F.max(F.col("leaf").cast("long")).alias("leaf"))
    marks = convs.join(owned, "conv_id", "left").select("conv_id", F.coalesce("shared", "tokens").alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    marked = attach(rows.select("conv_id", "depth", "node", "above"), marks, "conv_id", F.col("depth"))
    sums = marked.groupBy("node").agg(F.sum(F.greatest(F.col("shared") - F.col("above"), F.lit(0))).alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    children = nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "node")
    parents = attach(nodes.where("parent is not null").select("node", "parent"), nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent", F.col("node")).drop("parent")
    every = nodes.join(sums, "node").join(children, "node", "left").join(parents, "node", "left").join(_id_digests(rows.where("last")), "node", "left")
    return every.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def plain_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are, for `trie`: from `numbered`."""
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sum("tokens").alias("tokens")), turns.withColumnRenamed("place", "depth")


def of_rebuilt(conversations: DataFrame) -> DataFrame:
    """`trie` of the rebuilt conversations of a table (conv_id, turn, role, text). Rows without a conv_id belong to no
    conversation; repeated rows are turns of their own; other columns are ignored."""
    convs, turns = rebuilt(stored(numbered(conversations), "numbered"))
    return trie(stored(convs, "conversations"), stored(turns, "rebuilt"))
