"""The trie of conversations that begin alike, by chained prefix digests.

Every turn has a digest of its role and text. The digest of a prefix is that of
the digest of the prefix one turn shorter followed by its last turn's, so equal
digests mean equal beginnings. Each conversation is exploded into all its
prefixes; grouped by depth and digest these are the trie's nodes, with the
number and the smallest of their members.

Sums over subtrees: a node is owned by its smallest member. The smallest member
of a node is the smallest of every node below it that it passes, so what a
conversation owns is the end of its path. Inside that end, sums run from the
deepest node upwards; what the whole end sums up to is exploded to all the
ancestors above it, which are the conversation's other prefixes. Every node of
a subtree is counted once, and the rows exploded are as many as there are
turns, however deep the trie: each node to each of its ancestors would be the
square of a long conversation's turns.

Only digests, sizes and ids are exchanged, never texts. The turns of one
conversation are read in order by one task as a stream, since a chain has no
other order; a node that any share of all conversations pass through is counted
before the exchange. The ids of the conversations that end in a node are joined
in chunks of sorted ranges, and the chunks digested as a stream.

Defined results: a null role or text is empty; turns are ordered by turn (null
first), ties by role, then the text's digest; repeated rows are repeated turns;
rows without conv_id belong to no conversation; a conversation named without
turns ends in the root; without conversations there is no node; other columns
are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelspark.llm.common import batch, bound_batches, longs, materialize, partitions

#: Bytes of a node's digest, the root's, and bytes of ids that are joined in one chunk.
WIDTH, CHUNK = 16, 1 << 16
ROOT = bytes(WIDTH)


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, nth, digest, bytes): the turns of each conversation by number from 1, their digest and the bytes of their texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # the role's length says where the text begins
    own = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), own.alias("digest"), F.octet_length(text).cast("long").alias("bytes")).filter("conv_id is not null")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("nth"), "digest", "bytes")


def regrown(own: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns like those given, with the beginnings exchanged, and all conv_ids: conversation c begins with the first h turns of conversation c - c % every, h = crc32(c) % most, and goes on with its own after its first h."""
    ids = own.select("conv_id").distinct()
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    heads = own.filter((F.col("conv_id") % every == 0) & (F.col("nth") < most)).withColumnRenamed("conv_id", "_from")
    begun = ids.withColumns({"_from": F.col("conv_id") - F.col("conv_id") % every, "_h": taken}).join(heads, "_from").filter("nth <= _h")
    return begun.select(*own.columns).unionByName(own.filter(F.col("nth") > taken)), ids


def _prefixes(batches):
    """Turns sorted by conversation and number, as prefixes; the last one of a conversation is marked as its end."""
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("node", pa.binary()), ("bytes", pa.int64()), ("ends", pa.int64())])
    conv, depth, node = None, 0, ROOT
    held: tuple | None = None  # the last prefix so far: whether it ends is not known yet
    for b in batches:
        out = []
        for c, nth, digest, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            if c != conv:
                if held:
                    out.append((*held, 1))
                conv, depth, node = c, 0, ROOT
            elif held:
                out.append((*held, 0))
            if nth:
                depth, node = depth + 1, hashlib.sha256(node + digest).digest()[:WIDTH]
            held = (c, depth, node, size)
        if out:
            yield batch(schema, *zip(*out, strict=True))
    if held:
        yield batch(schema, *([x] for x in (*held, 1)))


def prefixes(own: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, depth, node, bytes, ends) of every prefix of every conversation in ids, the empty one included."""
    empty = ids.select("conv_id", F.lit(0).cast("long").alias("nth"), F.lit(ROOT).alias("digest"), F.lit(0).cast("long").alias("bytes"))
    rows = own.unionByName(empty).repartition(partitions(own.sparkSession), "conv_id").sortWithinPartitions("conv_id", "nth")
    return rows.select("conv_id", "nth", "digest", "bytes").mapInArrow(_prefixes, "conv_id long, depth long, node binary, bytes long, ends long")


def _chunks(batches):
    """Sorted (node, conv_id) as (node, first conv_id, the ids joined by commas), none longer than CHUNK but for its last id."""
    schema = pa.schema([("node", pa.binary()), ("first", pa.int64()), ("ids", pa.binary())])
    node, first, ids, size = None, 0, [], 0
    for b in batches:
        out = []
        for x, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if x != node or size > CHUNK:
                if ids:
                    out.append((node, first, b",".join(ids)))
                node, first, ids, size = x, c, [], 0
            ids.append(b"%d" % c)
            size += len(ids[-1]) + 1
        if out:
            yield batch(schema, *zip(*out, strict=True))
    if ids:
        yield batch(schema, [node], [first], [b",".join(ids)])


def _digests(batches):
    """Sorted chunks of a node as the digest of all of them, joined by commas."""
    schema = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])
    node, state = None, None
    for b in batches:
        out = []
        for x, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if x == node:
                state.update(b",")
            else:
                if state:
                    out.append((node, state.hexdigest()))
                node, state = x, hashlib.sha256()
            state.update(ids)
        if out:
            yield batch(schema, *zip(*out, strict=True))
    if state:
        yield batch(schema, [node], [state.hexdigest()])


def ends_digests(paths: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes where a conversation ends: the SHA-256 of their ids in order, joined by commas."""
    parts = partitions(paths.sparkSession)
    # ranges of (node, id): a node where very many conversations end lies in as many tasks as it needs
    ended = paths.filter("ends = 1").select("node", "conv_id").repartitionByRange(parts, "node", "conv_id").sortWithinPartitions("node", "conv_id")
    chunks = ended.mapInArrow(_chunks, "node binary, first long, ids binary")
    return chunks.repartition(parts, "node").sortWithinPartitions("node", "first").mapInArrow(_digests, "node binary, ends_sha256 string")


def prefix_trie(own: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(conv_id, depth, node, parent_conv_id, n_convs, n_ends, n_children, n_leaves, bytes, saved_tokens, ends_sha256) of every node.

    own: (conv_id, nth, digest, bytes) as turns() makes them; ids: all conv_ids,
    those without turns included. saved_tokens and n_leaves are sums over the
    node's subtree, the node included: of (n_convs - 1) * bytes, and of nodes
    without children.
    """
    bound_batches(own.sparkSession)
    paths = materialize(prefixes(own, own.select("conv_id").distinct() if ids is None else ids))
    nodes = paths.groupBy("depth", "node").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.sum("ends").alias("n_ends"), F.max("bytes").alias("bytes"))
    # where all members end, none goes on
    nodes = nodes.withColumns({"_saved": (F.col("n_convs") - 1) * F.col("bytes"), "_leaf": (F.col("n_ends") == F.col("n_convs")).cast("long")})
    below = Window.partitionBy("owner").orderBy(F.desc("depth"))
    nodes = materialize(nodes.withColumns({"_own_saved": F.sum("_saved").over(below), "_own_leaves": F.sum("_leaf").over(below), "_goes_on": F.lag("depth").over(below).isNotNull().cast("long")}))

    owned = nodes.groupBy("owner").agg(F.min("depth").alias("top"), F.sum("_saved").alias("_more_saved"), F.sum("_leaf").alias("_more_leaves"))
    # the prefixes that a conversation does not own are the ancestors of all it owns
    above = paths.select("conv_id", "depth", "node").join(owned.withColumnRenamed("owner", "conv_id"), "conv_id").filter("depth < top")
    hangs = (F.col("depth") == F.col("top") - 1).cast("long")
    sums = above.groupBy("depth", "node").agg(F.sum("_more_saved").alias("_more_saved"), F.sum("_more_leaves").alias("_more_leaves"), F.sum(hangs).alias("_hang"))
    out = nodes.join(sums, ["depth", "node"], "left").join(ends_digests(paths), "node", "left")

    # the parent belongs to the owner itself but at the top of what it owns
    tops = above.filter("depth = top - 1").select("node", F.col("conv_id").alias("_child"), F.col("top").alias("depth"))
    parents = tops.join(nodes.select("node", F.col("owner").alias("_parent")), "node").select("depth", F.col("_child").alias("owner"), "_parent")
    out = out.join(parents, ["owner", "depth"], "left")
    none = hashlib.sha256().hexdigest()
    return out.select(
        F.col("owner").alias("conv_id"),
        "depth",
        "node",
        F.when(F.col("depth") > 0, F.coalesce("_parent", "owner")).alias("parent_conv_id"),
        "n_convs",
        "n_ends",
        (F.col("_goes_on") + F.coalesce("_hang", F.lit(0))).alias("n_children"),
        (F.col("_own_leaves") + F.coalesce("_more_leaves", F.lit(0))).alias("n_leaves"),
        "bytes",
        (F.col("_own_saved") + F.coalesce("_more_saved", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )


def trie_report(conversations: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """The trie of the conversations with exchanged beginnings."""
    own, ids = regrown(materialize(turns(conversations)), every, most)
    return prefix_trie(own, ids).drop("node", "bytes", "n_ends")
