"""Trie of conversation prefixes, built level by level.

``ranked`` numbers each conversation's turns; ``rebuilt`` puts shared openings before them.  Then, one depth after another, the
conversations that still share their node with others are grouped by (parent node, next turn): each group is a node, named by
its least conv_id.  A conversation that is alone in its node has no more company further down: the rest of its turns is a chain of
nodes of its own, which needs no more rounds, so there are as many rounds as the longest prefix that any two share has turns,
and one.  Levels are then joined from the deepest up: leaves and savings of children are added to their parents'.

A turn is known by a SHA-256 of role and text from the start, so texts are sent once, to be sorted, and no further.  Conversations of very
many turns are numbered in ranges of turns, not in one task; a node that very many share is a group that is added up before it
is sent, and the join that names it for each of its members is split by the adaptive skew join or broadcast.  The digest of a
node's ends goes over strings of ids that many tasks write.

Defined cases: null roles and texts are empty; turns are ordered by (turn, role, text), null turns first, so ties and repeated
rows have one order; rows without a conv_id belong to no conversation and are left out; very long texts are read whole; an
empty table has no conversation and so no root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, drop, lookup_join, map_batches, stored

#: Ids in one piece of a node's list of ends.
PIECE = 1 << 13


def ranked(rows: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), key, words of every turn of every conversation.

    Turns are sorted over all partitions at once; a turn's place is its number less the first one of its conversation in that
    partition, and what earlier partitions have of the conversation is added."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.unhex(F.sha2(F.concat(F.char_length(role), F.lit(":"), role, text), 256)).alias("key"), role.alias("role"), text.alias("text"),
    ).filter("conv_id is not null")
    ordered = turns.repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    numbered = ordered.select("conv_id", "key", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), F.monotonically_increasing_id().alias("id"))
    numbered, at = stored(numbered, "turns")
    part = F.shiftright("id", 33)
    runs = numbered.groupBy("conv_id", part.alias("part")).agg(F.min("id").alias("first"), F.count("*").alias("n"))
    many = runs.groupBy("conv_id").agg(F.collect_list(F.struct("part", "first", "n")).alias("runs"))  # at most one for each partition
    before = lambda x: F.aggregate(F.filter("runs", lambda y: y["part"] < x["part"]), F.lit(0).cast("long"), lambda s, y: s + y["n"])
    offsets, _ = stored(many.select("conv_id", F.explode(F.transform("runs", lambda x: F.struct(x["part"].alias("part"), (before(x) + 1 - x["first"]).alias("shift")))).alias("x")).select("conv_id", "x.part", "x.shift"), "offsets")
    out, _ = stored(lookup_join(numbered.withColumn("part", part), offsets, ["conv_id", "part"], "inner").select("conv_id", (F.col("id") + F.col("shift")).alias("pos"), "key", "words"), "ranked")
    drop(at)
    return out


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) where every conv_id c begins with the first crc32(c) % most turns of conversation c - c % every (% has
    the sign of c), and goes on with its own after as many; conversations: conv_id, length."""
    sizes, _ = stored(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "sizes")
    told = sizes.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % every).alias("from"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h"))
    heads = turns.filter(F.col("pos") < most).select(F.col("conv_id").alias("from"), "pos", "key", "words")
    shared = told.join(heads, "from").filter("pos <= h").select("conv_id", "pos", "key", "words")
    others = sizes.select(F.col("conv_id").alias("from"), F.col("n").alias("there"))
    told, _ = stored(lookup_join(told, others, ["from"]).select("conv_id", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("head"), "n"), "told")
    own = lookup_join(turns, told, ["conv_id"], "inner").filter("pos > h").select("conv_id", (F.col("head") + F.col("pos") - F.col("h")).alias("pos"), "key", "words")
    made, _ = stored(shared.unionByName(own).select("conv_id", F.col("pos").alias("depth"), "key", "words"), "rebuilt")
    return made, told.select("conv_id", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def ends_digests(ends: DataFrame) -> DataFrame:
    """depth, node, ends_sha256 of rows (depth, node, conv_id).  Ids are sorted over all partitions and written as strings of
    PIECE ids by many tasks; those of a node of several pieces meet in order of their first id and are hashed as they come."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["depth", "node", "first", "ids"])

        for batch in batches:
            for depth, node, conv in zip(*(column(batch, c).to_pylist() for c in ("depth", "node", "conv_id")), strict=True):
                if ids and (key != (depth, node) or len(ids) >= PIECE):
                    yield piece()
                    ids = []
                key = (depth, node)
                ids.append(conv)
        if ids:
            yield piece()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([state.hexdigest()])], ["depth", "node", "ends_sha256"])
        for batch in batches:
            for depth, node, ids in zip(*(column(batch, c).to_pylist() for c in ("depth", "node", "ids")), strict=True):
                if key != (depth, node):
                    if key is not None:
                        yield done()
                    key, state = (depth, node), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if key is not None:
            yield done()

    sorted_ = ends.select("depth", "node", "conv_id").repartitionByRange("depth", "node", "conv_id").sortWithinPartitions("depth", "node", "conv_id")
    pieces, _ = stored(sorted_.transform(map_batches, write, "depth bigint, node bigint, first bigint, ids string"), "pieces")
    together = pieces.repartition("depth", "node").sortWithinPartitions("depth", "node", "first")
    return together.transform(map_batches, digest, "depth bigint, node bigint, ends_sha256 string")


def build(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of turns (conv_id,
    depth, key, words); conversations has all conv_ids and their lengths, turnless ones too."""
    conversations, _ = stored(conversations, "conversations")
    total = conversations.agg(F.count("*").alias("n"), F.min("conv_id").alias("node")).first()
    root = conversations.sparkSession.createDataFrame([(total["node"], None, total["n"], 0)] if total["n"] else [], "node bigint, parent bigint, n_convs bigint, words bigint")
    levels, live, live_at, alone = [root], conversations.select("conv_id", F.lit(total["node"]).cast("long").alias("node")).filter(F.lit(total["n"] > 1)), None, []
    if total["n"] == 1:
        alone.append(conversations.select("conv_id", F.lit(0).cast("long").alias("since")))
    ended = [conversations.filter("length = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(total["node"]).cast("long").alias("node"), "conv_id")]
    depth = 0
    while True:
        depth += 1
        here = turns.filter(F.col("depth") == depth).select("conv_id", "key", "words")
        step, step_at = stored(live.join(here, "conv_id"), "step")
        named, _ = stored(step.groupBy(F.col("node").alias("parent"), "key").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.first("words").alias("words")), "nodes")
        if named.isEmpty():
            break
        levels.append(named.select("node", "parent", "n_convs", "words"))
        joined = lookup_join(step.select(F.col("node").alias("parent"), "key", "conv_id"), named.select("parent", "key", "node", "n_convs"), ["parent", "key"], "inner")
        following, following_at = stored(joined.select("conv_id", "node", "n_convs"), "live")
        alone.append(following.filter("n_convs = 1").select("conv_id", F.lit(depth).cast("long").alias("since")))
        live = following.filter("n_convs > 1").select("conv_id", "node")
        ended.append(live.join(conversations.filter(F.col("length") == depth), "conv_id").select(F.lit(depth).cast("long").alias("depth"), "node", "conv_id"))
        drop(step_at)

    # conversations alone: a chain from the depth at which they were left
    chains = _union(alone, "conv_id bigint, since bigint", conversations)
    chains, _ = stored(chains.join(conversations, "conv_id"), "alone")
    below = turns.join(chains, "conv_id").filter("depth > since").select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), (F.col("depth") < F.col("length")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"), F.sha2(F.when(F.col("depth") == F.col("length"), F.col("conv_id").cast("string")).otherwise(""), 256).alias("ends_sha256"),
    )
    ended.append(chains.filter("length = since and since > 0").select(F.col("since").alias("depth"), F.col("conv_id").alias("node"), "conv_id"))
    goes_on = chains.filter("length > since").select(F.col("since").alias("depth"), F.col("conv_id").alias("node"))

    # from the deepest level up
    nodes, rolled = [], None
    for k in range(len(levels) - 1, -1, -1):
        own = levels[k]
        if rolled is None:
            full = own.select("*", F.lit(None).cast("long").alias("children"), F.lit(None).cast("long").alias("leaves"), F.lit(None).cast("long").alias("saved"))
        else:
            up, _ = stored(rolled.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")), "up")
            full = lookup_join(own, up, ["node"])
        rolled, _ = stored(full.select("node", "parent", "n_convs", F.lit(k).cast("long").alias("depth"), F.coalesce("children", F.lit(0)).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words") + F.coalesce("saved", F.lit(0))).alias("saved_tokens")), "rolled")
        nodes.append(rolled)
    nodes_ = nodes[0]
    for other in nodes[1:]:
        nodes_ = nodes_.unionByName(other)
    digests, _ = stored(ends_digests(_union(ended, "depth bigint, node bigint, conv_id bigint", conversations)), "ends")
    shared = lookup_join(lookup_join(nodes_, digests, ["depth", "node"]), goes_on.withColumn("more", F.lit(1).cast("long")), ["depth", "node"])
    shared = shared.select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", (F.col("n_children") + F.coalesce("more", F.lit(0))).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
    return shared.unionByName(below)


def _union(parts: list[DataFrame], schema: str, near: DataFrame) -> DataFrame:
    out = near.sparkSession.createDataFrame([], schema)
    for part in parts:
        out = out.unionByName(part)
    return out


def prefix_trie(rows: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """The trie of rebuilt conversations; rows: conv_id, turn, role, text."""
    return build(*rebuilt(ranked(rows), every, most))
