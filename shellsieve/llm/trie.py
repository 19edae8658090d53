"""The prefix trie of conversations, measured by the Euler-tour technique.

A node is a distinct beginning of conversations.  Every node gets an enter and an exit arc;
the arcs, linked in the order of a depth-first walk, form one list.  List ranking gives
each arc its place and the sums of leaves and savings before it, and a subtree's share is the
difference between a node's exit and enter arc.  No step descends the trie level by level.

Beginnings are known by sums: a turn at a position has four 32-bit numbers out of a SHA-256
of position, role and text, and a beginning has their sums over its positions, which come from
windows of bounded length whatever the length of a conversation.  All members of a node are
checked to have the same last turn and the same parent, so by induction the same turns.  Texts
do not leave the scan that hashes them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shellsieve.llm.listrank import MOST, list_ranks, placed
from shellsieve.llm.storage import written

KEYS = ("s0", "s1", "s2", "s3")
TERMS = ("t0", "t1", "t2", "t3")
PARENT = ("p0", "p1", "p2", "p3")
#: Turns of one conversation that a window holds.
BLOCK = 4096
#: Ids in one piece of an id list.
PIECE = 4096
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes over: the CRC-32 of its decimal id modulo 4."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 4).cast("long")


def rebuilt(conversations: DataFrame, every: int = 20) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, pos, digest, words, size)`` of the rebuilt turns and ``(conv_id, size)``.

    A conversation begins with the first turns of conversation ``conv_id - conv_id % every``
    (:func:`shared_turns` of them, all if it has fewer) and goes on with its own after as many.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    sorted_turns = placed(turns, "conv_id", "turn", "digest")
    sizes = written(sorted_turns.groupBy("conv_id").agg(F.min("place").alias("start"), F.count("*").alias("own")))
    numbered = written(sorted_turns.join(sizes, "conv_id").select(
        "conv_id", (F.col("place") - F.col("start") + 1).alias("i"), "digest", "words"))

    base = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    told = sizes.withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "h": shared_turns(F.col("conv_id"))})
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    convs = written(told.join(base, "base", "left").select(
        "conv_id", "base", "h", taken.alias("taken"),
        (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size")))
    own = numbered.join(convs, "conv_id").filter("i > h").select(
        "conv_id", (F.col("taken") + F.col("i") - F.col("h")).alias("pos"), "digest", "words", "size")
    lent = numbered.filter("i <= 3").withColumnRenamed("conv_id", "base")
    taken_over = convs.filter("taken > 0").join(lent, "base").filter("i <= taken").select(
        "conv_id", F.col("i").alias("pos"), "digest", "words", "size")
    return own.unionByName(taken_over), convs.select("conv_id", "size")


def beginnings(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every beginning of every conversation: its sums, its last turn's numbers and words."""
    told = F.sha2(F.concat(F.col("pos").cast("string"), F.lit(":"), F.col("digest")), 256)
    rows = turns.select("conv_id", "pos", "words", "size", F.expr(f"(pos - 1) div {block}").alias("block"), told.alias("told"))
    rows = written(rows.select("*", *[
        F.conv(F.substring("told", 8 * k + 1, 8), 16, 10).cast("long").alias(t) for k, t in enumerate(TERMS)]).drop("told"))
    inside = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.select("*", *[F.sum(t).over(inside).alias(s) for t, s in zip(TERMS, KEYS)])
    # Only conversations of more than one window have sums to carry over.
    totals = rows.filter(F.col("size") > block).groupBy("conv_id", "block").agg(*[F.sum(t).alias(t) for t in TERMS])
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("conv_id", "block", *[F.sum(t).over(earlier).alias(f"c_{t}") for t in TERMS])
    whole = summed.join(carried, ["conv_id", "block"], "left")
    return whole.select("conv_id", "pos", "words", "size", *TERMS, *[
        (F.col(s) + F.coalesce(F.col(f"c_{t}"), F.lit(0))).alias(s) for t, s in zip(TERMS, KEYS)])


def _nodes(members: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: sums, parent's sums, smallest member, members, words of the last turn."""
    grouped = members.groupBy(F.col("pos").alias("depth"), *KEYS).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"),
        *[F.min(t).alias(t) for t in TERMS], *[F.max(t).alias(f"high_{t}") for t in TERMS])
    alike = F.lit(True)
    for t in TERMS:
        alike = alike & (F.col(t) == F.col(f"high_{t}"))
    shown = F.when(alike, F.col("words")).otherwise(F.raise_error(F.lit("two beginnings have the same sums")))
    inner = grouped.select("depth", *KEYS, "conv_id", "n_convs", shown.cast("long").alias("words"), *[
        (F.col(s) - F.col(t)).alias(p) for s, t, p in zip(KEYS, TERMS, PARENT)])
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(
        F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(s) for s in KEYS], "conv_id", "n_convs",
        F.lit(0).cast("long").alias("words"), *[F.lit(None).cast("long").alias(p) for p in PARENT])
    return inner.unionByName(root)


def _family(nodes: DataFrame) -> DataFrame:
    """Nodes with ``id``, children (``first``, ``n_children``, their ids run on) and parent."""
    numbered = placed(nodes, "depth", *PARENT, "conv_id").withColumnRenamed("place", "id")
    children = numbered.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), *[
        F.col(p).alias(s) for p, s in zip(PARENT, KEYS)]).agg(F.min("id").alias("first"), F.count("*").alias("n_children"))
    parents = written(numbered.join(children, ["depth", *KEYS], "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0))))
    above = parents.filter("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), *[F.col(s).alias(p) for s, p in zip(KEYS, PARENT)],
        F.col("id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id"),
        (F.col("first") + F.col("n_children") - 1).alias("last"))
    return written(parents.join(above, ["depth", *PARENT], "left"))


def tour(family: DataFrame) -> DataFrame:
    """The arcs of the walk: enter is ``2 * id``, exit ``2 * id + 1``; leaves and savings weigh on enter."""
    node = F.col("id") * 2
    down = F.coalesce(F.col("first") * 2, node + 1)
    along = F.when(F.col("id") < F.col("last"), node + 2).otherwise(F.col("parent_id") * 2 + 1)
    nothing = F.lit(0).cast("long")
    saved = (F.col("n_convs") - 1) * F.col("words")
    enter = F.struct(node.alias("arc"), down.alias("next"), F.lit(1).cast("long").alias("place"),
                     (F.col("n_children") == 0).cast("long").alias("leaves"), saved.alias("saved"))
    leave = F.struct((node + 1).alias("arc"), along.alias("next"), F.lit(1).cast("long").alias("place"),
                     nothing.alias("leaves"), nothing.alias("saved"))
    return family.select(F.inline(F.array(enter, leave)))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one node, comma-joined, at most ``PIECE`` ids long."""
    for batch in batches:
        node, conv = (c.to_numpy() for c in batch.columns)
        new = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else []
        cuts = sorted({c for s, e in zip(new, [*new[1:], len(node)]) for c in range(s, e, PIECE)})
        texts = [",".join(map(str, conv[s:e].tolist())) for s, e in zip(cuts, [*cuts[1:], len(node)])]
        yield pa.RecordBatch.from_arrays([pa.array(node[cuts], pa.int64()), pa.array(conv[cuts], pa.int64()), pa.array(texts, pa.string())],
                                         ["id", "start", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces in order; one running hash at a time."""
    node, running = None, None

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([running.hexdigest()])], ["id", "ends_sha256"])

    for batch in batches:
        for i, ids in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            if i != node:
                if running:
                    yield told()
                node, running = i, hashlib.sha256()
            else:
                running.update(b",")
            running.update(ids.as_py().encode())
    if running:
        yield told()


def id_lists_sha256(ends: DataFrame) -> DataFrame:
    """``(id, ends_sha256)``: hash of each ``id``'s ``conv_id`` values, ascending, comma-joined.

    Ids are sorted over all partitions and joined to pieces there; the task that hashes a
    node's list reads pieces, in order, and holds one.
    """
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = (
        ends.select("id", "conv_id").repartitionByRange(parts, "id", "conv_id").sortWithinPartitions("id", "conv_id")
        .mapInArrow(_pieces, "id bigint, start bigint, ids string")
    )
    return pieces.repartition(parts, "id").sortWithinPartitions("id", "start").mapInArrow(
        _digests, "id bigint, ends_sha256 string")


def prefix_trie(conversations: DataFrame, every: int = 20, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations (see :func:`rebuilt`).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root),
    ``n_convs``, ``n_children``, ``n_leaves`` and ``saved_tokens`` (over the subtree, itself
    included: each node's (members - 1) times the words of its last text), ``ends_sha256``
    (of the ids of the members that end here), and ``enter`` and ``leave``, the places of the
    node's arcs in the tour.

    Turns are ordered by ``turn``, null first, then by the SHA-256 of role and text; repeated
    rows are as many turns.  Null role or text is empty.  Rows without a ``conv_id`` belong to
    no conversation.  Other columns are not read.  An empty table gives no node, not even a root.
    """
    turns, convs = rebuilt(conversations, every)
    members = written(beginnings(turns, block))
    family = _family(_nodes(members, convs))
    root = family.filter("depth = 0").select("id").first()
    head = 2 * root.id if root else 0
    ranks = list_ranks(tour(family), head, ("place", "leaves", "saved"), most) if root else written(
        tour(family).drop("next"))
    leaving = F.col("arc") % 2 == 1

    def share(weight: str) -> Column:
        return F.sum(F.when(leaving, F.col(weight)).otherwise(-F.col(weight)))

    subtrees = ranks.groupBy(F.expr("arc div 2").alias("id")).agg(
        F.min("place").alias("enter"), F.max("place").alias("leave"),
        share("leaves").alias("n_leaves"), share("saved").alias("saved_tokens"))
    ended = members.filter("pos = size").select(F.col("pos").alias("depth"), *KEYS, "conv_id")
    turnless = convs.filter("size = 0").select(F.col("size").alias("depth"), *[F.lit(0).cast("long").alias(s) for s in KEYS], "conv_id")
    ends = ended.unionByName(turnless).join(family.select("depth", *KEYS, "id"), ["depth", *KEYS])
    return family.join(subtrees, "id").join(id_lists_sha256(ends), "id", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"), "enter", "leave")
