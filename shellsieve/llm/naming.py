"""Exact duplicates by deterministic block naming.

A text is cut into blocks of fixed size.  The distinct blocks of all texts are sorted and a
block's name is its place, a whole number.  Then the names of adjacent blocks are paired, the
distinct pairs sorted and named in the same way, and so on; after ``ceil(log2(blocks))``
rounds a text has one name, and two texts have the same name after the same number of rounds
exactly if they are equal: names stand for contents that were compared, not for hashes.

The contents travel once, to be sorted.  Blocks find their names by a 64-bit key instead,
which is as good as the content where the sorted blocks show that no other block has the
key.  Where two different blocks share a key, those blocks, and only those, find their names
by key and content.

Names are given per sorted partition (partition number and place in it), so nothing passes
through one task.  Every round is written out: a lost executor reads it again, and a name
that was given stays.  Joins have one row per name on one side, so a block that a third of
all texts hold is split by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellsieve.llm.storage import discard, written

BLOCK_BYTES = 4096
#: What stands for the missing partner of a last odd block.
NOTHING = -1
#: A run that is not one plain space; single spaces need no replacing.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """``text`` with every run of white space as one space; a null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def cut(texts: DataFrame, size: int) -> DataFrame:
    """The binary column ``raw`` in blocks of ``size`` bytes: ``n``, ``pos`` and ``block`` a row.

    An empty text has one empty block.  The positions come out of a generator, below which
    ``raw`` is computed once a text; inside a lambda it would be computed for every block.
    """
    last = F.floor(F.greatest(F.octet_length("raw") - 1, F.lit(0)) / size).cast("int")
    placed = texts.select("*", (last + 1).alias("n"), F.explode(F.sequence(F.lit(0), last)).alias("pos"))
    return placed.withColumn("block", F.substring(F.col("raw"), F.col("pos") * size + 1, F.lit(size)))


def names_of(rows: DataFrame) -> DataFrame:
    """The distinct ``rows``, sorted, each with a whole number of its own: ``name``."""
    ordered = rows.distinct().sortWithinPartitions(*rows.columns)
    return written(ordered.withColumn("name", F.monotonically_increasing_id()))


def _paired(live: DataFrame) -> DataFrame:
    """Two adjacent names a row; a group has two rows at most."""
    odd = F.col("pos") % 2 == 1
    return live.groupBy(
        "row", F.expr("pos div 2").cast("int").alias("pos"), F.expr("(n + 1) div 2").cast("int").alias("n")
    ).agg(
        F.max(F.when(~odd, F.col("name"))).alias("left"),
        F.coalesce(F.max(F.when(odd, F.col("name"))), F.lit(NOTHING).cast("long")).alias("right"),
    )


def identities(docs: DataFrame, size: int = BLOCK_BYTES, text: str = "text", doc_id: str = "doc_id",
               key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per document: ``row`` (a number of its own), its id, ``text_sha256``, and
    ``rounds`` and ``name``, which two documents share exactly if their texts are equal
    when every run of white space counts as one space.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).cast("binary").alias("raw"))
    names = names_of(cut(texts, size).select(key(F.col("block")).alias("key"), "block"))
    clashing = names.groupBy("key").count().filter("count > 1").select("key")
    first = F.col("pos") == 0
    pieces = cut(texts.withColumn("row", F.monotonically_increasing_id()), size).select(
        "row", "pos", "n", key(F.col("block")).alias("key"), "block", F.when(first, F.col("doc_id")).alias("doc_id"),
        F.when(first, F.sha2("raw", 256)).alias("text_sha256"))
    by = ["key"]
    if clashing.isEmpty():
        pieces = written(pieces.drop("block"))
    else:
        # A block travels only with a clashing key; elsewhere an empty one stands on both sides.
        marked = written(clashing.withColumn("clash", F.lit(True)))
        shown = F.when(F.col("clash"), F.col("block")).otherwise(F.lit(b"")).alias("block")
        pieces = written(pieces.join(marked, "key", "left").select(*pieces.drop("block").columns, shown))
        names = names.join(marked, "key", "left").select("key", "name", shown)
        by = ["key", "block"]

    live = written(pieces.select("row", "pos", "n", *by).join(names.select(*by, "name"), by).select("row", "pos", "n", "name"))
    longest = pieces.agg(F.max("n")).first()[0] or 1
    done, rounds = [], 0
    while True:
        done.append(live.filter("n = 1").select("row", F.lit(rounds).alias("rounds"), "name"))
        if longest == 1:
            break
        pairs = written(_paired(live.filter("n > 1")))
        names = names_of(pairs.select("left", "right"))
        live = written(pairs.join(names, ["left", "right"]).select("row", "pos", "n", "name"))
        discard(pairs)
        discard(names)
        longest, rounds = (longest + 1) // 2, rounds + 1
    heads = pieces.filter("pos = 0").select("row", "doc_id", "text_sha256")
    return heads.join(reduce(DataFrame.unionByName, done), "row")


def exact_duplicates(docs: DataFrame, size: int = BLOCK_BYTES, text: str = "text", doc_id: str = "doc_id",
                     key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal if they are identical after each run of ``[\\x20\\x09-\\x0D]`` became one
    space (runs at the ends too); null counts as empty.  Of equal texts one row stays, that
    of the smallest id (``keep_id``).  A row without an id stays only if no row of its group
    has one; ``keep_id`` is null then.  Of rows that repeat the smallest id exactly one
    stays.  ``text_sha256`` is that of the normalised text.  Other columns are not read, so
    their names do not matter.  An empty table gives none.

    ``key`` names a block for look-ups; any function of the block gives the same result.
    """
    found = written(identities(docs, size, text, doc_id, key))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", "row")).alias("first")
    groups = found.groupBy("rounds", "name").agg(first, F.count("*").alias("group_size"))
    return found.join(groups, ["rounds", "name"]).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256")
