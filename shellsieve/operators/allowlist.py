"""Allow-lists: trusted script hashes and rules for everyday commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellsieve.functions import text as X
from shellsieve.operators.barrier import seal
from shellsieve.session import release, settle
from shellsieve.vocabulary import (
    BUILT_IN_COMMANDS,
    EVASION_WORDS,
    GIT_PREFIXES,
    INSTALLERS,
    LAUNCH_SOURCE,
    REASON_TRUSTED,
    RUNNABLE_SUFFIXES,
    SYSTEM_PATHS,
    TRUSTED_HASHES,
    USER_FOLDERS,
)

#: a hash list of up to this many rows is broadcast (about 100 bytes each)
BROADCAST_HASHES = 200_000


def allow_text(text: Column) -> Column:
    """Lower case, stripped, without quotes: the text the allow rules look at."""
    bare = X.strip(F.lower(text))
    return F.replace(F.replace(bare, F.lit('"'), F.lit("")), F.lit("'"), F.lit(""))


def allow_rule(text: Column, source: Column) -> Column:
    """Number of the first rule that lets a command pass, or null.

    ``text`` is an ``allow_text`` column.
    """
    evasive = X.contains_any(text, EVASION_WORDS)
    git = text.startswith(GIT_PREFIXES[0]) | text.startswith(GIT_PREFIXES[1])
    runs_exe = text.contains(".exe")
    return (
        F.when(git & ~evasive, 1)
        .when(
            X.contains_any(text, USER_FOLDERS) & X.contains_any(text, INSTALLERS) & ~evasive, 2
        )
        .when(runs_exe & X.contains_any(text, SYSTEM_PATHS), 3)
        .when(text.isin(*BUILT_IN_COMMANDS), 4)
        .when(
            F.coalesce(source, F.lit("")).contains(LAUNCH_SOURCE)
            & ~X.contains_any(text, RUNNABLE_SUFFIXES),
            5,
        )
    )


def add_allow_rule(df: DataFrame, text: str, source: str = "source") -> DataFrame:
    ruled = (
        df.withColumn("__allow_text", allow_text(F.col(text)))
        .withColumn("allow_rule", allow_rule(F.col("__allow_text"), F.col(source)))
        .drop("__allow_text")
    )
    return seal(ruled, ["allow_rule"])


def _fits(hashes: DataFrame, rows: int) -> bool:
    return hashes.limit(rows + 1).count() <= rows


def mark_trusted(
    scripts: DataFrame,
    content: str = "content",
    trusted: DataFrame | None = None,
    broadcast_rows: int = BROADCAST_HASHES,
) -> DataFrame:
    """Add ``sha256``, ``is_trusted`` and ``trust_reason`` to whole scripts.

    Without ``trusted`` (one column, ``sha256``) the built-in list is used.  A list is
    written out once and broadcast only if a bounded count shows that it is small.  Of a longer
    one only the hashes that scripts have are needed: distinct hashes, without texts, are
    exchanged to find them, and they are broadcast if they are few.  Beyond that both sides
    shuffle by hash; adaptive execution splits the partition of a script that is found on a
    third of all hosts, as this is the left side of a left join.
    """
    hashed = scripts.withColumn("sha256", X.sha256_hex(F.col(content)))
    if trusted is None:
        marked = hashed.withColumn("is_trusted", F.col("sha256").isin(*TRUSTED_HASHES))
    else:
        listed = settle(trusted.select(F.col("sha256").alias("__listed")).distinct())
        small = _fits(listed, broadcast_rows)
        if not small:
            present = hashed.select(F.col("sha256").alias("__listed")).distinct()
            met = settle(listed.hint("merge").join(present, "__listed", "left_semi"))
            release(listed)
            listed, small = met, _fits(met, broadcast_rows)
        side = F.broadcast(listed) if small else listed.hint("merge")
        joined = hashed.join(side, F.col("sha256") == F.col("__listed"), "left")
        marked = joined.withColumn("is_trusted", F.col("__listed").isNotNull()).drop("__listed")
    reason = F.format_string(REASON_TRUSTED, F.substring("sha256", 1, 8))
    return marked.withColumn("trust_reason", F.when(F.col("is_trusted"), reason).otherwise(""))
