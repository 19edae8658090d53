"""Findings: filter, display columns and orderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellsieve.functions.times import shown_time

#: rows that tie keep the order they were read in; stored streams have no such number
TIE_BREAK = "cmd_id"
STREAM_TIE_BREAK = ("origin", "timestamp", "source", "command")


def tie_break(df: DataFrame) -> list[str]:
    if TIE_BREAK not in df.columns:
        return [*(c for c in ("source_no",) if c in df.columns), *STREAM_TIE_BREAK]
    return [c for c in ("source_no", TIE_BREAK) if c in df.columns]


def shown_percent(score: Column) -> Column:
    """Two digits; an exact half goes to the even digit, as the display rule has it."""
    return F.format_string("%.2f%%", F.bround(score, 2))


def malicious_only(df: DataFrame) -> DataFrame:
    return df.filter("is_malicious")


def display_columns(df: DataFrame) -> DataFrame:
    """Order first, show last: the shown score is text."""
    return df.select(
        *([TIE_BREAK] if TIE_BREAK in df.columns else []), "timestamp", "level",
        shown_percent(F.col("score")).alias("score"), "source", "command",
        *(["origin"] if "origin" in df.columns else []),
    )


def _score_key(df: DataFrame) -> Column:
    """The score as displayed, rounded to two digits; ``N/D`` counts as 0."""
    if dict(df.dtypes)["score"] == "string":
        number = F.replace(F.col("score"), F.lit("%"), F.lit("")).try_cast("double")
        return F.coalesce(number, F.lit(0.0))
    return F.coalesce(F.bround(F.col("score"), 2), F.lit(0.0))


def order_findings(df: DataFrame, column: str = "score", descending: bool = True) -> DataFrame:
    """Total order by a displayed column; text compares without regard to case.

    Rows without a readable date come first in both directions.  The range exchange
    behind the sort includes the unique tie-break, so a score that a third of all rows
    share still spreads over many tasks.
    """
    if column == "score":
        key = _score_key(df)
        ordered = key.desc() if descending else key.asc()
    elif column == "timestamp":
        key = shown_time(F.col("timestamp"))
        ordered = key.desc_nulls_first() if descending else key.asc_nulls_first()
    else:
        key = F.lower(F.col(column).cast("string"))
        ordered = key.desc() if descending else key.asc()
    return df.orderBy(ordered, *[F.col(c).asc() for c in tie_break(df)])


def top(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    return df.orderBy(F.col(key).desc(), *[F.col(c) for c in df.columns if c != key]).limit(n)
