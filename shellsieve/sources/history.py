"""Console histories: text files with one command per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shellsieve.functions import text as X
from shellsieve.functions.times import display_file_time
from shellsieve.sources.positions import positioned_lines
from shellsieve.vocabulary import HISTORY_SOURCE


def history_entries(lines: DataFrame, numbered: bool = True) -> DataFrame:
    """Entries from a frame of ``value``, ``file_time`` and ``origin`` (the file).

    Blank lines are dropped.  A frame without ``origin`` gives entries of unknown origin.

    A ``cmd_id`` of the lines stays; without one, entries are numbered as they are read.  A
    stream cannot be ``numbered``: its entries have no ``cmd_id``.
    """
    number = F.col("cmd_id") if "cmd_id" in lines.columns else F.monotonically_increasing_id()
    origin = F.col("origin") if "origin" in lines.columns else F.lit(None).cast("string")
    command = X.strip(X.drop_invalid_utf8(F.col("value")))
    return lines.select(
        *([number.alias("cmd_id")] if numbered else []),
        F.lit(HISTORY_SOURCE).alias("source"),
        command.alias("command"),
        F.col("file_time").alias("event_ts"),
        F.lit("file").alias("ts_note"),
        display_file_time(F.col("file_time")).alias("timestamp"),
        origin.alias("origin"),
    ).filter(F.col("command") != "")


#: a line feed's line may hold so many more, parted by lone carriage returns
PIECES = 1 << 20


def read_history(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Entries of history files; a line ends at a line feed, a carriage return or both.

    ``cmd_id`` grows with the file's path and the place in the file and does not hang on
    partitions, so it is the same in every run over the same files.  A byte order mark at the
    start of a file stays part of its first command.
    """
    lines = positioned_lines(spark, path).withColumn("text", X.drop_invalid_utf8(F.col("value").cast("string")))
    pieces = lines.select("origin", "file_time", "place", F.posexplode(F.split("text", "\r")).alias("piece", "value"))
    return history_entries(pieces.withColumn("cmd_id", F.col("place") * PIECES + F.col("piece")))
