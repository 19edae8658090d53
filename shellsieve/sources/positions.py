"""Lines of text files with the place they have there, whatever the partitions.

Spark cuts text files into byte ranges; a line belongs to the range it begins in.  The place
of a line is the number of lines in the ranges before, summed from one row per range, and
its place inside the range, where one task reads in order.  No line is moved for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from shellsieve.session import settle

#: what Spark's reader takes off the start of a file
BYTE_ORDER_MARK = b"\xef\xbb\xbf"


def positioned_lines(spark: SparkSession, path: str | list[str], separator: str = "\n") -> DataFrame:
    """``value`` (the bytes of a line), ``origin`` (its file), ``file_time``, ``block`` (start of its
    byte range), ``line`` (its number in the file, from 0) and ``place`` (its number in all files,
    in the order of their paths).

    A UTF-8 byte order mark, which Spark's reader drops, is put back: the bytes of a file that
    are neither lines nor separators tell whether it had one.  A compressed file's size says
    nothing of the kind, and such a file is one range.
    """
    at, first = F.col("__at"), F.col("__first")
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", separator).text(path).select(
        F.col("value").cast("binary").alias("value"), meta["file_path"].alias("origin"),
        meta["file_modification_time"].alias("file_time"), meta["file_block_start"].alias("block"),
        meta["file_size"].alias("__size"), F.monotonically_increasing_id().alias("__at"))
    ranges = settle(lines.groupBy("origin", "block").agg(
        F.min("__at").alias("__first"), F.count("*").alias("__n"), F.max("__size").alias("__size"),
        F.sum(F.octet_length("value")).alias("__bytes")))
    mark = len(separator.encode())
    file, files = Window.partitionBy("origin"), Window.orderBy("origin", "block")
    over = F.col("__size") - F.sum("__bytes").over(file) - (F.sum("__n").over(file) - 1) * mark
    packed = F.col("origin").rlike(r"(?i)\.(gz|bz2|zst|lz4|snappy|deflate|xz)$")
    marked = ~packed & over.isin(len(BYTE_ORDER_MARK), len(BYTE_ORDER_MARK) + mark)

    def before(window: WindowSpec) -> Column:
        return F.coalesce(F.sum("__n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    counted = ranges.select(
        "origin", "block", "__first", "__n", marked.alias("__marked"),
        before(file.orderBy("block")).alias("__in_file"), before(files).alias("__in_all"))
    inside = at - first
    # The ranges were counted in a pass of their own; a file that changed since is an error.
    checked = F.when((inside >= 0) & (inside < F.col("__n")), inside).otherwise(
        F.raise_error(F.concat(F.lit("the file changed while it was read: "), F.col("origin"))).cast("long"))
    placed = lines.join(counted, ["origin", "block"]).withColumn("__inside", checked)
    line = F.col("__in_file") + F.col("__inside")
    return placed.select(
        F.when(F.col("__marked") & (line == 0), F.concat(F.lit(BYTE_ORDER_MARK), "value")).otherwise(F.col("value")).alias("value"),
        "origin", "file_time", "block", line.alias("line"), (F.col("__in_all") + F.col("__inside")).alias("place"))
