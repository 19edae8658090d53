"""Whole scripts: one file is one command."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shellsieve.functions import text as X
from shellsieve.functions.times import display_file_time
from shellsieve.vocabulary import SCRIPT_SOURCE


def read_scripts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path``, ``content`` and ``file_time``; line ends are folded to line feeds.

    Spark's file sources pass over files of length zero; those are listed here and give a
    row with empty content (their hash is on the built-in trusted list).
    """
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime", "content")
    empty = _empty_files(spark, [path] if isinstance(path, str) else path)
    if empty:
        rows = spark.createDataFrame(empty, "path string, millis long").select(
            "path", F.timestamp_millis("millis").alias("modificationTime"), F.lit(b"").alias("content")
        )
        files = files.unionByName(rows)
    return script_texts(files)


def script_texts(files: DataFrame) -> DataFrame:
    """``path``, ``content`` and ``file_time`` of whole files, read as bytes."""
    text = X.drop_invalid_utf8(F.col("content").cast("string"))
    return files.select(
        "path",
        X.unix_line_ends(text).alias("content"),
        F.col("modificationTime").alias("file_time"),
    )


def _empty_files(spark: SparkSession, paths: list[str]) -> list[tuple[str, int]]:
    """Path and time of the files of length zero that the paths or patterns name.

    A folder's own files count, hidden ones do not, as in Spark's file sources.
    """
    found, hadoop = [], spark._jvm.org.apache.hadoop.fs
    for path in paths:
        pattern = hadoop.Path(path)
        system = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
        named = list(system.globStatus(pattern) or [])
        inside = [f for s in named if s.isDirectory() for f in system.listStatus(s.getPath())]
        for status in [s for s in named if not s.isDirectory()] + [s for s in inside if s.isFile()]:
            name = status.getPath().getName()
            if status.getLen() == 0 and not name.startswith((".", "_")):
                found.append((status.getPath().toString(), status.getModificationTime()))
    return found


def script_entries(scripts: DataFrame, numbered: bool = True) -> DataFrame:
    """Scripts as command entries; other columns are kept.  A stream cannot be ``numbered``."""
    return scripts.select(
        *([F.monotonically_increasing_id().alias("cmd_id")] if numbered else []),
        F.lit(SCRIPT_SOURCE).alias("source"),
        F.col("content").alias("command"),
        F.col("file_time").alias("event_ts"),
        F.lit("file").alias("ts_note"),
        display_file_time(F.col("file_time")).alias("timestamp"),
        F.col("path").cast("string").alias("origin"),
        *[c for c in scripts.columns if c not in ("content", "file_time", "origin")],
    )
