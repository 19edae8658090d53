"""The same scan over sources that keep growing.

Scoring keeps no state: every micro-batch is scored on its own, there is no watermark
and nothing to time out.  Histories, event exports, registry-value tables and whole scripts
can be watched, and united.  A stream cannot be sorted as a whole, so findings are stored as
they come and ranked when the stored table is read (``order_findings`` breaks ties by origin,
time, source and text where there is no ``cmd_id``); :func:`keep_ranking` also holds the best
``n`` after every batch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shellsieve.operators.results import TIE_BREAK, malicious_only, order_findings
from shellsieve.plans.hunt import VERDICT_COLUMNS, score_commands
from shellsieve.schema import ENTRY, REGISTRY_VALUE
from shellsieve.session import release_path
from shellsieve.sources.history import history_entries
from shellsieve.sources.registry import registry_entries
from shellsieve.sources.script_blocks import RECORD_END, parse_records, script_block_entries
from shellsieve.sources.scripts import script_entries, script_texts
from shellsieve.vocabulary import KEYWORDS


def watch_history(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Console histories that arrive in a folder, as a stream of entries."""
    lines = (
        spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(folder)
        .select("value", F.col("_metadata.file_modification_time").alias("file_time"),
                F.col("_metadata.file_path").alias("origin"))
    )
    return history_entries(lines, numbered=False)


def watch_events(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Event exports that arrive in a folder; records may run over several lines."""
    chunks = (
        spark.readStream.format("text").option("lineSep", RECORD_END)
        .option("maxFilesPerTrigger", files_per_batch).load(folder)
    )
    return script_block_entries(parse_records(chunks), numbered=False)


def watch_registry(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Registry-value tables (Parquet) that arrive in a folder."""
    values = spark.readStream.schema(REGISTRY_VALUE).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return registry_entries(values, numbered=False)


def watch_scripts(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Whole scripts that arrive in a folder; files of length zero are passed over."""
    whole = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(whole).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return script_entries(script_texts(files.select("path", "modificationTime", "content")), numbered=False)


def watch_all(*sources: DataFrame | None) -> DataFrame:
    """The streams given, united; ``source_no`` is a source's place among them."""
    names = [c for c in ENTRY.fieldNames() if c != TIE_BREAK]
    given = [
        df.select(*names, F.lit(number).alias("source_no")) for number, df in enumerate(sources) if df is not None]
    if not given:
        raise ValueError("at least one source of commands is required")
    return reduce(DataFrame.unionByName, given)


def stream_findings(
    entries: DataFrame,
    model: Transformer | None = None,
    base_score: Column | None = None,
    keywords: Mapping[str, Sequence[str]] = KEYWORDS,
) -> DataFrame:
    verdicts = score_commands(entries, model, base_score, keywords)
    return malicious_only(verdicts).select(*entries.columns, *VERDICT_COLUMNS)


def append_findings(
    findings: DataFrame, path: str, checkpoint: str, until_caught_up: bool = False
) -> StreamingQuery:
    """Append to Parquet; ``until_caught_up`` stops once the present input is done."""
    writer = (
        findings.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if until_caught_up else writer).start()


def _versions(spark: SparkSession, folder: str) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = [status.getPath().getName() for status in files.listStatus(path)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch="))


def keep_ranking(
    findings: DataFrame, path: str, checkpoint: str, n: int = 100, until_caught_up: bool = False
) -> StreamingQuery:
    """Store findings under ``path/findings`` and, after each batch, the best ``n`` so far.

    A batch has a folder of its own in both tables and replaces it, so a batch that runs again
    after a failure is stored once.  The ranking of a batch comes from the one before and the
    batch's own best, never from all that is stored; the last two rankings are kept.
    """
    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stored = f"{path}/findings/batch={number}"
        batch.write.mode("overwrite").parquet(stored)
        best = order_findings(spark.read.schema(batch.schema).parquet(stored)).limit(n)
        before = [v for v in _versions(spark, f"{path}/ranking") if v < number]
        if before:
            last = spark.read.schema(batch.schema).parquet(f"{path}/ranking/batch={before[-1]}")
            best = order_findings(last.unionByName(best)).limit(n)
        best.write.mode("overwrite").parquet(f"{path}/ranking/batch={number}")
        for old in before[:-1]:
            release_path(spark, f"{path}/ranking/batch={old}")

    writer = findings.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if until_caught_up else writer).start()


def read_ranking(spark: SparkSession, path: str) -> DataFrame:
    """The best findings after the last batch, in order."""
    batches = _versions(spark, f"{path}/ranking")
    if not batches:
        raise ValueError(f"no ranking is stored under {path}")
    return order_findings(spark.read.parquet(f"{path}/ranking/batch={batches[-1]}"))
