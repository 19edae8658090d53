"""Written tables in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from shellsieve.session import work_folder

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_shipped: set[str] = set()
#: folders made inside each open :func:`scratch`, the innermost last
_scopes: list[list[str]] = []


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables between jobs that are written inside go at the end.

    The operators' results read such tables, so write a result out before the end::

        with scratch(spark):
            exact_duplicates(docs).write.parquet("groups/")
    """
    _scopes.append([])
    try:
        yield
    finally:
        for folder in _scopes.pop():
            _delete(spark, folder)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs inside go when each job ends."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, *partitions: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a read, not the work before.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/steps/{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    with shuffles_dropped(spark):
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._shared_path = path
    return table


def spare(columns: list[str], *names: str) -> list[str]:
    """Column names that ``columns`` lacks: ``names``, underlined as often as it takes."""
    taken = {c.lower() for c in columns}
    lead = "_"
    while any((lead + n).lower() in taken for n in names):
        lead += "_"
    return [lead + n for n in names]


def discard(table: DataFrame) -> None:
    """Delete a table that :func:`written` made and nothing reads any more."""
    _delete(table.sparkSession, table._shared_path)


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application, as ``--py-files`` would.

    Arrow batches get a limit of some megabytes, so that a worker's memory follows neither
    the number nor the length of the texts; a limit that the session sets itself stays.
    """
    context = spark.sparkContext
    if spark.conf.get(_BATCH) == "67108864b":
        spark.conf.set(_BATCH, "8m")
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), "shellsieve.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    archive.write(file, os.path.relpath(file, os.path.dirname(root)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
