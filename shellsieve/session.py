"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_temporary: dict[str, str] = {}


def hunt_session(
    name: str = "shellsieve", master: str | None = None, work_dir: str | None = None, **conf: str
) -> SparkSession:
    """A session in UTC with adaptive execution; anything else is left to the cluster.

    ``work_dir`` is where tables between jobs are written (``spark.checkpoint.dir``); on a
    cluster it has to be a folder that all executors share.
    """
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if work_dir:
        conf = {"spark.checkpoint.dir": work_dir, **conf}
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """The shared folder for tables between jobs: ``spark.checkpoint.dir``.

    Without it a cluster session is an error.  A session in one process, which shares its
    disk with itself, gets a folder that goes when the process ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir (work_dir) to a folder that all executors share")
    if context.applicationId not in _temporary:
        made = tempfile.mkdtemp(prefix="shellsieve-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _temporary[context.applicationId] = made
    return _temporary[context.applicationId]


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` out once as Parquet, so that later jobs read columns instead of recomputing.

    A lost executor costs a read, not the work before.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/settled/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._settled_path = path
    return table


def release_path(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(table: DataFrame) -> None:
    """Delete what :func:`settle` wrote, once nothing reads it any more."""
    release_path(table.sparkSession, table._settled_path)
