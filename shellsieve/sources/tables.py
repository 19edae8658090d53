"""Labelled commands, feature tables, models, and the union of entry sources."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shellsieve.schema import ENTRY, FEATURE_TABLE, LABELLED_COMMAND


def read_labelled(
    spark: SparkSession, path: str, fmt: str = "parquet", id_column: str = "id", **options
) -> DataFrame:
    """Columns ``id_column``, ``command`` and ``malicious`` from Parquet, CSV or JSON.

    The id names a row in folds and predictions, so a file without it is an error.
    """
    if fmt == "csv":
        options = {"header": "true", "multiLine": "true", "escape": '"', **options}
    kinds = dict(spark.read.format(fmt).options(**options).load(path).dtypes)
    if id_column not in kinds:
        raise ValueError(f"{path} has no column {id_column!r} to name its rows by; it has {sorted(kinds)}")
    schema = T.StructType([T.StructField(id_column, T.StringType()), *LABELLED_COMMAND.fields])
    if kinds[id_column] in ("int", "bigint"):
        schema[id_column].dataType = T.LongType() if kinds[id_column] == "bigint" else T.IntegerType()
    return spark.read.format(fmt).options(**options).schema(schema).load(path)


def write_features(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Features, label and command, and all other columns, such as an id and a fold."""
    known = FEATURE_TABLE.fieldNames()
    others = [c for c in df.columns if c not in known]
    df.select(*known, *others).write.mode(mode).parquet(path)


def read_features(spark: SparkSession, path: str, id_column: str = "id") -> DataFrame:
    """A stored feature table with the columns it was stored with."""
    table = spark.read.parquet(path)
    lacking = [c for c in (*FEATURE_TABLE.fieldNames(), id_column) if c not in table.columns]
    if lacking:
        raise ValueError(f"{path} lacks the columns {lacking}")
    return table


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def combine_sources(*sources: DataFrame | None) -> DataFrame:
    """All entries of the sources given, in that order; ``None`` means not acquired.

    ``source_no`` says which source an entry comes from; ``cmd_id`` counts within it, and
    the two together are unique.  Any number of sources can be united.
    """
    given = [
        df.select(*ENTRY.fieldNames(), F.lit(number).alias("source_no"))
        for number, df in enumerate(sources)
        if df is not None
    ]
    if not given:
        raise ValueError("at least one source of commands is required")
    return reduce(DataFrame.unionByName, given)
