"""Registry values of user hives, as a table with one row per value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellsieve.functions import text as X
from shellsieve.functions.times import display_time, display_time_text
from shellsieve.vocabulary import (
    NO_DATA,
    PERSISTENCE_KEYS,
    PERSISTENCE_SOURCE,
    SKIPPED_STORAGE,
    STORAGE_LENGTH,
    STORAGE_ROOT,
    STORAGE_SOURCE,
    STORAGE_WORDS,
    UNNAMED_VALUE,
)


def is_persistence() -> Column:
    """Values directly below an autostart key; key names compare without case."""
    return F.lower("key_path").isin(*PERSISTENCE_KEYS)


def storage_key() -> Column:
    """Name of the key if it lies directly below the software root, else null."""
    parts = F.split("key_path", "\\\\")
    return F.when(
        (F.size(parts) == 2) & (F.lower(parts.getItem(0)) == STORAGE_ROOT), parts.getItem(1)
    )


def is_storage() -> Column:
    """Long or script-like values below keys that are not the system's own."""
    data = value_text()
    script_like = X.contains_any(F.lower(data), STORAGE_WORDS)
    return ~storage_key().isin(*SKIPPED_STORAGE) & (
        (F.length(data) > STORAGE_LENGTH) | script_like
    )


def value_text() -> Column:
    """The value as text; a value without data reads as the fixed text for nothing."""
    return F.coalesce(F.col("value_data"), F.lit(NO_DATA))


def _entries(values: DataFrame, source: Column, numbered: bool = True) -> DataFrame:
    """``source`` is null for the values that are not entries; a stream cannot be ``numbered``."""
    as_text = dict(values.dtypes)["key_ts"] == "string"
    shown = display_time_text(F.col("key_ts")) if as_text else display_time(F.col("key_ts"))
    stamp = F.try_to_timestamp("key_ts") if as_text else F.col("key_ts")
    return values.withColumn("source", source).filter(F.col("source").isNotNull()).select(
        *([F.monotonically_increasing_id().alias("cmd_id")] if numbered else []),
        "source",
        value_text().alias("command"),
        stamp.alias("event_ts"),
        F.lit("key").alias("ts_note"),
        shown.alias("timestamp"),
        F.col("hive_id").alias("origin"),
    )


def _value_name() -> Column:
    return F.coalesce(F.col("value_name"), F.lit(UNNAMED_VALUE))


def _persistence_source() -> Column:
    return F.format_string(PERSISTENCE_SOURCE, _value_name())


def _storage_source() -> Column:
    return F.format_string(STORAGE_SOURCE, storage_key(), _value_name())


def persistence_entries(values: DataFrame) -> DataFrame:
    return _entries(values, F.when(is_persistence(), _persistence_source()))


def storage_entries(values: DataFrame) -> DataFrame:
    return _entries(values, F.when(is_storage(), _storage_source()))


def registry_entries(values: DataFrame, numbered: bool = True) -> DataFrame:
    """Both kinds from one pass; no value can be of both."""
    return _entries(
        values,
        F.when(is_persistence(), _persistence_source()).when(is_storage(), _storage_source()),
        numbered,
    )
