"""Schemas of the tables that go in and come out."""

from __future__ import annotations

from pyspark.sql import types as T

from shellsieve.vocabulary import FEATURE_COLUMNS, STATISTICAL_COLUMNS

ENTRY = T.StructType([
    T.StructField("cmd_id", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("command", T.StringType()),
    T.StructField("event_ts", T.TimestampType()),
    T.StructField("ts_note", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    # Where the entry was found: file, hive or computer.
    T.StructField("origin", T.StringType()),
])

SCRIPT_BLOCK_EVENT = T.StructType([
    T.StructField("System", T.StructType([
        T.StructField("EventID", T.StructType([T.StructField("_VALUE", T.StringType())])),
        T.StructField(
            "TimeCreated", T.StructType([T.StructField("_SystemTime", T.StringType())])
        ),
        T.StructField("Computer", T.StringType()),
    ])),
    T.StructField("EventData", T.StructType([
        T.StructField("Data", T.ArrayType(T.StructType([
            T.StructField("_Name", T.StringType()),
            T.StructField("_VALUE", T.StringType()),
        ]))),
    ])),
])

REGISTRY_VALUE = T.StructType([
    T.StructField("hive_id", T.StringType()),
    T.StructField("key_path", T.StringType()),
    T.StructField("key_ts", T.TimestampType()),
    T.StructField("value_name", T.StringType()),
    T.StructField("value_data", T.StringType()),
])

LABELLED_COMMAND = T.StructType([
    T.StructField("command", T.StringType()),
    T.StructField("malicious", T.IntegerType()),
])

FEATURE_TABLE = T.StructType(
    [
        T.StructField(
            name, T.DoubleType() if name in STATISTICAL_COLUMNS else T.IntegerType()
        )
        for name in FEATURE_COLUMNS
    ]
    + [T.StructField("malicious", T.IntegerType()), T.StructField("command", T.StringType())]
)
