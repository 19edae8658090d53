"""Script-block events from event logs that were exported as XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shellsieve.functions import text as X
from shellsieve.functions.times import display_event_time, event_time
from shellsieve.schema import SCRIPT_BLOCK_EVENT
from shellsieve.vocabulary import EVENT_SOURCE, SCRIPT_BLOCK_FIELD
from shellsieve.vocabulary import SCRIPT_BLOCK_EVENT as SCRIPT_BLOCK_ID


def script_block_entries(events: DataFrame, numbered: bool = True) -> DataFrame:
    """Entries from event records; every script text of an event is one entry.

    A stream cannot be ``numbered``.
    """
    time = F.col("System.TimeCreated._SystemTime")
    computer = F.col("System.Computer")
    blocks = (
        events.filter(F.col("System.EventID._VALUE") == SCRIPT_BLOCK_ID)
        .select(time.alias("time"), computer.alias("origin"), F.explode("EventData.Data").alias("data"))
        .filter(F.col("data._Name") == SCRIPT_BLOCK_FIELD)
        .filter(F.col("data._VALUE") != "")
    )
    command = X.strip(F.replace(F.col("data._VALUE"), F.lit("\n"), F.lit(" ")))
    return blocks.select(
        *([F.monotonically_increasing_id().alias("cmd_id")] if numbered else []),
        F.lit(EVENT_SOURCE).alias("source"),
        command.alias("command"),
        event_time(F.col("time")).alias("event_ts"),
        F.lit("event").alias("ts_note"),
        display_event_time(F.col("time")).alias("timestamp"),
        "origin",
    )


#: where a record ends; files are cut into tasks at any byte and read on to the next one
RECORD_END = "</Event>"
#: from the last record start of what stands before an end: an unclosed record before it stays out
_RECORD = r"(?s)^.*(<Event[\s>].*)$"


def read_event_xml(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Event records of XML files, on one line or over several.

    The record's end is the line end of the reader, so a file is split between tasks inside
    and every record is whole in one of them.  A record that cannot be read has null fields; it
    takes no other record with it, nor does one that is never closed.
    """
    return parse_records(spark.read.option("lineSep", RECORD_END).text(path))


def parse_records(chunks: DataFrame) -> DataFrame:
    """Event records from what stands before each record's end (``value``)."""
    options = {"rowTag": "Event", "ignoreSurroundingSpaces": "false"}
    records = chunks.select(F.regexp_extract("value", _RECORD, 1).alias("record")).filter("record <> ''")
    parsed = F.from_xml(F.concat("record", F.lit(RECORD_END)), SCRIPT_BLOCK_EVENT, options)
    return records.select(parsed.alias("event")).select("event.*")


def read_script_blocks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return script_block_entries(read_event_xml(spark, path))
