"""Time stamps: real timestamps inside, ``dd-MM-yyyy HH:mm:ss`` text at the edge.

The session is expected to run in UTC (see ``hunt_session``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shellsieve.functions.text import SPACE
from shellsieve.vocabulary import BAD_TIME, FILE_TIME_SUFFIX, NO_TIME

DISPLAY_FORMAT = "dd-MM-yyyy HH:mm:ss"
_EVENT_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"
_DISPLAY_SHAPE = r"^\d{1,2}-\d{1,2}-\d{4} \d{1,2}:\d{1,2}:\d{1,2}$"


def display_time(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, DISPLAY_FORMAT), F.lit(NO_TIME))


def display_time_text(text: Column) -> Column:
    """As ``display_time`` for times that arrive as text, which may not be times at all."""
    ts = F.try_to_timestamp(text)
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit(NO_TIME))
        .when(ts.isNull(), F.lit(BAD_TIME))
        .otherwise(F.date_format(ts, DISPLAY_FORMAT))
    )


def display_file_time(ts: Column) -> Column:
    return F.coalesce(
        F.concat(F.date_format(ts, DISPLAY_FORMAT), F.lit(FILE_TIME_SUFFIX)), F.lit(NO_TIME)
    )


def _parse(text: Column, shape: str, pattern: str) -> Column:
    even = F.regexp_replace(text, f"(?U){SPACE}+", " ")
    return F.when(even.rlike(shape), F.try_to_timestamp(even, F.lit(pattern)))


def event_time(text: Column) -> Column:
    """The time of an exported event, or null when it is not in the usual form."""
    plain = F.replace(F.replace(F.split_part(text, F.lit("."), F.lit(1)), F.lit("Z"), F.lit("")),
                      F.lit("T"), F.lit(" "))
    return _parse(plain, _EVENT_SHAPE, "yyyy-M-d H:m:s")


def display_event_time(text: Column) -> Column:
    raw = F.replace(F.split_part(text, F.lit("."), F.lit(1)), F.lit("T"), F.lit(" "))
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit(NO_TIME))
        .otherwise(F.coalesce(F.date_format(event_time(text), DISPLAY_FORMAT), raw))
    )


def shown_time(text: Column) -> Column:
    """Back from displayed text to a timestamp; null when there is none."""
    bare = F.btrim(F.replace(text, F.lit(FILE_TIME_SUFFIX), F.lit("")))
    return _parse(bare, _DISPLAY_SHAPE, "d-M-yyyy H:m:s")
