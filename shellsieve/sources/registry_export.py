"""Registry text exports (``.reg``) as registry values.

An export is a list of key headers and values; a value belongs to the header before it, may run
over several lines, and both may stand in different byte ranges of a file.  Lines are looked
at inside their range, which bounds every window; one row per range then carries the last
header, the last value's start and an open continuation on to the next range.  So a hive
of any size is read by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shellsieve.functions import text as X
from shellsieve.session import settle
from shellsieve.sources.positions import positioned_lines

#: UTF-16LE's line feed; exports are UTF-16 since version 5, one byte per sign before
_LINE_FEED = {"utf-16": "\n\x00", "utf-8": "\n"}
_HEADER = r"^\[-?(HKEY_[^\\\]]+)(?:\\(.*))?\]\s*$"
#: a named or the unnamed value; names escape quotes and backslashes
_VALUE = r"(?s)^(?:@|\"((?:[^\"\\]|\\.)*+)\")=(.*)$"
_START = r"^(?:\[-?HKEY_|@=|\"(?:[^\"\\]|\\.)*+\"=|;|Windows Registry Editor|REGEDIT4)"
#: hives of other users stand below a key that names the user
_USERS = "HKEY_USERS"
#: bytes of lines that a task takes, as they are in the file
TASK_BYTES = 64 << 20
#: bytes of a file whose ranges hand on what they carry among themselves
STRETCH = 1 << 24


def _text(encoding: str) -> Column:
    value = F.col("value")
    if encoding == "utf-16":
        decoded = X.lenient_utf16le(value)
    else:
        decoded = X.lenient_utf8(value)
    return F.regexp_replace(F.rtrim(decoded, F.lit("\r\n")), "^\ufeff", "")


def _unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _bytes_shown(data: Column) -> Column:
    """Bytes the way Python prints them: ``b'...'``."""
    digits = F.hex(data)
    units = F.regexp_extract_all(digits, F.lit(".."), F.lit(0))
    has_single, has_double = F.array_contains(units, "27"), F.array_contains(units, "22")
    quote = F.when(has_single & ~has_double, F.lit('"')).otherwise(F.lit("'"))

    def sign(unit: Column) -> Column:
        code = F.conv(unit, 16, 10).cast("int")
        return (
            F.when(unit == "5C", "\\\\").when(unit == "09", "\\t").when(unit == "0A", "\\n").when(unit == "0D", "\\r")
            .when((unit == "27") & (quote == "'"), "\\'").when((code >= 32) & (code < 127), F.char(code))
            .otherwise(F.concat(F.lit("\\x"), F.lower(unit))))

    return F.concat(F.lit("b"), quote, F.array_join(F.transform(units, sign), ""), quote)


def _strings_shown(data: Column) -> Column:
    """A list of texts the way Python prints one."""
    parts = F.filter(F.split(X.lenient_utf16le(data), "\x00"), lambda t: t != "")

    def shown(t: Column) -> Column:
        escaped = F.replace(t, F.lit("\\"), F.lit("\\\\"))
        single = F.concat(F.lit("'"), escaped, F.lit("'"))
        double = F.concat(F.lit('"'), escaped, F.lit('"'))
        both = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
        return F.when(~t.contains("'"), single).when(~t.contains('"'), double).otherwise(both)

    return F.concat(F.lit("["), F.array_join(F.transform(parts, shown), ", "), F.lit("]"))


def _data_text(data: Column) -> Column:
    """A value's data as text: strings as they are, numbers in decimal, bytes and lists as shown.

    Empty data of a typed value is null, a value that cannot be read is its text.
    """
    kind = F.regexp_extract(data, r"^hex(?:\(([0-9a-fA-F]+)\))?:", 1)
    digits = F.regexp_replace(F.regexp_extract(data, r"(?s)^hex(?:\([0-9a-fA-F]+\))?:(.*)$", 1), r"[^0-9a-fA-F]", "")
    raw = F.try_to_binary(digits, F.lit("hex"))
    backwards = F.array_join(F.reverse(F.regexp_extract_all(digits, F.lit(".."), F.lit(0))), "")
    is_hex = data.rlike(r"^hex(\([0-9a-fA-F]+\))?:")
    text = F.regexp_replace(X.lenient_utf16le(raw), "\x00+$", "")
    return (
        F.when(data.rlike(r'(?s)^".*"$'), _unescaped(F.regexp_extract(data, r'(?s)^"(.*)"$', 1)))
        .when(data.rlike(r"^dword:[0-9a-fA-F]{1,8}$"), F.conv(F.substring(data, 7, 8), 16, 10))
        .when(is_hex & (digits == ""), F.lit(None).cast("string"))
        .when(is_hex & kind.isin("1", "2"), text)
        .when(is_hex & (kind == "7"), _strings_shown(raw))
        .when(is_hex & kind.isin("4", "b"), F.conv(backwards, 16, 10))
        .when(is_hex & raw.isNotNull(), _bytes_shown(raw))
        .otherwise(data))


def _carried(ends: DataFrame, **last: Column) -> DataFrame:
    """``ends`` (one row per range) with, of the ranges before, the last non-null value of each column.

    Ranges are looked at inside stretches of a file, and one row per stretch carries on: no
    window holds all ranges of a file.
    """
    told = ends.withColumns({f"own_{n}": c for n, c in last.items()}).withColumn("stretch", F.floor(F.col("block") / STRETCH))
    stretches = told.groupBy("origin", "stretch").agg(*[
        F.max_by(f"own_{n}", F.when(F.col(f"own_{n}").isNotNull(), F.coalesce("block", F.lit(-1)))).alias(f"own_{n}") for n in last])
    file = Window.partitionBy("origin").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = stretches.select(F.col("origin").alias("__origin"), F.col("stretch").alias("__stretch"), *[
        F.last(f"own_{n}", ignorenulls=True).over(file).alias(f"before_{n}") for n in last])
    inside = Window.partitionBy("origin", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    near = told.withColumns({f"near_{n}": F.last(f"own_{n}", ignorenulls=True).over(inside) for n in last})
    same = F.col("origin").eqNullSafe(F.col("__origin")) & F.col("stretch").eqNullSafe(F.col("__stretch"))
    return near.join(before, same).select(
        *ends.columns, *[F.coalesce(f"near_{n}", f"before_{n}").alias(f"carried_{n}") for n in last])


def export_values(lines: DataFrame, encoding: str = "utf-16") -> DataFrame:
    """Registry values from :func:`positioned_lines`; the columns of ``REGISTRY_VALUE``.

    Keys lose their root: ``HKEY_CURRENT_USER\\Software\\X`` is ``Software\\X`` of the file's
    hive, and the users' hives of an export are told apart by their key.  Exports have no key
    times.  Deletions (``"name"=-``, ``[-key]``) are no values.
    """
    rows = lines.select("origin", "block", "line", F.octet_length("value").alias("bytes"), _text(encoding).alias("text"))
    # Only data in hex digits goes on after a backslash; a string ends with a quote.
    rows = rows.withColumns({
        "open": F.col("text").rlike(r"(?i)^(?:\s|.*=hex|[0-9a-f]{2},).*\\$"),
        "starts": F.col("text").rlike(_START),
        "header": F.when(F.col("text").rlike(_HEADER), F.col("text"))})
    inside = Window.partitionBy("origin", "block").orderBy("line")
    running = inside.rowsBetween(Window.unboundedPreceding, 0)

    def started(rows: DataFrame) -> DataFrame:
        """Start and key of a line, if the ranges before leave nothing open (``0``) and if they do (``1``)."""
        rows = rows.withColumn("goes_on", F.lag("open").over(inside))
        for n, carried in enumerate((False, True)):
            start = F.col("starts") & ~F.coalesce("goes_on", F.lit(carried))
            rows = rows.withColumns({f"start{n}": F.when(start, F.col("line")), f"key{n}": F.when(start, F.col("header"))})
        return rows

    def last(column: str) -> Column:
        return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("line"))).alias(column)

    # Lines without their texts tell what every range hands on.
    either = ("start0", "start1", "key0", "key1")
    ends = settle(started(rows.drop("text")).groupBy("origin", "block").agg(
        *map(last, ("open", *either)), F.sum("bytes").alias("bytes")))
    ends = _carried(ends, open=F.col("open"))
    goes_on = F.coalesce("carried_open", F.lit(False))
    ends = _carried(ends, **{n: F.when(goes_on, F.col(f"{n}1")).otherwise(F.col(f"{n}0")) for n in ("start", "key")})
    carried = ends.select("origin", "block", "carried_open", "carried_start", "carried_key")
    # Texts of few signs shrink in an exchange, so tasks are counted by the bytes of the lines.
    parts = max(lines.sparkSession.sparkContext.defaultParallelism, (ends.agg(F.sum("bytes")).first()[0] or 0) // TASK_BYTES + 1)
    placed = started(rows.drop("bytes").repartition(parts, "origin", "block")).withColumns(
        {n: F.last(n, ignorenulls=True).over(running) for n in either})
    placed = placed.drop("starts", "header", "goes_on").join(carried, ["origin", "block"], "left")
    told = placed.select(
        "origin", "line", "text", "open",
        *[F.coalesce(F.when(goes_on, F.col(f"{n}1")).otherwise(F.col(f"{n}0")), F.col(f"carried_{n}")).alias(as_)
          for n, as_ in (("start", "entry"), ("key", "key"))])
    # The lines of one value; hex digits close up, other texts keep their line ends.
    piece = F.struct("line", F.when(F.col("open"), F.regexp_replace("text", r"\\$", "")).otherwise(
        F.concat(F.col("text"), F.lit("\n"))).alias("text"))
    whole = told.filter("entry IS NOT NULL AND key IS NOT NULL").repartition(parts, "origin", "entry").groupBy("origin", "entry").agg(
        F.max("key").alias("key"), F.array_join(F.sort_array(F.collect_list(piece))["text"], "").alias("text"))
    value = whole.withColumn("text", F.rtrim("text", F.lit("\r\n"))).filter(F.col("text").rlike(_VALUE)).select(
        "origin", "entry", F.regexp_extract("key", _HEADER, 1).alias("root"), F.regexp_extract("key", _HEADER, 2).alias("path"),
        "key", F.when(~F.col("text").startswith("@"), _unescaped(F.regexp_extract("text", _VALUE, 1))).alias("value_name"),
        F.regexp_extract("text", _VALUE, 2).alias("data"))
    kept = value.filter((F.col("data") != "-") & ~F.col("key").startswith("[-"))
    of_user = F.col("root") == _USERS
    user = F.when(of_user, F.substring_index("path", "\\", 1))
    path = F.when(of_user, F.regexp_extract("path", r"^[^\\]*\\(.*)$", 1)).otherwise(F.col("path"))
    return kept.select(
        F.concat_ws("#", "origin", user).alias("hive_id"), path.alias("key_path"), F.lit(None).cast("timestamp").alias("key_ts"),
        "value_name", _data_text(F.col("data")).alias("value_data"))


def read_registry_export(spark: SparkSession, path: str | list[str], encoding: str = "utf-16") -> DataFrame:
    """Values of ``.reg`` files, for ``registry_entries``; ``encoding`` is utf-16 or utf-8."""
    if encoding not in _LINE_FEED:
        raise ValueError(f"an export is in {' or '.join(_LINE_FEED)}, not {encoding!r}")
    return export_values(positioned_lines(spark, path, _LINE_FEED[encoding]), encoding)
