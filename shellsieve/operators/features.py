"""The 23 numeric features of a command.

The work is laid out in layers, one projection each: payload, match text, keyword
flags, combinations, alerts, density.  A layer's results are used several times by
the next, so Catalyst keeps the layers apart and evaluates every one of them once
per row; the last is sealed, so that filters on a flag do not undo this.  There is no
shuffle and no Python in the whole chain.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellsieve.functions import text as X
from shellsieve.operators.barrier import seal
from shellsieve.vocabulary import (
    CHAR_CODE_MARK,
    DETAIL_COLUMNS,
    FEATURE_COLUMNS,
    FLAG_COLUMNS,
    KEYWORDS,
)

MATCH_TEXT = "match_text"
ENTROPY = "entropy_log_length"
HELPERS = ("has_crypto", "has_file_mod", "has_discovery")

_CONCATENATION = (
    rf"(?U)\${X.WORD}++{X.SPACE}*+\+{X.SPACE}*+\${X.WORD}"
    rf"|[\"']{X.WORD}{{1,3}}[\"']{X.SPACE}*+\+{X.SPACE}*+[\"']{X.WORD}{{1,3}}[\"']"
)


def _with_match_text(df: DataFrame, text: str) -> DataFrame:
    steps = (
        ("__tokens", X.base64_tokens(F.col(text))),
        ("__payload", X.hidden_payload(F.col("__tokens"))),
        ("__full", X.with_payload(F.col(text), F.col("__payload"))),
        ("__joined", X.join_split_literals(F.col("__full"))),
        ("__resolved", X.resolve_char_codes(F.col("__joined"))),
        (MATCH_TEXT, X.fold_quotes_and_case(F.col("__resolved"))),
    )
    for name, value in steps:
        df = df.withColumn(name, value)
    return df.drop("__tokens", "__payload", "__full", "__joined", "__resolved")


def add_match_text(df: DataFrame, text: str) -> DataFrame:
    """Add the de-obfuscated lower-case text that keywords are looked for in."""
    return seal(_with_match_text(df, text), [MATCH_TEXT])


def keyword_flags(
    text: Column, match: Column, keywords: Mapping[str, Sequence[str]] = KEYWORDS
) -> dict[str, Column]:
    """Flags that depend on the texts alone, as boolean columns."""
    def found(name: str) -> Column:
        return X.contains_any(match, keywords[name])

    download = found("download") & (~found("download_folder") | found("download_method"))
    return {
        "has_encoded": found("has_encoded"),
        "has_iex": found("has_iex"),
        "has_bypass": found("has_bypass"),
        "has_web_request": found("web") | download,
        "has_api_calls": found("has_api_calls"),
        "has_persistence": found("has_persistence"),
        "has_hidden_window": found("has_hidden_window"),
        "has_reflection": found("has_reflection"),
        "has_lolbins": found("has_lolbins"),
        "has_char_code": text.contains("[") & F.lower(text).contains(CHAR_CODE_MARK),
        "has_string_manipulation": text.contains("+") & text.rlike(_CONCATENATION),
        "api_virtualalloc": found("api_virtualalloc"),
        "api_createremotethread": found("api_createremotethread"),
        "has_dllimport": found("has_dllimport"),
        "has_vss_purge": found("shadow_copy") & found("delete"),
        "critical_evasion_alert": found("critical_evasion_alert"),
        "has_crypto": found("crypto"),
        "has_file_mod": found("file_mod"),
        "has_discovery": found("discovery"),
    }


def combination_flags() -> dict[str, Column]:
    """Flags over the boolean keyword flags."""
    c = F.col
    return {
        "combo_stealth_exploit": c("has_reflection") & (c("has_api_calls") | c("has_char_code")),
        "combo_bypass_base64": c("has_encoded") & c("has_bypass"),
        "combo_ransomware_logic": c("has_crypto") & (c("has_discovery") | c("has_file_mod")),
    }


def ransomware_alert() -> Column:
    c = F.col
    return (c("has_vss_purge") & c("combo_ransomware_logic")) | (
        c("has_crypto") & c("has_discovery") & c("has_file_mod")
    )


def add_features(
    df: DataFrame,
    text: str = "command",
    keywords: Mapping[str, Sequence[str]] = KEYWORDS,
    helpers: bool = False,
) -> DataFrame:
    """Add ``FEATURE_COLUMNS``, in that order, to a frame with a text column.

    ``helpers`` also keeps the match text and the three flags that only feed others.
    """
    keep = df.columns
    matched = _with_match_text(df, text)
    raw, match = F.col(text), F.col(MATCH_TEXT)
    flagged = matched.select(
        *keep,
        *([MATCH_TEXT] if helpers else []),
        X.upper_case_ratio(raw).alias("upper_case_ratio"),
        *[flag.alias(name) for name, flag in keyword_flags(raw, match, keywords).items()],
    )
    combined = flagged.withColumns(combination_flags())
    alerted = combined.withColumn("critical_ransomware_alert", ransomware_alert())
    numeric = alerted.withColumns(
        {name: F.col(name).cast("int") for name in (*FLAG_COLUMNS, *HELPERS)}
    )
    dense = numeric.withColumn("danger_density", reduce(add, map(F.col, FLAG_COLUMNS)))
    extra = (MATCH_TEXT, *HELPERS) if helpers else ()
    sealed = (*(c for c in FEATURE_COLUMNS if c != ENTROPY), *extra)
    flags = seal(dense.select(*keep, *sealed), sealed)
    return flags.withColumn(ENTROPY, X.entropy_log_length(raw)).select(*keep, *FEATURE_COLUMNS, *extra)


def feature_frame(df: DataFrame) -> DataFrame:
    """Only the features, in the model's order; missing columns and nulls are 0."""
    return df.select(*[
        (F.coalesce(F.col(name), F.lit(0)) if name in df.columns else F.lit(0))
        .cast("double").alias(name)
        for name in FEATURE_COLUMNS
    ])


def active_flags(names: Sequence[str]) -> Column:
    """Names of the flags that are set, in order."""
    return F.array_compact(F.array(*[F.when(F.col(n) == 1, F.lit(n)) for n in names]))


def feature_details() -> Column:
    """Map of the features that are not plain behaviour flags, rounded to 4 digits."""
    pairs = [
        part
        for name in DETAIL_COLUMNS
        for part in (F.lit(name), F.round(F.col(name).cast("double"), 4))
    ]
    return F.create_map(*pairs)
