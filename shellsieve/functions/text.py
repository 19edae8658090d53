"""Text functions over columns: cleaning, statistics and de-obfuscation.

All but the entropy are compositions of built-in expressions and stay in the JVM.
Counted repetitions in patterns are possessive: Java matches greedy ones by recursion
when characters of different width alternate, and hostile text could exhaust the stack.
Arguments that are used more than once should be plain columns, not expressions:
callers add them with ``withColumn`` first, so that Catalyst evaluates them once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shellsieve.vocabulary import (
    CHAR_CODE_MARK,
    DECIMAL_DIGITS,
    DECIMAL_VALUES,
    MIN_PAYLOAD_TEXT,
    PREVIEW_LENGTH,
    WHITESPACE,
)

# Java's Unicode \s lacks the four information separators.
SPACE = r"[\s\x1c-\x1f]"
# Java's Unicode \w also takes combining marks; a word character here is not one.
WORD = r"[\p{L}\p{N}_]"
REPLACEMENT = "�"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def contains_any(text: Column, words: Iterable[str]) -> Column:
    return reduce(or_, (text.contains(word) for word in words))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


# --- cleaning ----------------------------------------------------------------------

def single_line(text: Column) -> Column:
    """Every run of white space becomes one blank; none is left at the ends."""
    return F.btrim(F.regexp_replace(text, f"(?U){SPACE}+", " "))


def dataset_clean(text: Column, limit: int | None = None) -> Column:
    """Drop control characters other than tab and line ends.

    ``limit`` cuts the text to that many characters, as a spreadsheet cell does
    (``DATASET_TEXT_LIMIT``); without it the text stays whole.
    """
    kept = F.regexp_replace(
        F.coalesce(text, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f]+", ""
    )
    return kept if limit is None else F.substring(kept, 1, limit)


def unix_line_ends(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def drop_invalid_utf8(text: Column) -> Column:
    """Leave out undecodable bytes.

    Invalid bytes turn into U+FFFD first, so a genuine U+FFFD is set aside as an
    escape sequence and put back at the end.
    """
    escaped = F.replace(F.replace(text, F.lit("\x01"), F.lit("\x01a")),
                        F.lit(REPLACEMENT), F.lit("\x01b"))
    valid = F.replace(F.make_valid_utf8(escaped), F.lit(REPLACEMENT), F.lit(""))
    restored = F.replace(F.replace(valid, F.lit("\x01b"), F.lit(REPLACEMENT)),
                         F.lit("\x01a"), F.lit("\x01"))
    return F.when(F.is_valid_utf8(text), text).otherwise(restored)


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def preview(text: Column) -> Column:
    return F.when(
        F.length(text) > PREVIEW_LENGTH,
        F.concat(F.substring(text, 1, PREVIEW_LENGTH), F.lit("...")),
    ).otherwise(text)


# --- statistics --------------------------------------------------------------------

def char_entropy(text: Column) -> Column:
    """Shannon entropy in bits over the characters of ``text``; 0 for empty and null text.

    Counts need every character once.  Built-in expressions would need an array of all
    characters or a pass per distinct one, so this is the one step that runs on Arrow
    batches, with the code points of a text as one numpy array: one route for all lengths.
    """
    # An inner function travels to the workers by value: they need numpy, not this package.
    @F.pandas_udf(T.DoubleType())
    def entropy(texts: pd.Series) -> pd.Series:
        bits = np.zeros(len(texts))
        for i, value in enumerate(texts):
            if value:
                points = np.frombuffer(value.encode("utf-32-le"), np.uint32)
                low = points < 256
                counts = np.bincount(points[low], minlength=256)
                if not low.all():
                    counts = np.append(counts, np.unique(points[~low], return_counts=True)[1])
                share = counts[counts > 0] / len(points)
                bits[i] = max(0.0, -(share * np.log2(share)).sum())
        return pd.Series(bits)

    return entropy(text)


def entropy_log_length(text: Column) -> Column:
    return char_entropy(text) * F.log1p(F.length(text))


def upper_case_ratio(text: Column) -> Column:
    others = F.regexp_replace(text, r"\p{IsUppercase}+", "")
    length = F.length(text)
    return F.when(length > 0, (length - F.length(others)) / length).otherwise(F.lit(0.0))


# --- hidden payloads ---------------------------------------------------------------

# A token always starts where a run of base64 characters starts: the look-behind
# keeps the search linear inside runs that are too short.
_BASE64_TOKEN = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}+={0,2}"

# UTF-16LE as hex digits: a unit outside the surrogates, or a high and a low
# surrogate; whatever else comes next (a lone surrogate, an odd last byte) goes.
_UTF16_UNIT = (
    r"([0-9A-F]{2}(?:[0-9A-CEF][0-9A-F]|D[0-7])"
    r"|[0-9A-F]{2}D[89AB][0-9A-F]{2}D[C-F])"
    r"|[0-9A-F]{1,4}"
)


def lenient_base64(token: Column) -> Column:
    """Bytes of a base64 token, or null when its padding does not fit.

    Surplus padding after complete groups is ignored; missing padding is an error.
    """
    data = F.rtrim(token, F.lit("="))
    pads = F.length(token) - F.length(data)
    tail = F.length(data) % 4
    complete = (
        F.when(tail == 0, data)
        .when((tail == 2) & (pads == 2), F.concat(data, F.lit("==")))
        .when((tail == 3) & (pads >= 1), F.concat(data, F.lit("=")))
    )
    return F.try_to_binary(complete, F.lit("base64"))


def lenient_utf16le(data: Column) -> Column:
    units = F.regexp_replace(F.hex(data), _UTF16_UNIT, "$1")
    return F.decode(F.unhex(units), "UTF-16LE")


def lenient_utf8(data: Column) -> Column:
    return drop_invalid_utf8(data.cast("string"))


def _long_enough(text: Column) -> Column:
    """More than five characters are left once the ends are stripped."""
    return F.length(strip(text)) > MIN_PAYLOAD_TEXT


def base64_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_BASE64_TOKEN), F.lit(0))


def hidden_payload(tokens: Column) -> Column:
    """Readings of base64 tokens, each after a blank; empty when there are none."""
    decoded = F.filter(F.transform(tokens, lenient_base64), lambda data: data.isNotNull())
    readings = F.flatten(F.transform(
        decoded, lambda data: F.array(lenient_utf16le(data), lenient_utf8(data))
    ))
    joined = F.concat_ws(
        "", F.transform(
            F.filter(readings, _long_enough), lambda reading: F.concat(F.lit(" "), reading)
        )
    )
    return F.when(F.size(tokens) > 0, joined).otherwise(F.lit(""))


def with_payload(text: Column, payload: Column) -> Column:
    return F.when(payload != "", F.concat(text, F.lit(" "), payload)).otherwise(text)


# --- normalising -------------------------------------------------------------------

def join_split_literals(text: Column) -> Column:
    """``"a" + "b"`` reads ``"ab"``."""
    joined = F.regexp_replace(text, f"(?U)[\"']{SPACE}*+\\+{SPACE}*+[\"']", "")
    return F.when(text.contains("+"), joined).otherwise(text)


def _code_point(number: Column) -> Column:
    """The character with a decimal code, or null when there is none.

    A surrogate code has no character of its own in valid text; it reads U+FFFD.
    """
    ascii_digits = F.translate(number, DECIMAL_DIGITS, DECIMAL_VALUES)
    return bind(
        ascii_digits.try_cast("int"),
        lambda code: F.when(code.between(0xD800, 0xDFFF), F.lit(REPLACEMENT)).when(
            code <= 0x10FFFF,
            F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"),
        ),
    )


def resolve_char_codes(text: Column) -> Column:
    """Replace ``[char]N`` and ``[char] N`` by the character, code by code as found."""
    codes = F.regexp_extract_all(
        text, F.lit(f"(?iU)\\[char\\]{SPACE}*(\\d+)"), F.lit(1)
    )

    def substitute(state: Column, number: Column) -> Column:
        def put(char: Column) -> Column:
            glued = F.replace(state["text"], F.concat(F.lit(CHAR_CODE_MARK), number), char)
            spaced = F.replace(glued, F.concat(F.lit(CHAR_CODE_MARK + " "), number), char)
            return F.coalesce(spaced, state["text"])

        return F.when(state["open"], bind(bind(_code_point(number), put), keep)).otherwise(state)

    # Once no literal mark is left, no later code can change anything: the rest of
    # the list is passed over without scanning the text again.
    def keep(current: Column) -> Column:
        return F.struct(
            current.alias("text"), current.rlike(r"(?U)\[char\] ?\d").alias("open")
        )

    resolved = F.aggregate(
        codes,
        F.struct(text.alias("text"), F.lit(True).alias("open")),
        substitute,
        lambda state: state["text"],
    )
    return F.when(text.contains("["), resolved).otherwise(text)


def fold_quotes_and_case(text: Column) -> Column:
    bare = reduce(lambda t, mark: F.replace(t, F.lit(mark), F.lit("")), "`\"'", text)
    return F.lower(bare)


# --- layout ------------------------------------------------------------------------

def readable_layout(text: Column) -> Column:
    """One statement per paragraph, indented by open braces."""
    def pad(level: Column) -> Column:
        return F.repeat(F.lit("    "), level)

    statements = F.filter(F.transform(F.split(text, ";"), strip), lambda s: s != "")

    def add(state: Column, statement: Column) -> Column:
        level = state["level"]
        opens, closes = statement.contains("{"), statement.contains("}")
        inside = F.when(opens, level + 1).otherwise(level)
        after = F.when(closes, F.greatest(inside - 1, F.lit(0))).otherwise(inside)
        broken = F.replace(
            statement, F.lit(" | "), F.concat(F.lit("\n"), pad(level + 1), F.lit("| "))
        )
        opened = F.replace(broken, F.lit("{"), F.concat(F.lit("{\n"), pad(level + 1)))
        closed = F.when(
            closes,
            F.replace(opened, F.lit("}"), F.concat(F.lit("\n"), pad(after), F.lit("}"))),
        ).otherwise(opened)
        return F.struct(
            after.alias("level"),
            F.concat(
                state["laid"], F.when(state["laid"] == "", F.lit("")).otherwise(F.lit("\n\n")),
                pad(after), closed, F.lit(";"),
            ).alias("laid"),
        )

    return F.aggregate(
        statements,
        F.struct(F.lit(0).alias("level"), F.lit("").alias("laid")),
        add,
        lambda state: state["laid"],
    )
