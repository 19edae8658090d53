"""Text functions against plain Python, on cases SQL cannot express."""

import base64
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shellsieve.functions import text as X
from shellsieve.operators.features import MATCH_TEXT, add_features, add_match_text


def apply(spark, values, function, schema="i int, value string"):
    frame = spark.createDataFrame(list(enumerate(values)), schema).repartition(8)
    rows = frame.select("i", function(F.col("value")).alias("out")).collect()
    return [row.out for row in sorted(rows, key=lambda row: row.i)]


def decoded(token):
    """Readings of one token in plain Python, by hand-checked padding."""
    data = token.rstrip("=")
    pads, tail = len(token) - len(data), len(data) % 4
    if tail == 1 or (tail == 2 and pads < 2) or (tail == 3 and pads < 1):
        return []
    raw = base64.b64decode(data + "=" * (-len(data) % 4))
    return [raw.decode("utf-16-le", "ignore"), raw.decode("utf-8", "ignore")]


def payload(text):
    found = re.findall(r"[A-Za-z0-9+/]{40,}={0,2}", text)
    return "".join(" " + t for token in found for t in decoded(token) if len(t.strip()) > 5)


def storable(text):
    try:
        text.encode("utf-8")
    except UnicodeEncodeError:
        return False
    return True


def test_white_space_of_every_kind(spark):
    texts = [f"a{chr(c)}{chr(c)} b{chr(c)}" for c in range(1, 0x3002)]
    assert apply(spark, texts, X.single_line) == [" ".join(t.split()) for t in texts]
    assert apply(spark, texts, X.strip) == [t.strip() for t in texts]


def test_dataset_text(spark):
    texts = ["".join(map(chr, range(40))), None, "x" * 32_001, "\x07" * 10 + "é" * 32_000]
    kept = "\t\n\r" + "".join(map(chr, range(32, 40)))
    assert apply(spark, texts, X.dataset_clean) == [kept, "", "x" * 32_001, "é" * 32_000]
    cut = apply(spark, texts, lambda c: X.dataset_clean(c, 32_000))
    assert cut == [kept, "", "x" * 32_000, "é" * 32_000]


def test_entropy_of_random_texts(spark):
    rng = random.Random(1)
    alphabet = "ab \né€漢😀Zz09\"\\"
    texts = ["", "a", "aaaa", "😀😀é", "x" * 300_000, "ab\n😀漢" * 20_000, "é" * 65_536, "éA" * 32_769,
             "".join(rng.choices([chr(0x4E00 + i) for i in range(8000)], k=500_000))] + [
        "".join(rng.choices(alphabet, k=rng.randint(1, 300))) for _ in range(300)
    ]

    def expected(text):
        shares = [n / len(text) for n in Counter(text).values()]
        return -sum(p * math.log2(p) for p in shares)

    assert apply(spark, texts, X.char_entropy) == pytest.approx(
        [expected(t) for t in texts], abs=1e-9
    )
    assert apply(spark, texts, X.entropy_log_length) == pytest.approx(
        [expected(t) * math.log(len(t) + 1) for t in texts], abs=1e-8
    )


def test_upper_case_ratio(spark):
    texts = ["", "ABC", "aBc", "ÀÉß", "ΔδЖж", "Ⅷx", "ǅ", "123"]
    expected = [sum(c.isupper() for c in t) / len(t) if t else 0.0 for t in texts]
    assert apply(spark, texts, X.upper_case_ratio) == pytest.approx(expected)


def _payloads(spark, texts):
    return apply(spark, texts, lambda c: X.hidden_payload(X.base64_tokens(c)))


@pytest.mark.parametrize("length", [40, 41, 42, 43])
@pytest.mark.parametrize("pads", [0, 1, 2, 3])
def test_padding_table(spark, length, pads):
    text = "run " + ("QUJD" * 11)[:length] + "=" * pads + " end"
    assert _payloads(spark, [text]) == [payload(text)]


def test_payload_of_random_bytes(spark):
    rng = random.Random(7)
    pieces = [b"A\0", b"\0\xd8", b"\0\xdc", b"\xff", b"\xc3\xa9", b"\xef\xbf\xbd", b"\x01",
              b"\xe2\x82", b"\xf0\x9f\x98\x80", b"z", b" \0", b"\n"]
    texts = []
    for _ in range(3000):
        raw = b"".join(rng.choices(pieces, k=rng.randint(25, 60)))
        if rng.random() < 0.5:
            raw = rng.randbytes(rng.randint(30, 90))
        token = base64.b64encode(raw).decode()
        texts.append(f"{token[: len(token) - rng.randint(0, 4)]}{'=' * rng.randint(0, 2)} x/{token}")
    pairs = [(t, payload(t)) for t in texts]
    pairs = [(t, p) for t, p in pairs if storable(p)]
    assert len(pairs) > 2500
    assert _payloads(spark, [t for t, _ in pairs]) == [p for _, p in pairs]


def test_lone_surrogates_and_bad_bytes(spark):
    cases = [bytes.fromhex("410000d84200"), bytes.fromhex("00dc4300"), bytes.fromhex("3dd800de44"),
             bytes.fromhex("00d8")]
    frame = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, b binary")
    rows = frame.orderBy("i").select(X.lenient_utf16le(F.col("b")).alias("t")).collect()
    assert [r.t for r in rows] == ["AB", "C", "😀", ""]
    assert [r.t for r in rows] == [c.decode("utf-16-le", "ignore") for c in cases]
    bad = [b"A\xffB", "�\x01a\x01b".encode() + b"\xc3", b"\xe2\x82X"]
    frame = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(bad)], "i int, b binary")
    rows = frame.orderBy("i").select(X.lenient_utf8(F.col("b")).alias("t")).collect()
    assert [r.t for r in rows] == [c.decode("utf-8", "ignore") for c in bad]


def test_character_codes(spark):
    cases = [
        ('[char]105[char]101[char]120', 'iex'),
        ('[char] 105', 'i'),
        ('[char]  105', '[char]  105'),
        ('[Char]101', '[Char]101'),
        ('[CHAR]65 [char]65', '[CHAR]65 A'),
        ('[char]10[char]101', '\n\n1'),
        ('[char]955', 'λ'),
        ('[char]1114112x', '[char]1114112x'),
        ('[char]99999999999999999999', '[char]99999999999999999999'),
        ('[char]0000105', 'i'),
        ('[char]105 [char]91char]105 [char]105', 'i i i'),
        ('[char]91char]91char]91', '[char]91char]91'),
        ('[char]1[char]48', '\x010'),
        ('[cha[char]114]105 [char]105', 'i i'),
        ('[char]٣x', '\x03x'),
        ('[char]\xa0105', '[char]\xa0105'),
        ('[char]', '[char]'),
        ('[char]128512', '😀'),
        ('none', 'none'),
        ('[char]0|', '\x00|'),
    ]
    assert apply(spark, [t for t, _ in cases], X.resolve_char_codes) == [r for _, r in cases]


def test_surrogate_code_reads_as_replacement(spark):
    assert apply(spark, ["a[char]55296b"], X.resolve_char_codes) == ["a�b"]


def test_split_literals_and_quotes(spark):
    texts = ['"a" + \'b\'', "'x'+'y'+\"z\"", '"a" +\x1c"b"', "a + b", "`I`e`X"]
    assert apply(spark, texts, X.join_split_literals) == ["\"ab'", "'xyz\"", '"ab"', "a + b", "`I`e`X"]
    assert apply(spark, texts, X.fold_quotes_and_case)[-1] == "iex"


def test_preview(spark):
    assert apply(spark, ["x" * 150, "y" * 151], X.preview) == ["x" * 150, "y" * 150 + "..."]


def test_readable_layout(spark):
    cases = [
        ('', ''),
        (';;', ''),
        ('a', 'a;'),
        ('if{a;b};c', '    if{\n    a;\n\nb\n};\n\nc;'),
        ('}}};{', '\n}\n}\n};\n\n    {\n    ;'),
        ('a | b;{c | d', 'a\n    | b;\n\n    {\n    c\n    | d;'),
        ('f{ g{ h } ; i } ; j | k', 'f{\n     g{\n     h \n};\n\ni \n};\n\nj\n    | k;'),
        (' ; x ; {y} | z', 'x;\n\n{\n    y\n}\n    | z;'),
        ('{;{;{;a};b};c};d', '    {\n    ;\n\n        {\n        ;\n\n            {\n            ;\n\n        a\n        };\n\n    b\n    };\n\nc\n};\n\nd;'),
        ('}{;a | b', '\n}{\n    ;\n\na\n    | b;'),
        ('{}{}; e', '{\n    \n}{\n    \n};\n\ne;'),
    ]
    assert apply(spark, [t for t, _ in cases], X.readable_layout) == [r for _, r in cases]


def test_empty_and_null_text_under_ansi(spark):
    frame = spark.createDataFrame([(1, ""), (2, " ")], "i int, command string")
    rows = add_features(frame).orderBy("i").collect()
    assert rows[0].entropy_log_length == 0 and rows[0].upper_case_ratio == 0
    assert rows[0].danger_density == 0


def test_string_manipulation_flag(spark):
    texts = ["$a+$b", "$ab + $cd", "'a'+'b'", '"abc" + "de"', "'abcd'+'e'", "a+b", "$a + b", "'²'+'½'",
             "$é + $à", "'a'+b"]
    # fixed value: the two joins that count as manipulation
    pattern = r'(\$\w+\s*\+\s*\$\w+)|(["\']\w{1,3}["\']\s*\+\s*["\']\w{1,3}["\'])'
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, command string")
    rows = add_features(frame).orderBy("i").select("has_string_manipulation").collect()
    assert [r[0] for r in rows] == [int(bool(re.search(pattern, t))) for t in texts]


def test_payload_feeds_the_match_text_but_not_the_statistics(spark):
    token = base64.b64encode("write-output 'by' + 'pass' marker".encode("utf-16-le")).decode()
    frame = spark.createDataFrame([(1, f"run {token}")], "i int, command string")
    row = add_features(frame, helpers=True).collect()[0]
    assert row.has_bypass == 1 and "bypass marker" in row[MATCH_TEXT]
    assert row.entropy_log_length == pytest.approx(
        apply(spark, [f"run {token}"], X.entropy_log_length)[0]
    )
    assert add_match_text(frame, "command").collect()[0][MATCH_TEXT] == row[MATCH_TEXT]


def test_long_texts_stay_linear(spark):
    """Whole texts of a megabyte: blanks, one letter, base64, codes, quotes."""
    wide = base64.b64encode(("a😀" * 100_000).encode()).decode()
    texts = [wide, "a😀" * 300_000, "$a😀é" * 100_000, "[char]1𝟎" * 5_000, " " * 1_000_000, "a" * 1_000_000, "QUJD" * 250_000, "[char]105" * 20_000,
             "'a'+" * 250_000, "$" * 1_000_000, "漢字" * 300_000, "A" * 39 + " "]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, command string")
    rows = add_features(frame.repartition(8)).orderBy("i").collect()
    assert len(rows) == len(texts)
    assert [row.has_char_code for row in rows].count(1) == 2
