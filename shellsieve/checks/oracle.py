"""The same answers as ``queries``, as DuckDB SQL over the given tables.

Written independently of the Spark code where the engines allow it: lists and window
functions instead of folds, one whole-class window instead of buckets.
"""

from __future__ import annotations

from shellsieve.checks import corpus
from shellsieve.checks.queries import BASE_SCORE, REGISTRY_SQL, THRESHOLDS
from shellsieve.vocabulary import (
    BUILT_IN_COMMANDS,
    DETAIL_COLUMNS,
    EVASION_WORDS,
    EVENT_SOURCE,
    FEATURE_COLUMNS,
    FLAG_COLUMNS,
    HISTORY_SOURCE,
    INSTALLERS,
    KEYWORDS,
    LEVEL_CRITICAL,
    LEVEL_SAFE,
    LEVEL_SUSPECT,
    NO_TIME,
    PERSISTENCE_KEYS,
    PERSISTENCE_SOURCE,
    REASON_ALLOWED,
    REASON_DENSE,
    REASON_EVASION,
    REASON_LOADER,
    REASON_MODEL,
    REASON_RANSOMWARE,
    REASON_TRUSTED,
    REPORTED_FLAGS,
    RUNNABLE_SUFFIXES,
    SKIPPED_STORAGE,
    STATISTICAL_COLUMNS,
    STORAGE_SOURCE,
    STORAGE_WORDS,
    SYSTEM_PATHS,
    TRUSTED_HASHES,
    USER_FOLDERS,
    WHITESPACE,
)



def sql_format(text: str) -> str:
    """A fixed text with places to fill in, for SQL's ``format``."""
    return text.replace("%s", "{}")


SPACES = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE) + "]"
SPACE_TEXT = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)
QUOTES = "[' || chr(34) || chr(39) || ']"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def any_of(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(w)})" for w in words) + ")"


def strip(sql: str) -> str:
    return f"trim({sql}, {SPACE_TEXT})"


def one_line(sql: str) -> str:
    return f"trim(regexp_replace({sql}, '{SPACES}+', ' ', 'g'))"


def entropy(column: str) -> str:
    return f"coalesce(list_aggregate(string_split(nullif({column}, ''), ''), 'entropy'), 0)"


def upper_ratio(column: str) -> str:
    return (
        f"coalesce(length(regexp_replace({column}, '[^\\p{{Lu}}]', '', 'g')) / "
        f"nullif(length({column}), 0), 0)"
    )


def join_literals(sql: str) -> str:
    return f"regexp_replace({sql}, '{QUOTES}{SPACES}*[+]{SPACES}*{QUOTES}', '', 'g')"


def char_codes(column: str) -> str:
    codes = f"regexp_extract_all({column}, '(?i)[[]char[]]{SPACES}*([0-9]+)', 1)"
    return (
        f"list_reduce(list_prepend({column}, {codes}), lambda acc, n: replace(replace(acc, "
        "'[char]' || n, chr(CAST(n AS INTEGER))), '[char] ' || n, chr(CAST(n AS INTEGER))))"
    )


def fold_case(sql: str) -> str:
    return f"lower(regexp_replace({sql}, '[' || chr(96) || chr(34) || chr(39) || ']', '', 'g'))"


TEXTS = f"texts AS ({corpus.TEXTS_SQL})"
COMMANDS = f"commands AS ({corpus.COMMANDS_SQL})"
CARRIERS = f"carriers AS ({corpus.CARRIERS_SQL})"
KEYED_TEXTS = f"""{TEXTS}, keyed AS (
    SELECT origin || '/' || id || '/' || part AS cmd_id, text AS command FROM texts)"""

# --- payloads ----------------------------------------------------------------------

_PADDED = (
    "CASE WHEN length(rtrim(t, '=')) % 4 = 0 THEN rtrim(t, '=') "
    "WHEN length(rtrim(t, '=')) % 4 = 2 AND t LIKE '%==' THEN rtrim(t, '=') || '==' "
    "WHEN length(rtrim(t, '=')) % 4 = 3 AND t LIKE '%=' THEN rtrim(t, '=') || '=' END"
)
# Zero bytes are written as a dot, here and in what the queries show.
# Both readings keep what is valid: one replace that consumes a valid unit or sequence, which
# it keeps, or else one unit or byte, which it drops.
_B, _T = "[0-9A-F]", "[89AB][0-9A-F]"
_VALID_WIDE = (
    f"regexp_replace(h, '({_B}{{2}}(?:[0-9A-CEF]{_B}|D[0-7])|{_B}{{2}}D[89AB]{_B}{{2}}D[C-F])"
    f"|{_B}{{1,4}}', '\\1', 'g')"
)
_WIDE = (
    f"array_to_string(list_transform(regexp_extract_all({_VALID_WIDE}, '..D[89AB]..D[C-F]|....'), "
    "lambda u: CASE WHEN u = '0000' THEN '.' WHEN length(u) = 4 THEN "
    "chr(CAST('0x' || u[3:4] || u[1:2] AS INTEGER)) ELSE "
    "chr(65536 + (CAST('0x' || u[3:4] || u[1:2] AS INTEGER) - 55296) * 1024 "
    "+ CAST('0x' || u[7:8] || u[5:6] AS INTEGER) - 56320) END), '')"
)
_VALID_NARROW = (
    f"regexp_replace(h, '([0-7]{_B}|(?:C[2-9A-F]|D{_B}){_T}|E0[AB]{_B}{_T}|E[1-9A-CEF](?:{_T}){{2}}"
    f"|ED[89]{_B}{_T}|F0[9AB]{_B}(?:{_T}){{2}}|F[1-3](?:{_T}){{3}}|F48{_B}(?:{_T}){{2}})|..', "
    "'\\1', 'g')"
)
_NARROW = (
    f"decode(unhex(array_to_string(list_transform(regexp_extract_all({_VALID_NARROW}, '..'), "
    "lambda u: CASE WHEN u = '00' THEN '2E' ELSE u END), '')))"
)


def payloads(relation: str) -> str:
    """CTEs that add ``tokens`` and ``payload`` to a relation of ``cmd_id, command``."""
    return f"""
    found AS (SELECT cmd_id, command,
        regexp_extract_all(command, '[A-Za-z0-9+/]{{40,}}={{0,2}}') AS tokens FROM {relation}),
    hexed AS (SELECT *, list_filter(list_transform(tokens,
        lambda t: hex(from_base64({_PADDED}))), lambda h: h IS NOT NULL) AS hexes FROM found),
    readings AS (SELECT *, flatten(list_transform(hexes, lambda h: [{_WIDE}, {_NARROW}])) AS texts
        FROM hexed),
    expanded AS (SELECT cmd_id, command, tokens, array_to_string(list_transform(
        list_filter(texts, lambda x: length({strip('x')}) > 5), lambda x: ' ' || x), '') AS payload
        FROM readings)"""


def matched(relation: str) -> str:
    return f"""{payloads(relation)},
    whole AS (SELECT *, CASE WHEN payload = '' THEN command ELSE command || ' ' || payload END AS t
        FROM expanded),
    joined AS (SELECT * EXCLUDE t, {join_literals('t')} AS t FROM whole),
    resolved AS (SELECT * EXCLUDE t, {char_codes('t')} AS t FROM joined),
    matched AS (SELECT cmd_id, command, {fold_case('t')} AS m FROM resolved)"""


# --- features ----------------------------------------------------------------------

_WORD = "[\\p{L}\\p{N}_]"
_SHORT = f"{QUOTES}{_WORD}{{1,3}}{QUOTES}"
_CONCAT = (
    f"regexp_matches(command, '[$]{_WORD}+{SPACES}*[+]{SPACES}*[$]{_WORD}"
    f"|{_SHORT}{SPACES}*[+]{SPACES}*{_SHORT}')"
)


def _simple_flags(match: str, command: str) -> dict[str, str]:
    k = {name: any_of(match, words) for name, words in KEYWORDS.items()}
    return {
        **{name: k[name] for name in (
            "has_encoded", "has_iex", "has_bypass", "has_api_calls", "has_persistence",
            "has_hidden_window", "has_reflection", "has_lolbins", "api_virtualalloc",
            "api_createremotethread", "has_dllimport", "critical_evasion_alert",
        )},
        "has_web_request": f"({k['web']} OR ({k['download']} AND "
                           f"(NOT {k['download_folder']} OR {k['download_method']})))",
        "has_char_code": f"contains(lower({command}), '[char]')",
        "has_string_manipulation": _CONCAT.replace("command", command),
        "has_vss_purge": f"({k['shadow_copy']} AND {k['delete']})",
        "has_crypto": k["crypto"],
        "has_file_mod": k["file_mod"],
        "has_discovery": k["discovery"],
    }


def _as_int(flags: dict[str, str]) -> str:
    return ", ".join(f"CAST({sql} AS INTEGER) AS {name}" for name, sql in flags.items())


def featured(relation: str) -> str:
    """CTEs that end in ``features``: all features and helpers by ``cmd_id``."""
    density = " + ".join(FLAG_COLUMNS)
    return f"""{matched(relation)},
    simple AS (SELECT cmd_id, command, {_as_int(_simple_flags('m', 'command'))},
        {entropy('command')} * ln(length(command) + 1) AS entropy_log_length,
        {upper_ratio('command')} AS upper_case_ratio FROM matched),
    combined AS (SELECT *,
        has_reflection & (has_api_calls | has_char_code) AS combo_stealth_exploit,
        has_encoded & has_bypass AS combo_bypass_base64,
        has_crypto & (has_discovery | has_file_mod) AS combo_ransomware_logic FROM simple),
    alerted AS (SELECT *, (has_vss_purge & combo_ransomware_logic)
        | (has_crypto & has_discovery & has_file_mod) AS critical_ransomware_alert FROM combined),
    features AS (SELECT *, CAST({density} AS INTEGER) AS danger_density FROM alerted)"""


FEATURES = f"{COMMANDS}, {featured('commands')}"


def shown_features(prefix: str = "") -> str:
    return ", ".join(
        f"round({prefix}{c}, 6) AS {c}" if c in STATISTICAL_COLUMNS else prefix + c
        for c in FEATURE_COLUMNS
    )

# --- allow rules -------------------------------------------------------------------


def allow_rule(t: str, source: str) -> str:
    calm = f"NOT {any_of(t, EVASION_WORDS)}"
    built_in = ", ".join(map(text, BUILT_IN_COMMANDS))
    return (
        f"CASE WHEN (starts_with({t}, 'git ') OR starts_with({t}, 'git.exe')) AND {calm} THEN 1 "
        f"WHEN {any_of(t, USER_FOLDERS)} AND {any_of(t, INSTALLERS)} AND {calm} THEN 2 "
        f"WHEN contains({t}, '.exe') AND {any_of(t, SYSTEM_PATHS)} THEN 3 "
        f"WHEN {t} IN ({built_in}) THEN 4 "
        f"WHEN contains({source}, 'UserAssist') AND NOT {any_of(t, RUNNABLE_SUFFIXES)} THEN 5 END"
    )


def allow_text(sql: str) -> str:
    return f"regexp_replace({strip(f'lower({sql})')}, '{QUOTES}', '', 'g')"


# --- verdicts ----------------------------------------------------------------------

_SCORE = (
    "least(100.0, greatest("
    "greatest(base + CASE WHEN danger_density >= 5 THEN 35.0 ELSE 0.0 END, "
    "CASE WHEN critical_ransomware_alert = 1 THEN 95.0 ELSE -1.0 END) "
    "+ CASE WHEN combo_stealth_exploit = 1 AND has_web_request = 1 THEN 25.0 ELSE 0.0 END, "
    "CASE WHEN critical_evasion_alert = 1 THEN 95.0 ELSE -1.0 END))"
)
_REASON = (
    "coalesce(nullif(concat_ws(', ', "
    f"CASE WHEN danger_density >= 5 THEN {text(REASON_DENSE)} END, "
    f"CASE WHEN critical_ransomware_alert = 1 THEN {text(REASON_RANSOMWARE)} END, "
    "CASE WHEN combo_stealth_exploit = 1 AND has_web_request = 1 THEN "
    f"{text(REASON_LOADER)} END, "
    f"CASE WHEN critical_evasion_alert = 1 THEN {text(REASON_EVASION)} END), ''), "
    f"{text(REASON_MODEL)})"
)
_LEVEL = (
    f"CASE WHEN score >= 80 THEN {text(LEVEL_CRITICAL)} "
    f"WHEN score >= 50 THEN {text(LEVEL_SUSPECT)} ELSE {text(LEVEL_SAFE)} END"
)


def _judged(relation: str) -> str:
    """``relation`` has ``cmd_id, command``; ends in ``judged``."""
    return f"""{featured(relation)},
    based AS (SELECT *, CAST({BASE_SCORE} AS DOUBLE) AS base FROM features),
    scores AS (SELECT *, CAST({_SCORE} AS DOUBLE) AS score, {_REASON} AS why FROM based),
    judged AS (SELECT *, {_LEVEL} AS lvl FROM scores)"""


HEURISTICS = f"{COMMANDS}, {_judged('commands')}"

VERDICTS = f"""{COMMANDS},
    lines AS (SELECT * EXCLUDE command, command AS raw, {one_line('command')} AS command
        FROM commands),
    {_judged('lines')},
    ruled AS (SELECT *, {allow_rule(allow_text('command'), 'source')} AS rule FROM lines),
    verdicts AS (SELECT r.cmd_id, r.source, r.timestamp, r.ts, r.malicious, r.raw AS command,
        r.command AS clean_cmd, rule IS NULL AND score >= 50 AS is_malicious,
        rule IS NOT NULL AS is_whitelisted,
        CASE WHEN rule IS NULL THEN score ELSE 0.0 END AS score,
        CASE WHEN rule IS NULL THEN base END AS base_ml_score,
        CASE WHEN rule IS NULL THEN lvl ELSE {text(LEVEL_SAFE)} END AS level,
        CASE WHEN rule IS NULL THEN why ELSE {text(REASON_ALLOWED)} END AS reason,
        CASE WHEN rule IS NULL THEN danger_density END AS danger_density
        FROM ruled r JOIN judged j ON r.cmd_id = j.cmd_id)"""

FINDING = "cmd_id, timestamp, level, score, source, command, reason"
FINDINGS = f"WITH {VERDICTS} SELECT {FINDING} FROM verdicts WHERE is_malicious"


def _folds(relation: str, id_column: str) -> str:
    return (
        f"CAST((row_number() OVER (PARTITION BY malicious ORDER BY "
        f"sha256(CAST({id_column} AS VARCHAR) || ':42'), {id_column}) - 1) % 5 AS INTEGER) AS fold "
        f"FROM {relation}"
    )


_CELLS = ", ".join(
    f"count(*) FILTER (malicious = {m} AND prediction = {p}) AS {name}"
    for name, m, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
)


def _rate(top: str, bottom: str) -> str:
    return f"coalesce(CAST({top} AS DOUBLE) / nullif({bottom}, 0), 0)"


PREDICTED = f"""{VERDICTS},
    predicted AS (SELECT cmd_id, malicious, score, CAST(is_malicious AS INTEGER) AS prediction,
        {_folds('verdicts', 'cmd_id')}),
    cells AS (SELECT fold, {_CELLS} FROM predicted GROUP BY fold),
    metrics AS (SELECT *, {_rate('tp + tn', 'tp + tn + fp + fn')} AS acc,
        {_rate('tp', 'tp + fp')} AS prec, {_rate('tp', 'tp + fn')} AS rec,
        {_rate('2 * tp', '2 * tp + fp + fn')} AS f1 FROM cells)"""

#: features whose split points are halves between whole numbers
WHOLE_FEATURES = tuple(c for c in FEATURE_COLUMNS if c not in STATISTICAL_COLUMNS)


def _splits(held, weights) -> str:
    """Every split of every whole-number feature, the best one, and the shares of its leaves.

    ``held`` are the folds left out in turn (-1: none).  Variance falls most where the sum
    of S * S / W over the two sides is largest, with W the weight and S that of class 1.
    ``leaves`` has the left-out rows (all rows for -1) with the share of their leaf.
    """
    return f"""{FEATURES},
    dealt AS (SELECT cmd_id, malicious AS y, {_folds('commands', 'cmd_id')}),
    wide AS (SELECT cmd_id, y, fold, {', '.join(WHOLE_FEATURES)} FROM features JOIN dealt USING (cmd_id)),
    long AS (UNPIVOT wide ON {', '.join(WHOLE_FEATURES)} INTO NAME feature VALUE v),
    runs AS (SELECT unnest({list(held)}) AS held, weight FROM (SELECT unnest({list(weights)})::DOUBLE AS weight)),
    sides AS (SELECT held, weight, feature, v, sum(CASE WHEN y = 1 THEN weight ELSE 1.0 END) AS w,
        sum(CASE WHEN y = 1 THEN weight ELSE 0.0 END) AS s FROM long JOIN runs ON fold <> held
        GROUP BY held, weight, feature, v),
    grown AS (SELECT held, weight, feature, v, sum(w) OVER part AS wl, sum(s) OVER part AS sl,
        sum(w) OVER whole AS wt, sum(s) OVER whole AS st FROM sides
        WINDOW part AS (PARTITION BY held, weight, feature ORDER BY v),
            whole AS (PARTITION BY held, weight, feature)),
    best AS (SELECT *, sl * sl / wl + (st - sl) * (st - sl) / (wt - wl) AS gain FROM grown WHERE wt > wl
        QUALIFY row_number() OVER (PARTITION BY held, weight ORDER BY gain DESC) = 1),
    leaves AS (SELECT cmd_id, y, b.held, b.weight,
        CASE WHEN l.v <= b.v THEN sl / wl ELSE (st - sl) / (wt - wl) END AS share
        FROM long l JOIN best b ON l.feature = b.feature AND (b.held = -1 OR l.fold = b.held))"""


#: every row with the best split and its side of it
_SIDED = """sided AS (SELECT l.v <= b.v AS goes_left, b.* FROM long l JOIN best b ON l.feature = b.feature)"""

_BEAUTIFY = f"""WITH coded AS (
        SELECT event_id AS cmd_id, 'if ($x) {{' || props || '; ' || ({corpus.COMMAND})
            || ' | out-null; }}; ;}}' AS code FROM events),
    pieces AS (SELECT cmd_id, unnest(string_split(code, ';')) AS piece,
        generate_subscripts(string_split(code, ';'), 1) AS pos FROM coded),
    lines AS (SELECT cmd_id, pos, {strip('piece')} AS line FROM pieces),
    steps AS (SELECT *, CAST(contains(line, '{{') AS INTEGER) - CAST(contains(line, '}}') AS INTEGER)
        AS step FROM lines WHERE line <> ''),
    sums AS (SELECT *, sum(step) OVER (PARTITION BY cmd_id ORDER BY pos) AS s FROM steps),
    levels AS (SELECT *, CAST(s - least(0, min(s) OVER (PARTITION BY cmd_id ORDER BY pos))
        AS BIGINT) AS after FROM sums),
    both_levels AS (SELECT *, coalesce(lag(after) OVER (PARTITION BY cmd_id ORDER BY pos), 0)
        AS before FROM levels),
    laid AS (SELECT cmd_id, pos, repeat('    ', after) || replace(replace(replace(line,
        ' | ', chr(10) || repeat('    ', before + 1) || '| '),
        '{{', '{{' || chr(10) || repeat('    ', before + 1)),
        '}}', chr(10) || repeat('    ', after) || '}}') || ';' AS paragraph FROM both_levels)
    SELECT cmd_id, string_agg(paragraph, chr(10) || chr(10) ORDER BY pos) AS layout
    FROM laid GROUP BY cmd_id"""

_EVENT_TEXT = f"({corpus.COMMAND}) || ' #' || CAST(event_id AS VARCHAR)"
_REGISTRY = f"vals AS (SELECT {', '.join(REGISTRY_SQL)} FROM events)"
_KEY_TIME = "coalesce(strftime(key_ts, '%d-%m-%Y %H:%M:%S'), '" + NO_TIME + "') AS timestamp"
_STORAGE_KEY = "split_part(key_path, chr(92), 2)"

ORACLE: dict[str, str] = {
    "single_line": f"WITH {TEXTS} SELECT origin, id, part, {one_line('text')} AS line FROM texts",
    "dataset_clean": f"""WITH {TEXTS} SELECT origin, id, part, substr(regexp_replace(
        chr(7) || text || chr(31), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), 1, 32000)
        AS clean FROM texts""",
    "entropy": f"""WITH {TEXTS} SELECT origin, id, part, round({entropy('text')}, 6) AS entropy,
        round({entropy('text')} * ln(length(text) + 1), 6) AS entropy_log_length FROM texts""",
    "upper_ratio": f"""WITH {TEXTS} SELECT origin, id, part,
        round({upper_ratio('text')}, 6) AS upper_case_ratio FROM texts""",
    "text_hash": f"WITH {TEXTS} SELECT origin, id, part, sha256(text) AS sha256 FROM texts",
    "preview": f"""WITH {TEXTS} SELECT origin, id, part, CASE WHEN length(text) > 150
        THEN substr(text, 1, 150) || '...' ELSE text END AS preview FROM texts""",
    "payload_expand": f"""WITH {CARRIERS}, {payloads('carriers')}
        SELECT cmd_id, CAST(len(tokens) AS INTEGER) AS tokens, payload FROM expanded""",
    "payload_in_texts": f"""WITH {KEYED_TEXTS}, {payloads('keyed')}
        SELECT cmd_id, CAST(len(tokens) AS INTEGER) AS tokens, payload FROM expanded
        WHERE len(tokens) > 0""",
    "text_features": f"""WITH {KEYED_TEXTS}, {featured('keyed')}
        SELECT cmd_id, {shown_features()} FROM features""",
    "label_features": f"""WITH labelled AS (SELECT d.doc_id AS cmd_id, text AS command, toxic AS malicious
            FROM documents d JOIN labels l ON d.doc_id = l.doc_id), {featured('labelled')},
        folded AS (SELECT cmd_id, malicious, {_folds('labelled', 'cmd_id')})
        SELECT f.cmd_id, {shown_features('f.')}, CAST(malicious AS INTEGER) AS malicious, fold
        FROM features f JOIN folded USING (cmd_id)""",
    "rf_split_scores": f"""WITH {_splits([-1], [7.0])}
        SELECT cmd_id, round(share, 6) AS share FROM leaves""",
    "rf_split_importance": f"""WITH {_splits([-1], [7.0])}
        SELECT feature, CAST(100 AS DOUBLE) AS importance FROM best""",
    "rf_split_validation": f"""WITH {_splits(range(5), [7.0])}
        SELECT held AS fold, {_CELLS} FROM (SELECT *, y AS malicious,
            CAST(share >= 0.5 AS INTEGER) AS prediction FROM leaves) GROUP BY held""",
    "rf_split_grid": f"""WITH {_splits(range(5), [5.0, 7.0])},
        cells AS (SELECT held, weight, {_CELLS} FROM (SELECT *, y AS malicious,
            CAST(share >= 0.5 AS INTEGER) AS prediction FROM leaves) GROUP BY held, weight)
        SELECT 'weight_' || CAST(weight AS INTEGER) AS weight,
            round(avg({_rate('5 * tp', '5 * tp + 4 * fn + fp')}), 6) AS f2
        FROM cells GROUP BY weight""",
    "rf_split_nodes": f"""WITH {_splits([-1], [7.0])}, {_SIDED}
        SELECT 0 AS node, -1 AS parent, 0 AS depth, feature, count(*) AS rows, round(any_value(st / wt), 6) AS share
        FROM sided GROUP BY feature
        UNION ALL SELECT CASE WHEN goes_left THEN 1 ELSE 2 END, 0, 1, NULL, count(*), round(any_value(
            CASE WHEN goes_left THEN sl / wl ELSE (st - sl) / (wt - wl) END), 6) FROM sided GROUP BY goes_left""",
    "rf_split_walk": f"""WITH {_splits([-1], [7.0])}
        SELECT cmd_id, false AS closed, round(share, 6) AS share FROM leaves
        UNION ALL SELECT cmd_id, true, (SELECT round(st / wt, 6) FROM best) FROM leaves""",
    "rf_split_settings": f"""WITH {_splits([-1], [7.0])},
        said AS (SELECT trees, depth, min_split, y AS malicious, CAST(CASE WHEN depth = 1 AND min_split = 2 THEN share
            ELSE (SELECT st / wt FROM best) END >= 0.5 AS INTEGER) AS prediction
            FROM leaves, (SELECT unnest([1, 2, 3]) AS trees), (SELECT unnest([0, 1]) AS depth),
                (SELECT unnest([2, 1073741824]) AS min_split))
        SELECT trees, depth, min_split, {_CELLS} FROM said GROUP BY trees, depth, min_split""",
    "bootstrap_weights": f"""WITH {COMMANDS},
        placed AS (SELECT tree, malicious, CAST('0x' || substr(sha256(cmd_id || ':' || tree || ':42'), 1, 13) AS BIGINT)::DOUBLE
            / pow(16, 13) AS place FROM commands, (SELECT unnest(range(0, 55))::INTEGER AS tree)),
        drawn AS (SELECT tree, malicious, len(list_filter(range(0, 13), lambda k: place >= exp(-1) * list_sum(
            list_transform(range(0, k + 1), lambda j: 1 / gamma(j + 1))))) AS n FROM placed),
        sizes AS (SELECT tree, sum(CASE WHEN malicious = 0 THEN n ELSE 0 END)::BIGINT AS n0,
            sum(CASE WHEN malicious = 1 THEN n ELSE 0 END)::BIGINT AS n1 FROM drawn GROUP BY tree)
        SELECT tree, n0, n1, round((n0 + n1) / (2 * n0), 6) AS w0, round((n0 + n1) / (2 * n1), 6) AS w1 FROM sizes""",
    "rf_cross_validation": f"""WITH {COMMANDS}, folded AS (SELECT malicious, {_folds('commands', 'cmd_id')})
        SELECT fold, count(*) AS n_rows, count(*) FILTER (malicious = 1) AS positives, true AS consistent
        FROM folded GROUP BY fold""",
    "join_literals": f"""WITH {TEXTS} SELECT origin, id, part,
        {join_literals('text')} AS joined FROM texts""",
    "char_codes": f"""WITH spelt AS (SELECT event_id AS cmd_id, array_to_string(list_transform(
        string_split(event_type, ''), lambda c: CASE WHEN event_id % 2 = 0 THEN '[char]'
        ELSE '[char] ' END || CAST(ord(c) AS VARCHAR)), '') || '; ' || ({corpus.COMMAND}) AS t
        FROM events) SELECT cmd_id, {char_codes('t')} AS resolved FROM spelt""",
    "fold_case": f"""WITH {TEXTS} SELECT origin, id, part, {fold_case('text')} AS folded
        FROM texts""",
    "normalize": f"""WITH {COMMANDS}, {CARRIERS}, {matched(
        "(SELECT cmd_id, command FROM commands)")},
        plain AS (SELECT cmd_id, 'plain' AS kind, m AS match_text FROM matched),
        hidden AS (WITH {matched('carriers')} SELECT cmd_id, 'carrier' AS kind, m AS match_text
            FROM matched)
        SELECT * FROM plain UNION ALL SELECT * FROM hidden""",
    "beautify": _BEAUTIFY,
    "keyword_flags": f"""WITH {FEATURES} SELECT cmd_id, {', '.join(
        n for n in FLAG_COLUMNS
        if not n.startswith('combo_') and n != 'critical_ransomware_alert')},
        has_crypto, has_file_mod, has_discovery FROM features""",
    "keyword_flags_in_texts": f"""WITH {TEXTS},
        folded AS (SELECT *, {fold_case('text')} AS m FROM texts)
        SELECT origin, id, part, {_as_int(_simple_flags('m', 'text'))} FROM folded""",
    "combo_flags": f"""WITH {FEATURES} SELECT cmd_id, combo_stealth_exploit, combo_bypass_base64,
        combo_ransomware_logic, critical_ransomware_alert FROM features""",
    "danger_density": f"WITH {FEATURES} SELECT cmd_id, danger_density FROM features",
    "feature_table": f"""WITH {FEATURES} SELECT {shown_features('f.')},
        c.malicious, c.command, c.cmd_id FROM features f JOIN commands c ON f.cmd_id = c.cmd_id""",
    "carrier_features": f"""WITH {CARRIERS}, {featured('carriers')}
        SELECT cmd_id, {', '.join(FLAG_COLUMNS)}, danger_density FROM features""",
    "active_flags": f"""WITH {FEATURES} SELECT cmd_id, concat_ws(',', {', '.join(
        f"CASE WHEN {n} = 1 THEN '{n}' END" for n in REPORTED_FLAGS)}) AS active FROM features""",
    "feature_details": f"WITH {FEATURES} " + " UNION ALL ".join(
        f"SELECT cmd_id, '{n}' AS feature, round(CAST({n} AS DOUBLE), 4) AS value FROM features"
        for n in DETAIL_COLUMNS
    ),
    "known_benign": f"""WITH {COMMANDS},
        ruled AS (SELECT cmd_id, {allow_rule(allow_text('command'), 'source')} AS r FROM commands)
        SELECT cmd_id, CAST(r AS INTEGER) AS allow_rule, r IS NOT NULL AS benign FROM ruled""",
    "known_benign_in_texts": f"""WITH {TEXTS},
        prepared AS (SELECT *, {allow_text(one_line('text'))} AS t FROM texts)
        SELECT origin, id, part, CAST({allow_rule('t', 'origin')} AS INTEGER) AS allow_rule
        FROM prepared""",
    "hash_allowlist": f"""WITH hashed AS (SELECT page_id, url, sha256(html) AS sha256 FROM pages),
        marked AS (SELECT page_id, sha256, sha256 IN (SELECT sha256 FROM hashed
            WHERE contains(url, '/en/')) AS is_trusted FROM hashed)
        SELECT *, CASE WHEN is_trusted THEN format('{sql_format(REASON_TRUSTED)}', substr(sha256, 1, 8)) ELSE '' END AS trust_reason FROM marked""",
    "hash_allowlist_shuffled": f"""WITH {COMMANDS},
        hashed AS (SELECT cmd_id, malicious, sha256(command) AS sha256 FROM commands),
        marked AS (SELECT cmd_id, sha256, sha256 IN (SELECT sha256 FROM hashed
            WHERE malicious = 0) AS is_trusted FROM hashed)
        SELECT *, CASE WHEN is_trusted THEN format('{sql_format(REASON_TRUSTED)}', substr(sha256, 1, 8)) ELSE '' END AS trust_reason FROM marked""",
    "hash_allowlist_built_in": f"""WITH {COMMANDS},
        marked AS (SELECT cmd_id, sha256(command) IN ({', '.join(map(text, TRUSTED_HASHES))})
            AS is_trusted FROM commands)
        SELECT cmd_id, is_trusted, CASE WHEN is_trusted THEN
            '{REASON_TRUSTED % 'e3b0c442'}' ELSE '' END AS trust_reason
        FROM marked""",
    "script_check": f"""WITH {VERDICTS.replace("CASE WHEN event_id % 27 = 5 THEN 'UserAssist' WHEN",
                                               "CASE WHEN")}
        SELECT cmd_id AS path, clean_cmd, is_malicious AND command <> '' AS is_malicious,
            is_whitelisted OR command = '' AS is_whitelisted, command = '' AS is_trusted,
            CASE WHEN command <> '' THEN score END AS score,
            CASE WHEN command <> '' THEN base_ml_score END AS base_ml_score,
            CASE WHEN command <> '' THEN level END AS level,
            CASE WHEN command <> '' THEN reason
                ELSE '{REASON_TRUSTED % 'e3b0c442'}' END AS reason
        FROM verdicts""",
    "heuristics": f"""WITH {HEURISTICS} SELECT cmd_id, score, score >= 50 AS is_malicious,
        lvl AS level, why AS reason FROM judged""",
    "verdict": f"""WITH {VERDICTS} SELECT cmd_id, clean_cmd, is_malicious, is_whitelisted, score,
        base_ml_score, level, reason, danger_density FROM verdicts""",
    "report_view": f"""WITH {VERDICTS} SELECT v.cmd_id, CASE WHEN length(clean_cmd) > 150
            THEN substr(clean_cmd, 1, 150) || '...' ELSE clean_cmd END AS preview,
        level, reason, is_malicious, is_whitelisted,
        CASE WHEN NOT is_whitelisted THEN printf('%.2f%%', base_ml_score) END AS base_score,
        CASE WHEN NOT is_whitelisted THEN printf('%.2f%%', v.score) END AS final_score,
        CASE WHEN NOT is_whitelisted THEN concat_ws(',', {', '.join(
            f"CASE WHEN {n} = 1 THEN '{n}' END" for n in REPORTED_FLAGS)}) END AS active_flags,
        {', '.join(f"CASE WHEN NOT is_whitelisted THEN round(CAST(j.{n} AS DOUBLE), 4) END AS {n}"
                   for n in DETAIL_COLUMNS)}
        FROM verdicts v JOIN judged j ON v.cmd_id = j.cmd_id""",
    "findings_sorted": FINDINGS,
    "findings_table": f"""WITH {VERDICTS} SELECT cmd_id, timestamp, level,
        printf('%.2f%%', score) AS score, source, command FROM verdicts WHERE is_malicious""",
    "findings_by_date": f"""WITH {VERDICTS} SELECT {FINDING}, CASE WHEN timestamp <> 'N/D'
        THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS shown FROM verdicts WHERE is_malicious""",
    "findings_by_source": FINDINGS,
    "findings_top": FINDINGS + " ORDER BY round(score, 2) DESC, cmd_id LIMIT 10",
    "history_lines": f"""SELECT '{HISTORY_SOURCE}' AS source, {strip(f"({corpus.COMMAND})")} AS command,
        'file' AS ts_note, strftime(ts, '%d-%m-%Y %H:%M:%S') || ' (File)' AS timestamp,
        'host' || user_id AS origin FROM events WHERE event_id % 11 <> 0 AND ({corpus.COMMAND}) <> ''""",
    "script_block_xml": f"""SELECT '{EVENT_SOURCE}' AS source,
        {strip(_EVENT_TEXT)} AS command, 'event' AS ts_note, CASE WHEN event_id % 5 = 0 THEN 'odd'
        ELSE strftime(ts, '%d-%m-%Y %H:%M:%S') END AS timestamp, 'host' || user_id AS origin
        FROM events WHERE event_id % 3 <> 0""",
    "persistence_filter": f"""WITH {_REGISTRY}
        SELECT format('{sql_format(PERSISTENCE_SOURCE)}', value_name) AS source, value_data AS command,
            'key' AS ts_note, {_KEY_TIME}, hive_id AS origin FROM vals
        WHERE lower(key_path) IN ({', '.join(map(text, PERSISTENCE_KEYS))})""",
    "storage_filter": f"""WITH {_REGISTRY}
        SELECT format('{sql_format(STORAGE_SOURCE)}', {_STORAGE_KEY}, value_name) AS source,
            value_data AS command, 'key' AS ts_note, {_KEY_TIME}, hive_id AS origin FROM vals
        WHERE lower(split_part(key_path, chr(92), 1)) = 'software'
            AND length(key_path) - length(replace(key_path, chr(92), '')) = 1
            AND {_STORAGE_KEY} NOT IN ({', '.join(map(text, SKIPPED_STORAGE))})
            AND (length(value_data) > 500 OR {any_of('lower(value_data)', STORAGE_WORDS)})""",
    "registry_export": f"WITH {_REGISTRY} SELECT hive_id, key_path, value_name, value_data FROM vals",
    "event_times": """SELECT event_id, CASE event_id % 6
        WHEN 2 THEN 'weird' WHEN 3 THEN 'N/D' WHEN 5 THEN 'N/D'
        ELSE strftime(ts, '%d-%m-%Y %H:%M:%S') END AS shown FROM events""",
    "source_union": f"""WITH {COMMANDS}
        SELECT cmd_id, source, command, 'file' AS ts_note, timestamp, 'host' || user_id AS origin,
            0::INTEGER AS source_no FROM commands
        UNION ALL SELECT conv_id * 1000 + turn, role, text, 'none', 'N/D', NULL, unnest([2, 4])::INTEGER
        FROM conversations
        UNION ALL SELECT page_id, 'url', url, 'none', 'N/D', 'web', unnest([3, 5])::INTEGER FROM pages""",
    "stratified_folds": f"WITH {COMMANDS} SELECT cmd_id, malicious, "
                        + _folds("commands", "cmd_id"),
    "stratified_folds_of_labels": "WITH l AS (SELECT doc_id, toxic AS malicious FROM labels) "
                                  "SELECT doc_id, malicious, " + _folds("l", "doc_id"),
    "fold_metrics": f"""WITH {PREDICTED} SELECT fold, tn, fp, fn, tp, round(acc, 6) AS acc,
        round(prec, 6) AS prec, round(rec, 6) AS rec, round(f1, 6) AS f1 FROM metrics""",
    "confusion_total": f"""WITH {PREDICTED} SELECT CAST(sum(tn) AS BIGINT) AS tn,
        CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tp) AS BIGINT) AS tp,
        round(avg(acc) * 100, 6) AS mean_acc, round(avg(prec) * 100, 6) AS mean_prec,
        round(avg(rec) * 100, 6) AS mean_rec, round(avg(f1) * 100, 6) AS mean_f1 FROM metrics""",
    "f2_by_threshold": f"WITH {PREDICTED}, curve AS (" + " UNION ALL ".join(
        f"""SELECT CAST({t} AS DOUBLE) AS threshold,
            count(*) FILTER (malicious = 1 AND score >= {t}) AS tp,
            count(*) FILTER (malicious = 0 AND score >= {t}) AS fp,
            count(*) FILTER (malicious = 1 AND score < {t}) AS fn FROM predicted"""
        for t in THRESHOLDS
    ) + f") SELECT *, round({_rate('5 * tp', '5 * tp + 4 * fn + fp')}, 6) AS f2 FROM curve",
    "class_weights": f"""WITH {COMMANDS}, sizes AS (SELECT malicious AS m, count(*) AS n
            FROM commands GROUP BY malicious), whole AS (SELECT sum(n) AS total FROM sizes)
        SELECT cmd_id, malicious, CASE WHEN malicious = 1 THEN 5.0::DOUBLE ELSE 1.0 END AS weight_5,
            CASE WHEN malicious = 1 THEN 7.0::DOUBLE ELSE 1.0 END AS weight_7,
            CASE WHEN malicious = 1 THEN 10.0::DOUBLE ELSE 1.0 END AS weight_10,
            round(CAST(total AS DOUBLE) / (2 * n), 6) AS weight_balanced
        FROM commands JOIN sizes ON malicious = m, whole""",
}
