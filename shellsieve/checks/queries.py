"""One query per operator over the given tables: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shellsieve.checks import corpus
from shellsieve.functions import text as X
from shellsieve.functions import times
from shellsieve.operators import allowlist, evaluation, features, results, scoring
from shellsieve.operators.barrier import seal
from shellsieve.plans import bagging, forest_table, hunt, search, train
from shellsieve.schema import SCRIPT_BLOCK_EVENT
from shellsieve.session import settle, work_folder
from shellsieve.sources import history, registry, script_blocks, tables
from shellsieve.sources.registry_export import export_values
from shellsieve.vocabulary import (
    DATASET_TEXT_LIMIT,
    DETAIL_COLUMNS,
    FEATURE_COLUMNS,
    FLAG_COLUMNS,
    REPORTED_FLAGS,
    STATISTICAL_COLUMNS,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: stands in for a forest where an oracle has to give the same score
BASE_SCORE = "cmd_id % 101"
THRESHOLDS = (10, 20, 30, 40, 50, 60, 70, 80, 90)
#: two values in every dimension; the full grid is ``train.FULL_GRID``
GRID = {
    "trees": (3, 6), "class_weight": (7.0, train.BALANCED), "criterion": ("gini", "entropy"),
    "depth": (3, 8), "min_leaf": (1, 2),
}
#: a reduced grid of the search, every dimension of ``train.FULL_SEARCH`` in it
SEARCH = {
    "trees": (2, 4), "class_weight": (7.0, train.SUBSAMPLE), "criterion": ("gini", "entropy"),
    "depth": (5, 30), "min_leaf": (1,), "min_split": (2, 5),
}
#: a forest that SQL can grow: one tree of one split over all features
ONE_SPLIT = train.ForestParams(trees=1, depth=1, bootstrap=False, features_per_split="all")
ONE_SPLIT_GRID = {
    "trees": (1,), "depth": (1,), "bootstrap": (False,), "features_per_split": ("all",),
    "class_weight": (5.0, 7.0),
}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def r6(column: Column | str) -> Column:
    return F.round(column, 6)


def base() -> Column:
    return F.expr(BASE_SCORE)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hunt.score_commands(corpus.commands(spark, sf_dir), base_score=base())


def keyed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every given text as a command, named by its table and place."""
    return corpus.texts(spark, sf_dir).select(
        F.concat_ws("/", "origin", "id", "part").alias("cmd_id"), F.col("text").alias("command")
    )


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({name: r6(name) for name in STATISTICAL_COLUMNS})


# --- text --------------------------------------------------------------------------

KEY = ("origin", "id", "part")


@query
def single_line(spark, sf_dir):
    return corpus.texts(spark, sf_dir).select(*KEY, X.single_line(F.col("text")).alias("line"))


@query
def dataset_clean(spark, sf_dir):
    texts = corpus.texts(spark, sf_dir).withColumn("text", F.expr("chr(7) || text || chr(31)"))
    return texts.select(*KEY, X.dataset_clean(F.col("text"), DATASET_TEXT_LIMIT).alias("clean"))


@query
def entropy(spark, sf_dir):
    text = F.col("text")
    measured = corpus.texts(spark, sf_dir).withColumn("bits", X.char_entropy(text))
    return measured.select(
        *KEY, r6("bits").alias("entropy"),
        r6(F.col("bits") * F.log1p(F.length(text))).alias("entropy_log_length"),
    )


@query
def upper_ratio(spark, sf_dir):
    return corpus.texts(spark, sf_dir).select(
        *KEY, r6(X.upper_case_ratio(F.col("text"))).alias("upper_case_ratio")
    )


@query
def text_hash(spark, sf_dir):
    return corpus.texts(spark, sf_dir).select(*KEY, X.sha256_hex(F.col("text")).alias("sha256"))


@query
def preview(spark, sf_dir):
    return corpus.texts(spark, sf_dir).select(*KEY, X.preview(F.col("text")).alias("preview"))


@query
def payload_expand(spark, sf_dir):
    """What is hidden in each carrier; zero bytes are shown as a dot."""
    found = corpus.carriers(spark, sf_dir).withColumn(
        "tokens", X.base64_tokens(F.col("command"))
    )
    payload = F.translate(X.hidden_payload(F.col("tokens")), "\0", ".")
    return found.select("cmd_id", F.size("tokens").alias("tokens"), payload.alias("payload"))


@query
def payload_in_texts(spark, sf_dir):
    """Base64-like runs in every given text, with the readings they give."""
    found = keyed_texts(spark, sf_dir).withColumn("tokens", X.base64_tokens(F.col("command")))
    payload = F.translate(X.hidden_payload(F.col("tokens")), "\0", ".")
    return seal(found, ["tokens"]).filter(F.size("tokens") > 0).select(
        "cmd_id", F.size("tokens").alias("tokens"), payload.alias("payload")
    )


@query
def text_features(spark, sf_dir):
    """All features of every given text, whole."""
    featured = features.add_features(keyed_texts(spark, sf_dir))
    return rounded(featured.select("cmd_id", *FEATURE_COLUMNS))


@query
def label_features(spark, sf_dir):
    """A labelled table of real texts: features, label and fold of the labelled documents."""
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("malicious"))
    labelled = read(spark, sf_dir, "documents").join(labels, "doc_id").select(
        F.col("doc_id").alias("cmd_id"), F.col("text").alias("command"), "malicious"
    )
    table = settle(train.model_input(train.build_dataset(labelled)))
    whole = [F.col(c).cast("int").alias(c) for c in FEATURE_COLUMNS if c not in STATISTICAL_COLUMNS]
    return rounded(evaluation.add_folds(table, "cmd_id")).select(
        "cmd_id", *STATISTICAL_COLUMNS, *whole, "malicious", "fold"
    )


@query
def join_literals(spark, sf_dir):
    return corpus.texts(spark, sf_dir).select(
        *KEY, X.join_split_literals(F.col("text")).alias("joined")
    )


@query
def char_codes(spark, sf_dir):
    """Each event's type spelt as character codes, and the commands as they are."""
    events = read(spark, sf_dir, "events").withColumn("command", F.expr(corpus.COMMAND))
    spelt = F.concat_ws("", F.transform(
        F.split("event_type", ""),
        lambda c: F.concat(
            F.when(F.col("event_id") % 2 == 0, "[char]").otherwise("[char] "), F.ascii(c)
        ),
    ))
    text = F.concat(spelt, F.lit("; "), F.col("command"))
    return events.withColumn("text", text).select(
        F.col("event_id").alias("cmd_id"), X.resolve_char_codes(F.col("text")).alias("resolved")
    )


@query
def fold_case(spark, sf_dir):
    return corpus.texts(spark, sf_dir).select(
        *KEY, X.fold_quotes_and_case(F.col("text")).alias("folded")
    )


@query
def normalize(spark, sf_dir):
    both = corpus.commands(spark, sf_dir).select("cmd_id", F.lit("plain").alias("kind"), "command")
    both = both.unionByName(
        corpus.carriers(spark, sf_dir).withColumn("kind", F.lit("carrier"))
    )
    matched = features.add_match_text(both, "command")
    return matched.select("cmd_id", "kind", F.translate("match_text", "\0", ".").alias("match_text"))


@query
def beautify(spark, sf_dir):
    """Layout of every command, wrapped in a block that holds the event's properties."""
    code = F.concat(
        F.lit("if ($x) {"), F.col("props"), F.lit("; "), F.expr(corpus.COMMAND),
        F.lit(" | out-null; }; ;}"),
    )
    events = read(spark, sf_dir, "events").withColumn("code", code)
    return events.select(
        F.col("event_id").alias("cmd_id"), X.readable_layout(F.col("code")).alias("layout")
    )


# --- features ----------------------------------------------------------------------

@query
def keyword_flags(spark, sf_dir):
    names = [n for n in FLAG_COLUMNS if not n.startswith("combo_")
             and n != "critical_ransomware_alert"]
    featured = features.add_features(corpus.commands(spark, sf_dir), helpers=True)
    return featured.select("cmd_id", *names, *features.HELPERS)


@query
def keyword_flags_in_texts(spark, sf_dir):
    """Plain keyword flags over every given text, whole; no payload expansion."""
    texts = corpus.texts(spark, sf_dir).withColumn(
        "match", X.fold_quotes_and_case(F.col("text"))
    )
    flags = features.keyword_flags(F.col("text"), F.col("match"))
    return texts.select(*KEY, *[flag.cast("int").alias(name) for name, flag in flags.items()])


@query
def combo_flags(spark, sf_dir):
    names = [n for n in FLAG_COLUMNS if n.startswith("combo_")] + ["critical_ransomware_alert"]
    return features.add_features(corpus.commands(spark, sf_dir)).select("cmd_id", *names)


@query
def danger_density(spark, sf_dir):
    return features.add_features(corpus.commands(spark, sf_dir)).select(
        "cmd_id", "danger_density"
    )


@query
def feature_table(spark, sf_dir):
    """The whole training table of the labelled commands."""
    labelled = corpus.commands(spark, sf_dir).select("cmd_id", "command", "malicious")
    table = train.build_dataset(labelled)
    return table.withColumns({
        "entropy_log_length": r6("entropy_log_length"), "upper_case_ratio": r6("upper_case_ratio"),
    })


@query
def carrier_features(spark, sf_dir):
    """Flags of commands whose keywords are all inside their payload."""
    featured = features.add_features(corpus.carriers(spark, sf_dir))
    return featured.select("cmd_id", *FLAG_COLUMNS, "danger_density")


@query
def active_flags(spark, sf_dir):
    featured = features.add_features(corpus.commands(spark, sf_dir))
    return featured.select(
        "cmd_id", F.concat_ws(",", features.active_flags(REPORTED_FLAGS)).alias("active"),
    )


@query
def feature_details(spark, sf_dir):
    featured = features.add_features(corpus.commands(spark, sf_dir))
    details = featured.select("cmd_id", features.feature_details().alias("details"))
    return details.select("cmd_id", F.explode("details").alias("feature", "value"))


# --- allow-lists -------------------------------------------------------------------

@query
def known_benign(spark, sf_dir):
    ruled = allowlist.add_allow_rule(corpus.commands(spark, sf_dir), "command")
    return ruled.select("cmd_id", "allow_rule", F.col("allow_rule").isNotNull().alias("benign"))


@query
def known_benign_in_texts(spark, sf_dir):
    ruled = allowlist.add_allow_rule(
        corpus.texts(spark, sf_dir).withColumn("line", X.single_line(F.col("text"))),
        "line", "origin",
    )
    return ruled.select(*KEY, "allow_rule")


@query
def hash_allowlist(spark, sf_dir):
    """Pages checked against the hashes of the English ones."""
    pages = read(spark, sf_dir, "pages")
    approved = pages.filter(F.col("url").contains("/en/")).select(F.sha2("html", 256).alias("sha256"))
    marked = allowlist.mark_trusted(pages, "html", approved)
    return marked.select("page_id", "sha256", "is_trusted", "trust_reason")


@query
def hash_allowlist_shuffled(spark, sf_dir):
    """The same for a list that is too long to broadcast."""
    commands = corpus.commands(spark, sf_dir)
    approved = commands.filter("malicious = 0").select(F.sha2("command", 256).alias("sha256"))
    marked = allowlist.mark_trusted(
        commands, "command", approved, broadcast_rows=0
    )
    return marked.select("cmd_id", "sha256", "is_trusted", "trust_reason")


@query
def hash_allowlist_built_in(spark, sf_dir):
    marked = allowlist.mark_trusted(corpus.commands(spark, sf_dir), "command")
    return marked.select("cmd_id", "is_trusted", "trust_reason")


@query
def script_check(spark, sf_dir):
    """Commands as whole scripts: built-in hashes, allow rules, then the verdict."""
    whole = corpus.commands(spark, sf_dir).select(
        F.col("cmd_id").alias("path"), F.col("command").alias("content"),
        F.col("ts").cast("timestamp").alias("file_time"),
    )
    checked = hunt.check_scripts(whole, base_score=F.col("path") % 101)
    return checked.select(
        "path", "clean_cmd", "is_malicious", "is_whitelisted", "is_trusted", "score",
        "base_ml_score", "level", "reason",
    )


# --- verdicts and findings ---------------------------------------------------------

@query
def heuristics(spark, sf_dir):
    """Score and reason for every command, without the allow-list."""
    featured = features.add_features(corpus.commands(spark, sf_dir))
    judged = scoring.add_verdict(scoring.add_base_score(featured, base_score=base()))
    return judged.select("cmd_id", "score", "is_malicious", "level", "reason")


@query
def verdict(spark, sf_dir):
    report = hunt.report_commands(corpus.commands(spark, sf_dir), base_score=base())
    return report.select(
        "cmd_id", "clean_cmd", "is_malicious", "is_whitelisted", "score", "base_ml_score",
        "level", "reason", "danger_density",
    )




@query
def report_view(spark, sf_dir):
    """The analyst's view, with every entry of the value map as a column."""
    report = hunt.report_commands(corpus.commands(spark, sf_dir), base_score=base())
    view = hunt.report_view(report)
    return view.select(
        "cmd_id", "preview", "level", "reason", "is_malicious", "is_whitelisted", "base_score",
        "final_score", F.array_join("active_flags", ",").alias("active_flags"),
        *[F.col("details")[name].alias(name) for name in DETAIL_COLUMNS],
    )


FINDING = ("cmd_id", "timestamp", "level", "score", "source", "command", "reason")


@query
def findings_sorted(spark, sf_dir):
    return hunt.find_malicious(corpus.commands(spark, sf_dir), base_score=base()).select(*FINDING)


@query
def findings_table(spark, sf_dir):
    return results.display_columns(
        hunt.find_malicious(corpus.commands(spark, sf_dir), base_score=base())
    )


@query
def findings_by_date(spark, sf_dir):
    found = results.malicious_only(scored(spark, sf_dir)).select(*FINDING)
    ordered = results.order_findings(found.repartition("cmd_id"), "timestamp", descending=False)
    shown = F.date_format(times.shown_time(F.col("timestamp")), "yyyy-MM-dd HH:mm:ss")
    return ordered.withColumn("shown", shown)


@query
def findings_by_source(spark, sf_dir):
    found = results.malicious_only(scored(spark, sf_dir)).select(*FINDING)
    return results.order_findings(found.repartition("cmd_id"), "source", descending=False)


@query
def findings_top(spark, sf_dir):
    """The ten best findings, in order."""
    found = results.malicious_only(scored(spark, sf_dir)).select(*FINDING)
    return results.order_findings(found).limit(10)


# --- sources -----------------------------------------------------------------------

@query
def history_lines(spark, sf_dir):
    """Event texts as lines of a console history."""
    lines = read(spark, sf_dir, "events").select(
        F.expr(
            "CASE WHEN event_id % 11 = 0 THEN '  ' ELSE chr(9) || "
            f"({corpus.COMMAND}) || chr(12) || ' ' END"
        ).alias("value"),
        F.col("ts").cast("timestamp").alias("file_time"),
        F.format_string("host%d", "user_id").alias("origin"),
    )
    return history.history_entries(lines).drop("cmd_id", "event_ts")


@query
def script_block_xml(spark, sf_dir):
    """Events written out as XML records and read back as script-block entries."""
    escaped = reduce(
        lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])),
        (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")), F.expr(corpus.COMMAND),
    )
    stamp = F.expr(
        "CASE event_id % 5 WHEN 0 THEN 'odd.' || event_id "
        "ELSE date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\") END"
    )
    events = read(spark, sf_dir, "events")
    record = F.format_string(
        "<Event><System><EventID>%s</EventID><TimeCreated SystemTime=\"%s\"/>"
        "<Computer>host%d</Computer></System>"
        "<EventData><Data Name=\"Path\">p</Data><Data Name=\"ScriptBlockText\">%s\n#%d</Data>"
        "</EventData></Event>",
        F.when(F.col("event_id") % 3 == 0, "4103").otherwise("4104"), stamp, F.col("user_id"), escaped,
        F.col("event_id"),
    )
    options = {"rowTag": "Event", "ignoreSurroundingSpaces": "false"}
    parsed = events.select(F.from_xml(record, SCRIPT_BLOCK_EVENT, options).alias("event"))
    return script_blocks.script_block_entries(parsed.select("event.*")).drop("cmd_id", "event_ts")


def registry_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(*REGISTRY_SQL)


_KEYS = (
    "Software^Microsoft^Windows^CurrentVersion^Run",
    "SOFTWARE^Microsoft^Windows^CurrentVersion^RunOnce",
    "Software^Microsoft^Windows^CurrentVersion^Policies^Explorer^Run",
    "Software^Foo",
    "Software^Microsoft",
    "Software^Classes",
    "software^microsoft",
    "Software^Foo^Bar",
    "Environment^Foo",
)
_KEY_CASES = " ".join(f"WHEN {i} THEN '{key}'" for i, key in enumerate(_KEYS))
#: columns of a registry-value table, in SQL that both engines read
REGISTRY_SQL = (
    "event_id AS value_id",
    "'hive' || CAST(user_id AS VARCHAR(20)) AS hive_id",
    f"replace(CASE event_id % {len(_KEYS)} {_KEY_CASES} END, '^', chr(92)) AS key_path",
    "CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(ts AS TIMESTAMP) END AS key_ts",
    "event_type AS value_name",
    f"CASE event_id % 4 WHEN 0 THEN repeat(event_type, 101) WHEN 1 THEN repeat('ab', 250) "
    f"ELSE {corpus.COMMAND} END AS value_data",
)


@query
def persistence_filter(spark, sf_dir):
    values = registry_values(spark, sf_dir)
    return registry.persistence_entries(values).drop("cmd_id", "event_ts")


@query
def storage_filter(spark, sf_dir):
    values = registry_values(spark, sf_dir)
    return registry.storage_entries(values).drop("cmd_id", "event_ts")


@query
def registry_export(spark, sf_dir):
    """The registry values as lines of text exports, cut into ranges that part keys and values."""
    def escaped(column: str) -> Column:
        return F.regexp_replace(column, r'(["\\])', r'\\$1')

    header = F.concat(F.lit("[HKEY_CURRENT_USER\\"), "key_path", F.lit("]"))
    value = F.concat(F.lit('"'), escaped("value_name"), F.lit('"="'), escaped("value_data"), F.lit('"'))
    lines = registry_values(spark, sf_dir).select(
        F.col("hive_id").alias("origin"), F.col("value_id"), F.posexplode(F.array(header, value)).alias("at", "text"))
    line = 2 * F.col("value_id") + F.col("at")
    ranged = lines.select(
        "origin", line.alias("line"), ((line - line % 7) * 100).alias("block"), F.col("text").cast("binary").alias("value"))
    return export_values(ranged, "utf-8").drop("key_ts")


@query
def event_times(spark, sf_dir):
    """Exported event times in usual and odd forms."""
    events = read(spark, sf_dir, "events").withColumn("raw", F.expr(
        "CASE event_id % 6 WHEN 0 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\") "
        "WHEN 1 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss') WHEN 2 THEN 'weird.' || event_id "
        "WHEN 3 THEN '' WHEN 4 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") END"
    ))
    return events.select("event_id", times.display_event_time(F.col("raw")).alias("shown"))


@query
def source_union(spark, sf_dir):
    """Commands by source, registry entries and the texts of conversations, united."""
    commands = corpus.commands(spark, sf_dir).select(
        "cmd_id", "source", "command", F.col("ts").cast("timestamp").alias("event_ts"),
        F.lit("file").alias("ts_note"), "timestamp", F.format_string("host%d", "user_id").alias("origin"),
    )
    talks = read(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("cmd_id"), F.col("role").alias("source"),
        F.col("text").alias("command"), F.lit(None).cast("timestamp").alias("event_ts"),
        F.lit("none").alias("ts_note"), F.lit("N/D").alias("timestamp"), F.lit(None).cast("string").alias("origin"),
    )
    pages = read(spark, sf_dir, "pages").select(
        F.col("page_id").alias("cmd_id"), F.lit("url").alias("source"), F.col("url").alias("command"),
        F.lit(None).cast("timestamp").alias("event_ts"), F.lit("none").alias("ts_note"),
        F.lit("N/D").alias("timestamp"), F.lit("web").alias("origin"),
    )
    # More than four sources, one of them not acquired, one given twice.
    united = tables.combine_sources(commands, None, talks, pages, talks, pages)
    return united.drop("event_ts")


# --- folds and metrics -------------------------------------------------------------

def rule_predictions(commands: DataFrame) -> DataFrame:
    """The rules' own verdict as the prediction."""
    verdicts = hunt.report_commands(commands, base_score=base())
    return verdicts.withColumn("prediction", F.col("is_malicious").cast("int"))


def rule_fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Numbers alone go through the numbering of the folds, from a written table.
    judged = rule_predictions(corpus.commands(spark, sf_dir)).select("cmd_id", "malicious", "prediction")
    folded = evaluation.add_folds(settle(judged), "cmd_id")
    return evaluation.add_metrics(evaluation.confusion(folded))


@query
def stratified_folds(spark, sf_dir):
    labelled = corpus.commands(spark, sf_dir).select("cmd_id", "malicious")
    return evaluation.add_folds(labelled, "cmd_id")


@query
def stratified_folds_of_labels(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("malicious"))
    return evaluation.add_folds(labels, "doc_id")


METRICS = ("acc", "prec", "rec", "f1")


@query
def fold_metrics(spark, sf_dir):
    return rule_fold_metrics(spark, sf_dir).withColumns({m: r6(m) for m in METRICS})


@query
def confusion_total(spark, sf_dir):
    metrics = rule_fold_metrics(spark, sf_dir)
    means = {f"mean_{m}": r6(f"mean_{m}") for m in METRICS}
    return evaluation.summarise(metrics).withColumns(means)


@query
def f2_by_threshold(spark, sf_dir):
    judged = rule_predictions(corpus.commands(spark, sf_dir))
    curve = evaluation.f2_by_threshold(judged, THRESHOLDS)
    return curve.withColumn("f2", r6("f2"))


@query
def class_weights(spark, sf_dir):
    labelled = corpus.commands(spark, sf_dir).select("cmd_id", "malicious")
    weighted = train.add_weights(labelled, [5.0, 7.0, 10.0, train.BALANCED])
    return weighted.withColumn("weight_balanced", r6("weight_balanced"))


# --- forest ------------------------------------------------------------------------

def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = corpus.commands(spark, sf_dir).select("cmd_id", "command", "malicious")
    return train.build_dataset(labelled)


def _whole_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows whose features are whole numbers: SQL can list all their splits."""
    return _training(spark, sf_dir).withColumns({c: F.lit(0.0) for c in STATISTICAL_COLUMNS})


@query
def rf_scores(spark, sf_dir):
    """The final forest trained on the labelled commands, then the scan with it."""
    model = train.fit_forest(_training(spark, sf_dir))
    return hunt.find_malicious(corpus.commands(spark, sf_dir), model).select(
        *FINDING, "base_ml_score"
    )


@query
def rf_importance(spark, sf_dir):
    return train.top_features(spark, train.fit_forest(_training(spark, sf_dir)))


@query
def rf_cross_validation(spark, sf_dir):
    """The final settings; what SQL can say of any forest: rows, positives, sound metrics."""
    c = F.col
    total, hits = c("tn") + c("fp") + c("fn") + c("tp"), c("tp") + c("tn")
    f1 = F.when(c("tp") > 0, 2 * c("tp") / (2 * c("tp") + c("fp") + c("fn"))).otherwise(0.0)
    metrics = train.cross_validate(_training(spark, sf_dir), "cmd_id")
    sound = (F.abs(c("acc") - hits / total) < 1e-9) & (F.abs(c("f1") - f1) < 1e-9)
    return metrics.select(
        "fold", total.alias("n_rows"), (c("fn") + c("tp")).alias("positives"), sound.alias("consistent")
    )


@query
def rf_grid(spark, sf_dir):
    return train.grid_search(_training(spark, sf_dir), "cmd_id", GRID).report


@query
def rf_split_scores(spark, sf_dir):
    table = _whole_numbers(spark, sf_dir)
    model = train.fit_forest(table, ONE_SPLIT)
    return model.transform(train.model_input(table)).select("cmd_id", r6("leaf_share").alias("share"))


@query
def rf_split_importance(spark, sf_dir):
    model = train.fit_forest(_whole_numbers(spark, sf_dir), ONE_SPLIT)
    return train.top_features(spark, model).filter("importance > 0")


@query
def rf_split_validation(spark, sf_dir):
    metrics = train.cross_validate(_whole_numbers(spark, sf_dir), "cmd_id", 5, ONE_SPLIT)
    return metrics.select("fold", "tn", "fp", "fn", "tp")


@query
def rf_split_grid(spark, sf_dir):
    report = train.grid_search(_whole_numbers(spark, sf_dir), "cmd_id", ONE_SPLIT_GRID).report
    return report.select(F.col("params")["weightCol"].alias("weight"), r6("f2").alias("f2"))


@query
def rf_split_nodes(spark, sf_dir):
    """The fitted forest of one split as a table of nodes."""
    nodes = forest_table.node_table(train.fit_forest(_whole_numbers(spark, sf_dir), ONE_SPLIT))
    name = F.when(F.col("feature") >= 0, F.get(F.array(*map(F.lit, FEATURE_COLUMNS)), F.col("feature")))
    return nodes.select("node", "parent", "depth", name.alias("feature"), "rows", r6("share").alias("share"))


@query
def rf_split_walk(spark, sf_dir):
    """Scores by walking the node table; leaves that are too small a node to split are closed."""
    table = settle(train.model_input(_whole_numbers(spark, sf_dir)))
    nodes = forest_table.node_table(train.fit_forest(table, ONE_SPLIT))
    total = table.count()
    walks = [
        forest_table.node_scores(table, forest_table.prune(nodes, limit), "cmd_id").withColumn("closed", F.lit(closed))
        for closed, limit in ((False, total), (True, total + 1))
    ]
    return reduce(DataFrame.unionByName, walks).select("cmd_id", "closed", r6("leaf_share").alias("share"))


@query
def rf_split_settings(spark, sf_dir):
    """Every tree count, depth and node size from one fit of three equal trees of one split."""
    table = settle(train.model_input(_whole_numbers(spark, sf_dir)))
    nodes = forest_table.node_table(train.fit_forest(table, replace(ONE_SPLIT, trees=3)))
    return forest_table.settings_cells(table, nodes, "malicious", (1, 2, 3), (0, 1), (2, 1 << 30))


@query
def bootstrap_weights(spark, sf_dir):
    """Class sizes and weights of the bootstraps of all trees of the final forest."""
    labelled = corpus.commands(spark, sf_dir).select("cmd_id", "malicious")
    sizes = bagging.class_sizes(labelled, "cmd_id", "malicious", train.ForestParams().trees, 42)
    return sizes.withColumns({"w0": r6("w0"), "w1": r6("w1")})


@query
def rf_search(spark, sf_dir):
    """The search over forests read off in every dimension, with weights per bootstrap."""
    ledger = f"{work_folder(spark)}/ledgers/{uuid.uuid4().hex}"
    return search.search(_training(spark, sf_dir), "cmd_id", ledger, SEARCH, k=2).report
