"""Whole scans: entries in, verdicts or ranked findings out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellsieve.functions import text as X
from shellsieve.operators.allowlist import add_allow_rule, mark_trusted
from shellsieve.operators.features import active_flags, add_features, feature_details
from shellsieve.operators.results import malicious_only, order_findings, shown_percent, tie_break
from shellsieve.operators.scoring import add_base_score, add_verdict
from shellsieve.sources.scripts import script_entries
from shellsieve.vocabulary import (
    FEATURE_COLUMNS,
    KEYWORDS,
    LEVEL_SAFE,
    REASON_ALLOWED,
    REPORTED_FLAGS,
)

CLEAN = "clean_cmd"
VERDICT_COLUMNS = (
    CLEAN, "is_malicious", "is_whitelisted", "score", "base_ml_score", "level", "reason",
)


def _screened(entries: DataFrame) -> DataFrame:
    single = X.single_line(F.coalesce(F.col("command"), F.lit("")))
    return add_allow_rule(entries.withColumn(CLEAN, single), CLEAN)


def score_commands(
    entries: DataFrame,
    model: Transformer | None = None,
    base_score: Column | None = None,
    keywords: Mapping[str, Sequence[str]] = KEYWORDS,
) -> DataFrame:
    """Verdicts of the commands that no allow rule lets pass.

    Stateless per row and free of shuffles, so it takes streams as well.  The allow
    filter comes before features and model.
    """
    suspects = _screened(entries).filter(F.col("allow_rule").isNull()).drop("allow_rule")
    featured = add_features(suspects, CLEAN, keywords)
    judged = add_verdict(add_base_score(featured, model, base_score))
    return judged.withColumn("is_whitelisted", F.lit(False))


def _report(
    screened: DataFrame,
    passed: Column,
    model: Transformer | None,
    base_score: Column | None,
    keywords: Mapping[str, Sequence[str]],
) -> DataFrame:
    """Verdicts of all rows from one pass; ``passed`` rows are not scored.

    They go through the features as empty text, which costs next to nothing.
    """
    kept = screened.columns
    marked = screened.withColumn("is_whitelisted", passed)
    passed = F.col("is_whitelisted")
    looked_at = marked.withColumn("__text", F.when(passed, F.lit("")).otherwise(F.col(CLEAN)))
    featured = add_features(looked_at, "__text", keywords).drop("__text")
    judged = add_verdict(add_base_score(featured, model, base_score, needed=~passed))

    def unless_passed(name: str) -> Column:
        return F.when(~passed, F.col(name)).alias(name)

    return judged.select(
        *kept,
        (~passed & F.col("is_malicious")).alias("is_malicious"),
        passed,
        F.when(passed, 0.0).otherwise(F.col("score")).alias("score"),
        unless_passed("base_ml_score"),
        F.when(passed, LEVEL_SAFE).otherwise(F.col("level")).alias("level"),
        F.when(passed, REASON_ALLOWED).otherwise(F.col("reason")).alias("reason"),
        *[unless_passed(name) for name in FEATURE_COLUMNS],
    )


def report_commands(
    entries: DataFrame,
    model: Transformer | None = None,
    base_score: Column | None = None,
    keywords: Mapping[str, Sequence[str]] = KEYWORDS,
) -> DataFrame:
    """Verdicts of all commands.

    Allow-listed rows have score 0, no base score and no features.
    """
    allowed = F.col("allow_rule").isNotNull()
    return _report(_screened(entries), allowed, model, base_score, keywords)


def report_view(report: DataFrame, key: str = "cmd_id") -> DataFrame:
    """What an analyst reads of a report: preview, scores as text, flags and values.

    Rows that were not scored have neither scores, flags nor values.
    """
    scored = F.col("base_ml_score").isNotNull()
    return report.select(
        key,
        X.preview(F.col(CLEAN)).alias("preview"),
        "level", "reason", "is_malicious", "is_whitelisted",
        F.when(scored, shown_percent(F.col("base_ml_score"))).alias("base_score"),
        F.when(scored, shown_percent(F.col("score"))).alias("final_score"),
        F.when(scored, active_flags(REPORTED_FLAGS)).alias("active_flags"),
        F.when(scored, feature_details()).alias("details"),
    )


def find_malicious(
    entries: DataFrame,
    model: Transformer | None = None,
    base_score: Column | None = None,
    keywords: Mapping[str, Sequence[str]] = KEYWORDS,
    order_by: str = "score",
    descending: bool = True,
) -> DataFrame:
    """The scan: malicious commands with their verdicts, ranked by score.

    A global sort runs its input twice, once to sample the ranges.  The findings are
    exchanged first, so that the second run reads them from the shuffle instead of
    scoring everything again.
    """
    verdicts = score_commands(entries, model, base_score, keywords)
    findings = malicious_only(verdicts).select(*entries.columns, *VERDICT_COLUMNS)
    return order_findings(findings.repartition(*tie_break(findings)), order_by, descending)


def check_scripts(
    scripts: DataFrame,
    trusted: DataFrame | None = None,
    model: Transformer | None = None,
    base_score: Column | None = None,
) -> DataFrame:
    """The script check: trusted hashes first, then the same verdict as the scan.

    A trusted script has the hash as its reason, and neither level nor score.
    """
    screened = _screened(script_entries(mark_trusted(scripts, trusted=trusted)))
    is_trusted = F.col("is_trusted")
    passed = is_trusted | F.col("allow_rule").isNotNull()
    report = _report(screened, passed, model, base_score, KEYWORDS)
    return report.withColumns({
        "score": F.when(~is_trusted, F.col("score")),
        "level": F.when(~is_trusted, F.col("level")),
        "reason": F.when(is_trusted, F.col("trust_reason")).otherwise(F.col("reason")),
    })
