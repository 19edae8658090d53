"""From features to a verdict: model score, override rules, level and reason."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellsieve.operators.barrier import seal
from shellsieve.vocabulary import (
    ALERT_SCORE,
    CRITICAL_SCORE,
    DENSE_BONUS,
    DENSE_FLAGS,
    FEATURE_COLUMNS,
    LEVEL_CRITICAL,
    LEVEL_SAFE,
    LEVEL_SUSPECT,
    LOADER_BONUS,
    MAX_SCORE,
    OVERRIDE_SCORE,
    REASON_DENSE,
    REASON_EVASION,
    REASON_LOADER,
    REASON_MODEL,
    REASON_RANSOMWARE,
)

VECTOR = "features_vector"
#: mean share of class 1 in the leaves a row falls into
LEAF_SHARE = "leaf_share"
MODEL_OUTPUT = (VECTOR, LEAF_SHARE, "rawPrediction", "probability", "prediction")


def assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=list(FEATURE_COLUMNS), outputCol=VECTOR)


def add_base_score(
    df: DataFrame,
    model: Transformer | None = None,
    base_score: Column | None = None,
    needed: Column | None = None,
) -> DataFrame:
    """Add ``base_ml_score``: the probability of class 1 in percent.

    ``base_score`` stands in for a model.  With neither, any row that has to be scored
    (any ``needed`` row) raises an error when the query runs; a frame without such rows
    is fine.
    """
    if base_score is not None:
        return df.withColumn("base_ml_score", base_score.cast("double"))
    if model is None:
        missing = F.raise_error(F.lit("no model was given to score commands with"))
        raised = missing if needed is None else F.when(needed, missing)
        return df.withColumn("base_ml_score", raised.cast("double"))
    filled = df.fillna(0, subset=list(FEATURE_COLUMNS))
    judged = model.transform(filled)
    share = (
        F.col(LEAF_SHARE) if LEAF_SHARE in judged.columns
        else vector_to_array("probability").getItem(1)
    )
    scored = judged.withColumn("base_ml_score", share * 100).drop(*MODEL_OUTPUT)
    return seal(scored, ["base_ml_score"])


def is_dense() -> Column:
    return F.col("danger_density") >= DENSE_FLAGS


def is_ransomware() -> Column:
    return F.col("critical_ransomware_alert") == 1


def is_loader() -> Column:
    return (F.col("combo_stealth_exploit") == 1) & (F.col("has_web_request") == 1)


def is_evasion() -> Column:
    return F.col("critical_evasion_alert") == 1


def final_score(base: Column) -> Column:
    """Rules in their fixed order (they do not commute), clamped once at the end."""
    dense = base + F.when(is_dense(), DENSE_BONUS).otherwise(0.0)
    ransom = F.greatest(dense, F.when(is_ransomware(), OVERRIDE_SCORE))
    loader = ransom + F.when(is_loader(), LOADER_BONUS).otherwise(0.0)
    evasion = F.greatest(loader, F.when(is_evasion(), OVERRIDE_SCORE))
    return F.least(evasion, F.lit(MAX_SCORE))


def reason() -> Column:
    fired = F.concat_ws(
        ", ",
        F.when(is_dense(), REASON_DENSE),
        F.when(is_ransomware(), REASON_RANSOMWARE),
        F.when(is_loader(), REASON_LOADER),
        F.when(is_evasion(), REASON_EVASION),
    )
    return F.when(fired == "", REASON_MODEL).otherwise(fired)


def level(score: Column) -> Column:
    return (
        F.when(score >= CRITICAL_SCORE, LEVEL_CRITICAL)
        .when(score >= ALERT_SCORE, LEVEL_SUSPECT)
        .otherwise(LEVEL_SAFE)
    )


def add_verdict(df: DataFrame) -> DataFrame:
    """Add score, alert flag, level and reason to rows with features and a base score."""
    scored = df.withColumn("score", final_score(F.col("base_ml_score")))
    return scored.withColumns({
        "is_malicious": F.col("score") >= ALERT_SCORE,
        "level": level(F.col("score")),
        "reason": reason(),
    })
