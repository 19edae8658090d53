"""Stratified folds and classification metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: hex digits of the hash that name a bucket: 65,536 buckets per class
BUCKET_DIGITS = 4
#: what a null id is hashed as
NULL_ID = "null"


def add_folds(
    df: DataFrame, id_column: str, label: str = "malicious", k: int = 5, seed: int = 42
) -> DataFrame:
    """Add ``fold``: every class is dealt out over ``k`` folds in hash order.

    Row number n of a class, ordered by hash and id, goes to fold ``(n - 1) % k``.
    A window over a whole class would put half of all rows into one task.  The hash is
    cut into buckets instead: rows are numbered inside a (class, bucket), and the number
    of rows in the class's earlier buckets is added.  The bucket is a prefix of the sort
    key, so the numbering is the same as over the whole class.

    The input is read twice, the first time for ids and labels alone, and all its columns
    go through the window's exchange.  Give it narrow rows: ids and labels, or the numbers
    of a written table.  A null id is hashed as a fixed text; null labels are a class.
    """
    hashed = df.withColumn(
        "__hash", F.sha2(F.concat(
            F.coalesce(F.col(id_column).cast("string"), F.lit(NULL_ID)), F.lit(f":{seed}")), 256)
    ).withColumn("__bucket", F.substring("__hash", 1, BUCKET_DIGITS))
    # One row per class and bucket at most, whatever the size of the data.
    counts = hashed.groupBy(F.col(label).alias("__label"), F.col("__bucket").alias("__b")).agg(
        F.count(F.lit(1)).alias("__rows")
    )
    earlier = Window.partitionBy("__label").orderBy("__b").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        "__label", "__b", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before")
    )
    inside = Window.partitionBy(label, "__bucket").orderBy("__hash", id_column)
    numbered = hashed.withColumn("__n", F.row_number().over(inside))
    placed = numbered.join(
        F.broadcast(offsets),
        F.col(label).eqNullSafe(F.col("__label")) & (F.col("__bucket") == F.col("__b")),
    )
    fold = F.pmod(F.col("__before") + F.col("__n") - 1, F.lit(k)).cast("int")
    return placed.select(*df.columns, fold.alias("fold"))


def _count(condition: Column) -> Column:
    return F.count_if(condition).cast("long")


def confusion(
    df: DataFrame,
    by: Sequence[str] = ("fold",),
    label: str = "malicious",
    prediction: str = "prediction",
) -> DataFrame:
    """Matrix cells per group: one aggregate, combined before the shuffle."""
    actual, predicted = F.col(label) == 1, F.col(prediction) == 1
    return df.groupBy(*by).agg(
        _count(~actual & ~predicted).alias("tn"),
        _count(~actual & predicted).alias("fp"),
        _count(actual & ~predicted).alias("fn"),
        _count(actual & predicted).alias("tp"),
    )


def _ratio(part: Column, whole: Column) -> Column:
    """A ratio whose denominator may be zero; it is 0 then."""
    return F.when(whole != 0, part / whole).otherwise(F.lit(0.0))


def f_beta(beta: float) -> Column:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    weight = beta * beta
    return _ratio((1 + weight) * tp, (1 + weight) * tp + weight * fn + fp)


def add_metrics(cells: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1 from matrix cells."""
    tn, fp, fn, tp = (F.col(name) for name in ("tn", "fp", "fn", "tp"))
    return cells.withColumns({
        "acc": _ratio(tp + tn, tn + fp + fn + tp),
        "prec": _ratio(tp, tp + fp),
        "rec": _ratio(tp, tp + fn),
        "f1": f_beta(1.0),
    })


def summarise(fold_metrics: DataFrame) -> DataFrame:
    """Means of the fold metrics in percent, and the matrix summed over the folds."""
    return fold_metrics.agg(
        *[F.sum(cell).cast("long").alias(cell) for cell in ("tn", "fp", "fn", "tp")],
        *[(F.avg(m) * 100).alias(f"mean_{m}") for m in ("acc", "prec", "rec", "f1")],
    )


def f2_by_threshold(
    df: DataFrame,
    thresholds: Sequence[float],
    label: str = "malicious",
    score: str = "score",
) -> DataFrame:
    """F2 of "score is at least t" for every threshold, from one pass over the rows."""
    actual = F.col(label) == 1
    cells = []
    for i, t in enumerate(thresholds):
        predicted = F.col(score) >= t
        cells += [
            _count(actual & predicted).alias(f"tp{i}"),
            _count(~actual & predicted).alias(f"fp{i}"),
            _count(actual & ~predicted).alias(f"fn{i}"),
        ]
    rows = F.array(*[
        F.struct(
            F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"),
            F.col(f"fp{i}").alias("fp"), F.col(f"fn{i}").alias("fn"),
        )
        for i, t in enumerate(thresholds)
    ])
    return df.agg(*cells).select(F.inline(rows)).withColumn("f2", f_beta(2.0))
