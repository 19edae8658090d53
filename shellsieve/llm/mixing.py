"""Document rates that bring soft domain totals to target weights.

A classifier trained on labelled documents gives every document a posterior over domains.
A document with rate ``r`` is expected to give ``r * tokens * posterior`` tokens to each
domain.  The rates are the nonnegative least-squares solution, found by projected gradient
from rate one, so documents of equal posterior move alike.

All documents take part in every step; a step is one Spark aggregation of a few numbers.
Rates are never stored between steps: the gradient of a document is its posterior times a
vector with one entry per domain, so its rate follows from the short list of these vectors.
The error is measured in the norm of the inverse Gram matrix of the posteriors, in which
the gradient has Lipschitz constant one: steps of length one always descend, and one step
solves the problem if no rate meets its lower bound.  How far a step moves the rates is the
length of the projected gradient; when it is no more than :data:`SETTLED`, they are fitted.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellsieve.llm.classifier import SubwordClassifier, train
from shellsieve.llm.storage import discard, spare, written
from shellsieve.llm.tokens import buffers, count_words, pieces

TRAINING_ROWS = 4000
STEPS = 100
#: root mean square move of the rates, by tokens, under which they are fitted
SETTLED = 1e-4
#: entries of the Gram matrix that one pass over the documents sums
GRAM_ENTRIES = 1 << 20


def _last_two(steps: list[np.ndarray], floor: float, posterior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    before = rate = np.ones(len(posterior))
    for step in steps:
        before, rate = rate, np.maximum(floor, rate - posterior @ step)
    return before, rate


def rates_after(steps: list[np.ndarray], floor: float, posterior: np.ndarray) -> np.ndarray:
    """Rates from one on, each step projected onto the rates of ``floor`` or more."""
    return _last_two(steps, floor, posterior)[1]


class Mixture:
    """Domains, the classifier of their posteriors, and the fitted gradient vectors.

    ``error`` is the largest gap of a domain's tokens to its target as a share of all
    targets, ``moved`` the move of the last step and ``settled`` whether that is small.
    """

    def __init__(self, domains: list[str], model: SubwordClassifier):
        self.domains, self.model = domains, model
        self.totals = self.targets = np.zeros(len(domains))
        self.steps: list[np.ndarray] = []
        self.floor = self.error = self.moved = 0.0

    @property
    def settled(self) -> bool:
        return self.moved <= SETTLED

    def rates(self, posterior: np.ndarray) -> np.ndarray:
        return rates_after(self.steps, self.floor, posterior)


def domains_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id`` and ``domain`` of labelled documents: language and quality, one row per id."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.max("quality").alias("quality"))
    return (
        docs.select("doc_id", "lang").join(known, "doc_id")
        .groupBy("doc_id").agg(F.min(F.concat_ws("/", F.coalesce("lang", F.lit("?")), "quality")).alias("domain"))
    )


def train_domains(docs: DataFrame, labelled: DataFrame, rows: int = TRAINING_ROWS) -> Mixture:
    """Classifier from ``labelled (doc_id, domain)``, of any number of domains."""
    labelled = labelled.filter("domain IS NOT NULL")
    domains = [r[0] for r in labelled.select("domain").distinct().orderBy("domain").collect()] or ["all"]
    numbers = docs.sparkSession.createDataFrame(list(enumerate(domains)), "label int, domain string")
    labels = labelled.select("doc_id", "domain").join(numbers, "domain").select("doc_id", "label")
    model = train(docs, labels, len(domains), rows, buckets=1 << 17, sizes=())
    return Mixture(domains, model)


def _helpers(keep: tuple[str, ...]) -> list[str]:
    return spare(list(keep), "n_tokens", "posterior", "rate", "copies")


def with_posteriors(docs: DataFrame, mixture: Mixture, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                    rates: bool = False) -> DataFrame:
    """``keep`` columns, the number of words, the posterior, whose entries sum to one, and,
    if ``rates``, the rate; under names that ``keep`` lacks."""
    own = text in keep
    at = keep.index(text) if own else len(keep)
    chosen = docs.select(*keep, *([] if own else [F.col(text).alias(spare(list(keep), "text")[0])]))
    shared = docs.sparkSession.sparkContext.broadcast(mixture.model)  # a table of fixed size
    k, steps, floor = len(mixture.domains), list(mixture.steps), mixture.floor
    names = _helpers(keep)[: 3 if rates else 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(at))
            p = shared.value.probabilities(data, offsets)
            words = [count_words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]) for a, b in pieces(offsets)]
            n = np.concatenate(words) if words else np.zeros(0, np.int64)
            posterior = pa.ListArray.from_arrays(np.arange(0, len(p) * k + 1, k, dtype=np.int32), pa.array(p.ravel()))
            rate = [pa.array(rates_after(steps, floor, p))] if rates else []
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(n.astype(np.int64)), posterior, *rate], [*keep, *names])

    kinds = ["bigint", "array<double>", "double"]
    schema = [*chosen.dtypes[: len(keep)], *zip(names, kinds)]
    return chosen.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in schema))


def _sums(table: DataFrame, of) -> np.ndarray:
    """Sums over all rows of the vectors that ``of(tokens, posteriors)`` makes of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            n = batch.column(0).to_numpy().astype(float)
            if len(n):
                part = of(n, batch.column(1).flatten().to_numpy().reshape(len(n), -1))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["i", "x"])

    parts = table.mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x"))
    return np.array([r.x for r in parts.orderBy("i").collect()])  # a vector of fixed length


def _totals(table: DataFrame, mixture: Mixture) -> tuple[np.ndarray, float]:
    """Expected tokens of each domain at the present rates, and the move of the last step."""
    steps, floor = list(mixture.steps), mixture.floor  # what tasks need, without the classifier

    def of(n: np.ndarray, p: np.ndarray) -> np.ndarray:
        before, rate = _last_two(steps, floor, p)
        return np.r_[(n * rate) @ p, n @ (rate - before) ** 2, n.sum()]

    sums = _sums(table, of)
    if not len(sums):
        return np.zeros(len(mixture.domains)), 0.0
    return sums[:-2], float(np.sqrt(sums[-2] / max(1.0, sums[-1])))


def _gram(table: DataFrame, mixture: Mixture) -> np.ndarray:
    """Posteriors times posteriors, by tokens, in passes of some rows of the matrix."""
    k = len(mixture.domains)
    gram, height = np.zeros((k, k)), max(1, GRAM_ENTRIES // k)
    for a in range(0, k, height):
        sums = _sums(table, lambda n, p, a=a: ((p[:, a:a + height] * n[:, None]).T @ p).ravel())
        if len(sums):
            gram[a:a + height] = sums.reshape(-1, k)
    return gram


def fit_rates(docs: DataFrame, mixture: Mixture, weights: dict[str, float] | None = None,
              temper: float = 0.7, floor: float = 0.0, text: str = "text") -> Mixture:
    """Fit the rates of all ``docs``.

    ``weights`` are target shares by domain; by default the shares of the expected tokens
    to the power ``temper``, which lifts small domains.  Rates are ``floor`` or more.  The
    targets add up to the tokens there are, or to the least total at which no domain's
    target is under ``floor`` times its tokens; with a floor of one every document stays
    and small domains are repeated.  Rates that have not settled after :data:`STEPS` steps,
    each of which brings them nearer, are warned about.
    """
    table = written(with_posteriors(docs, mixture, text, ()))
    _fit(table, mixture, weights, temper, floor)
    discard(table)
    return mixture


def fit_and_rate(docs: DataFrame, mixture: Mixture, weights: dict[str, float] | None = None, temper: float = 0.7,
                 floor: float = 0.0, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """:func:`fit_rates` and :func:`with_rates` of the same rows, reading their texts once."""
    tokens, posterior, rate, _ = _helpers(keep)
    table = written(with_posteriors(docs, mixture, text, keep))
    _fit(table.select(tokens, posterior), mixture, weights, temper, floor)
    steps, floor = list(mixture.steps), mixture.floor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(posterior).flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
            yield batch.append_column(rate, pa.array(rates_after(steps, floor, p)))

    schema = ", ".join(f"`{n}` {t}" for n, t in [*table.dtypes, (rate, "double")])
    return _shown(_copied(table.mapInArrow(run, schema), keep), keep)


def _fit(table: DataFrame, mixture: Mixture, weights: dict[str, float] | None, temper: float, floor: float) -> None:
    mixture.steps, mixture.floor = [], floor
    gram, (totals, _) = _gram(table, mixture), _totals(table, mixture)
    shares = np.array([weights.get(d, 0.0) for d in mixture.domains]) if weights else totals**temper
    shares = shares / max(shares.sum(), 1e-300)
    scale = max([totals.sum(), *(floor * totals[shares > 0] / shares[shares > 0])])
    mixture.totals, mixture.targets, mixture.moved = totals, shares * scale, np.inf
    while not mixture.settled and len(mixture.steps) < STEPS:
        mixture.steps.append(np.linalg.lstsq(gram, totals - mixture.targets, rcond=1e-10)[0])
        totals, mixture.moved = _totals(table, mixture)
    if not mixture.settled:
        warnings.warn(f"rates still move by {mixture.moved:.1e} after {STEPS} steps", stacklevel=3)
    mixture.error = float(np.abs(totals - mixture.targets).max() / max(1.0, mixture.targets.sum()))


def _copied(rated: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    _, _, rate, copies = _helpers(keep)
    draw = F.pmod(F.xxhash64(F.lit("mixing"), *keep), F.lit(1 << 30)) / float(1 << 30)
    up = (draw < F.col(rate) - F.floor(rate)).cast("int")
    return rated.withColumn(copies, (F.floor(rate) + up).cast("int"))


def with_rates(docs: DataFrame, mixture: Mixture, text: str = "text",
               keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``n_tokens``, ``posterior``, ``rate`` and ``copies``.

    ``copies`` is the rate rounded up or down by a hash of the kept columns, so that its
    expectation is the rate and the same row is always rounded alike.  Null and empty texts
    have no tokens and the posterior of the training shares; repeated rows have one rate.
    Other columns are not read.  An empty table gives an empty one.
    """
    return _shown(_copied(with_posteriors(docs, mixture, text, keep, rates=True), keep), keep)


def _shown(rated: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    shown = zip(_helpers(keep), ("n_tokens", "posterior", "rate", "copies"))
    return rated.select(*keep, *[F.col(own).alias(name) for own, name in shown])


def resample(docs: DataFrame, mixture: Mixture, text: str = "text") -> DataFrame:
    """``docs`` with every row as often as its copies say; all columns, whatever their names."""
    keep = tuple(docs.columns)
    copies, copy = _helpers(keep)[3], spare(docs.columns, "copy")[0]
    rated = _copied(with_posteriors(docs, mixture, text, keep, rates=True), keep)
    times = F.explode(F.when(F.col(copies) > 0, F.sequence(F.lit(1), F.col(copies)))).alias(copy)
    return rated.select(*docs.columns, times).drop(copy)
