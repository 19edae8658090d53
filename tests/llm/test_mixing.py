import numpy as np
import pytest

from shellsieve.llm import mixing

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    return docs, mixing.train_domains(docs, mixing.domains_of(docs, labels))


def solution(rated, mixture):
    rows = rated.collect()
    n = np.array([r.n_tokens for r in rows], float)
    p = np.array([r.posterior for r in rows])
    return n, p, np.array([r.rate for r in rows])


def test_posteriors_know_the_language(trained):
    docs, mixture = trained
    out = mixing.with_rates(docs, mixture, keep=("doc_id", "lang")).collect()
    assert all(abs(sum(r.posterior) - 1) < 1e-9 for r in out)
    right = [mixture.domains[int(np.argmax(r.posterior))].split("/")[0] == r.lang for r in out if r.n_tokens > 20]
    assert np.mean(right) > 0.95


def test_targets_are_met_and_rates_solve_the_least_squares(trained):
    docs, mixture = trained
    weights = {d: 1.0 for d in mixture.domains}
    mixing.fit_rates(docs, mixture, weights)
    n, p, rate = solution(mixing.with_rates(docs, mixture), mixture)
    totals = (n * rate) @ p
    assert (rate >= 0).all()
    assert np.allclose(totals, mixture.targets, atol=2e-3 * totals.sum())
    assert abs(mixture.targets.sum() - n.sum()) < 1
    assert np.allclose(mixture.rates(p), rate)
    once = {(r.doc_id, r.rate, r.copies) for r in mixing.fit_and_rate(docs, mixture, weights).collect()}
    assert once == {(r.doc_id, r.rate, r.copies) for r in mixing.with_rates(docs, mixture).collect()}


def test_rates_at_zero_are_a_minimum(trained):
    docs, mixture = trained
    weights = {d: float(d.startswith("en")) for d in mixture.domains}
    mixing.fit_rates(docs, mixture, weights)
    n, p, rate = solution(mixing.with_rates(docs, mixture), mixture)
    assert (rate == 0).sum() > 100
    gram = (p * n[:, None]).T @ p
    slope = p @ np.linalg.lstsq(gram, (n * rate) @ p - mixture.targets, rcond=1e-10)[0]
    full = n > 0  # no gain is left: the slope is none where the rate moves, and upward at zero
    assert np.abs(slope[full & (rate > 1e-6)]).max() < 0.05
    assert slope[full & (rate == 0)].min() > -0.05


def test_floor_keeps_every_document(trained):
    docs, mixture = trained
    mixing.fit_rates(docs, mixture, temper=0.85, floor=1.0)
    out = mixing.resample(docs, mixture)
    assert out.columns == docs.columns
    assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert docs.count() < out.count() < 2 * docs.count()
    n, p, rate = solution(mixing.with_rates(docs, mixture), mixture)
    got = (n * rate) @ p
    assert np.allclose(got / got.sum(), mixture.targets / mixture.targets.sum(), atol=0.02)
    mixing.fit_rates(docs, mixture)


def test_hard_targets_settle_and_tell_their_error(trained):
    docs, mixture = trained
    mixing.fit_rates(docs, mixture, {d: float(d.startswith("en")) for d in mixture.domains})
    assert mixture.settled and len(mixture.steps) > 3
    n, p, rate = solution(mixing.with_rates(docs, mixture), mixture)
    gap = np.abs((n * rate) @ p - mixture.targets).max() / mixture.targets.sum()
    assert mixture.error == pytest.approx(gap, rel=1e-6)
    mixing.fit_rates(docs, mixture)
    assert mixture.settled and mixture.error < 1e-6


def test_any_number_of_domains(spark, trained, monkeypatch):
    monkeypatch.setattr(mixing, "GRAM_ENTRIES", 700)
    docs, _ = trained
    labels = docs.filter("doc_id IS NOT NULL").selectExpr("doc_id", "concat('d', doc_id % 90) domain").distinct()
    mixture = mixing.train_domains(docs, labels, rows=400)
    assert len(mixture.domains) == 90
    table = mixing.with_posteriors(docs, mixture, keep=()).collect()
    n, p = np.array([float(r[0]) for r in table]), np.array([r[1] for r in table])
    frame = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n bigint, p array<double>")
    assert np.allclose(mixing._gram(frame, mixture), (p * n[:, None]).T @ p)
    monkeypatch.setattr(mixing, "STEPS", 3)
    with pytest.warns(UserWarning, match="still move"):
        mixing.fit_rates(docs, mixture)
    assert not mixture.settled and len(mixture.steps) == 3
    assert np.allclose(mixture.targets.sum(), n.sum())


def test_helper_names_give_way(spark, trained):
    docs, mixture = trained
    taken = docs.limit(5).selectExpr("*", "1 _rate", "2 _copies", "3 __copy", "4 _posterior", "5 _copy", "6 rate")
    out = mixing.resample(taken, mixture)
    assert out.columns == taken.columns
    assert {(r["_rate"], r["_copies"], r["__copy"], r["_posterior"], r["_copy"], r["rate"]) for r in out.collect()} <= {(1, 2, 3, 4, 5, 6)}


def test_edge_rows(spark, edge, edge_rows):
    labels = spark.createDataFrame([(4, "x"), (5, "y"), (6, "x"), (9, None), (None, "y")], "doc_id long, domain string")
    mixture = mixing.train_domains(edge, labels)
    mixing.fit_rates(edge, mixture)
    out = mixing.with_rates(edge, mixture).collect()
    assert sorted((r.doc_id for r in out), key=repr) == sorted((d for d, _ in edge_rows), key=repr)
    assert all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in out)
    assert mixing.resample(edge, mixture).columns == edge.columns
    empty = mixing.train_domains(edge.limit(0), labels.limit(0))
    mixing.fit_rates(edge.limit(0), empty)
    assert mixing.with_rates(edge.limit(0), empty).count() == 0
