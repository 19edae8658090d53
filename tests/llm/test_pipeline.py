"""Each stage on its own input, against the rules it stands for."""

from collections import Counter

import pytest

import corpus_pipeline
from shellsieve.llm.toxicity import held_out
from test_simhash import plain_components, plain_fingerprint

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, FOLDER)
        after.write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out.append((name, docs, after))
        docs = after
    return {name: (a, b) for name, a, b in out}


def ids(frame):
    return [r.doc_id for r in frame.select("doc_id").collect()]


def test_stages_and_columns(steps, spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    columns = spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    for name, (_, after) in steps.items():
        assert after.columns[: len(columns)] == columns
        assert len(after.columns) == len(columns) or name == "sharding"


def test_toxic_documents_go(steps, spark):
    before, after = steps["toxicity"]
    kept = set(ids(after))
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").filter(~held_out()).collect()
    clean, toxic = ({r.doc_id for r in labels if r.toxic == value} for value in (0, 1))
    assert toxic and len(toxic & kept) <= 0.1 * len(toxic)
    assert len(clean & kept) >= 0.97 * len(clean)


def test_one_of_each_group_stays(steps):
    before, after = steps["near_dedup"]
    found = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in before.collect()])
    assert sorted(ids(after)) == sorted({c for *_, c in found})


def test_passages_go(steps, spark):
    before, after = steps["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    verbatim = {r.doc_id for r in before.collect() if any(t in r.text for t in items)}
    gone = set(ids(before)) - set(ids(after))
    assert verbatim <= gone and len(gone - verbatim) <= 2


def test_mixing_keeps_every_document(steps):
    before, after = steps["mixing"]
    assert set(ids(before)) == set(ids(after))


def test_shards_hold_every_row(steps):
    before, after = steps["sharding"]
    assert Counter(ids(before)) == Counter(ids(after))
    sizes = Counter(r.shard for r in after.select("shard").collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 40


def test_run_equals_the_stages(steps, spark):
    got = Counter(map(tuple, corpus_pipeline.run(spark, FOLDER).select("doc_id", "shard", "slot").collect()))
    assert got == Counter(map(tuple, steps["sharding"][1].select("doc_id", "shard", "slot").collect()))
