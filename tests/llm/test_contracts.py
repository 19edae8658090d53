"""The registered queries without SQL, column by column, over the whole small tables."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shellsieve.llm import queries
from test_simhash import plain_components, plain_fingerprint

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


def test_op2(spark, texts):
    rows = queries.op2_simhash_pivots(spark, FOLDER).collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == {i: plain_fingerprint(t) for i, t in texts.items()}
    assert all(len(r.fingerprint) == 16 and r.fingerprint == r.fingerprint.lower() for r in rows)
    expected = {x[0]: x[-1] for x in plain_components([(i, plain_fingerprint(t)) for i, t in texts.items()])}
    assert {r.doc_id: r.component_id for r in rows} == expected


def test_op3(spark, texts):
    rows = queries.op3_hypergeometric_shards(spark, FOLDER).collect()
    raw = {i: (t or "").encode() for i, t in texts.items()}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == {i: (len(b) + 16, zlib.crc32(b)) for i, b in raw.items()}
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}
    shards = Counter(r.shard for r in rows)
    assert set(shards) == set(range(40)) and max(shards.values()) - min(shards.values()) <= 1
    for shard, n in shards.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))


def test_op6(spark, texts):
    rows = queries.op6_subword_toxicity(spark, FOLDER).collect()
    assert {r.doc_id: r.held_out for r in rows} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in texts}
    assert all(0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_op7(spark, texts):
    rows = queries.op7_soft_mixing(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    words = {i: len((t or "").encode().split()) for i, t in texts.items()}
    assert {r.doc_id: r.n_tokens for r in rows} == words
    assert all(r.rate >= 0 and 0 < r.probability <= 1 and r.copies in (int(r.rate), int(r.rate) + 1) for r in rows)
    assert len({r.domain for r in rows}) > 1


@pytest.fixture(scope="module")
def edge_folder(spark, edge, tmp_path_factory):
    """Tables of edge rows under documents of all kinds, with extra columns of clashing names."""
    folder = str(tmp_path_factory.mktemp("edge"))
    plain = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = edge.withColumns({"doc_id": F.col("doc_id") + 10**6, "lang": F.lit(None).cast("string"),
                            "source": F.lit("edge"), "n_chars": F.length("text").cast("long")})
    docs = plain.unionByName(odd, allowMissingColumns=True)
    docs.write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_pipeline_takes_edge_rows(spark, edge_folder):
    docs = spark.read.parquet(f"{edge_folder}/documents.parquet")
    out = corpus_pipeline.run(spark, edge_folder)
    own = ("shard", "slot")  # the last stage's own columns take the place of such
    assert [c for c in out.columns if c not in own] == [c for c in docs.columns if c not in own]
    rows = out.select("doc_id", "source", "shard", "slot").collect()
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    odd = {r.doc_id for r in rows if r.source == "edge"}
    # Null, empty and blank texts have fingerprint zero: one group, of which the least id stays.
    assert 10**6 + 1 in odd and not {10**6 + 2, 10**6 + 3} & odd
    # Equal long texts: one stays, whole.
    assert (10**6 + 4 in odd) and (10**6 + 5 not in odd)


def test_pipeline_takes_empty_tables(spark, edge_folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{edge_folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
