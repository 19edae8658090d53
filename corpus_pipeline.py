"""From documents to training shards: five stages, each one of the llm operators.

Toxic documents go, copies go (one document of each group stays), documents with benchmark
passages go, small domains are repeated up to their target weights (no document goes), and
what remains is shuffled into shards of equal size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shellsieve.llm import decontaminate, mixing, sharding, simhash, toxicity
from shellsieve.llm.storage import ship_package, written

SHARDS = 40
#: Classifiers, fingerprints and seeded draws have no SQL; the tests use brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.train_toxicity(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return simhash.keep_one(docs, width=4, radius=4)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    mixture = mixing.train_domains(docs, mixing.domains_of(docs, labels))
    return mixing.resample(docs, mixing.fit_rates(docs, mixture, temper=0.85, floor=1.0))


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return sharding.shuffle_into_shards(docs, shards=SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_domains),
    ("sharding", deal_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
