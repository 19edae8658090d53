"""One registered query per operator, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shellsieve.llm import (
    decontaminate,
    lines,
    mixing,
    naming,
    pii,
    secrets,
    sharding,
    simhash,
    spans,
    spelling,
    substrings,
    topk,
    toxicity,
    trie,
)
from shellsieve.llm.storage import ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.digest(pii.find_pii(_table(spark, sf_dir, "documents")), pii.KINDS)


def op2_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4, radius=4)
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = _table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    dealt = sharding.shuffle_into_shards(rows, shards=40)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op4_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(_table(spark, sf_dir, "documents"), window=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents, one row each, with what they hold and where."""
    found = decontaminate.find_benchmark(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    held = F.transform("matches", lambda m: F.concat_ws(
        ":", *[m[c].cast("string") for c in ("item_id", "first_word", "n_words", "bits")]))
    best = F.array_max(F.transform("matches", lambda m: m["similarity"]))
    return found.filter(F.size("matches") > 0).select(
        "doc_id", F.concat_ws(",", held).alias("matches"), F.round(best, 6).alias("similarity"))


def op6_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train_toxicity(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op7_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    mixture = mixing.train_domains(docs, mixing.domains_of(docs, _table(spark, sf_dir, "labels")))
    rated = mixing.fit_and_rate(docs, mixture)
    best = F.array_position("posterior", F.array_max("posterior")).cast("int")
    return rated.select(
        "doc_id", "n_tokens", F.get(F.array(*map(F.lit, mixture.domains)), best - 1).alias("domain"),
        F.array_max("posterior").alias("probability"), "rate", "copies", F.lit(mixture.error).alias("error"))


def op8_bloom_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_shared_lines(_table(spark, sf_dir, "documents"), least=20, documents=3)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op9_nested_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.digest(secrets.scan_secrets(_table(spark, sf_dir, "documents")), secrets.KINDS)


def op10_sorted_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


def op11_partenum_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op12_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[native] DataFrame functions only."""
    return naming.exact_duplicates(_table(spark, sf_dir, "documents"))


def op13_euler_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"), every=20).drop("enter", "leave")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_skip_chain_pii, op2_simhash_pivots, op3_hypergeometric_shards, op4_block_anchors,
        op5_simhash_windows, op6_subword_toxicity, op7_soft_mixing, op8_bloom_lines,
        op9_nested_secrets, op10_sorted_lists, op11_partenum_spelling,
        op12_block_naming, op13_euler_trie,
    )
}
