"""Spelling variants of words, met by PartEnum signatures of their letters.

A word is a multiset of letters, that is a binary vector with a dimension for every (letter,
how many-eth).  One inserted or deleted letter changes one dimension, one replaced letter two,
so words one edit apart have vectors at Hamming distance two at most.

PartEnum: the dimensions are dealt over ``parts`` partitions by a hash, and a word has one
signature for every choice of all partitions but two: its vector on those.  Two differing
dimensions lie in two partitions at most, so some choice leaves them out, and words within
the distance share that signature exactly; no pair is lost.  Signatures are equi-joined.
Inside the join a candidate pair is first checked by lengths and by a 64-bit fold of the
vectors (folding never adds differences), then by the edit distance itself.

Every join is a merge join by hint: Spark sizes a written table by its compressed files, and one
that is exploded to 36 signatures a word as before it, and would send it through the driver.

Words are counted with partial sums before the exchange; a signature is a row of its own, so
one that many words share is split by adaptive execution, and only verified pairs come out.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellsieve.llm.storage import discard, written

LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Partitions of the dimensions; each word has ``parts * (parts - 1) / 2`` signatures.
PARTS = 9


def lower_ascii(run: Column) -> Column:
    plain = F.octet_length(run) == F.length(run)
    return F.when(plain, F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def count_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", every: int = 199,
                shortest: int = 6, least: int = 5) -> DataFrame:
    """``word`` and ``n``: the words of all texts of ``shortest`` letters and ``least`` occurrences.

    A run of letters loses one, chosen by the CRC-32 of id and run, if ``every`` divides it.
    """
    runs = docs.select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col(text), F.lit(f"({LETTERS})"), F.lit(1))).alias("raw"),
    ).filter(F.length("raw") >= shortest)
    lowered = runs.select("id", lower_ascii(F.col("raw")).alias("run"))
    told = lowered.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = told.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def with_vectors(words: DataFrame, parts: int) -> DataFrame:
    """``sides``: a hash of the word's vector on each partition; ``fold``: all of it in 64 bits."""
    letters = F.array_sort(F.regexp_extract_all(F.col("word"), F.lit("(?s)."), F.lit(0)))
    listed = words.withColumn("letters", letters)
    dimensions = F.transform(F.col("letters"), lambda c, i: F.xxhash64(c, i + 1 - F.array_position(F.col("letters"), c)))
    listed = listed.withColumn("dims", dimensions)

    def side(part: int) -> Column:
        return F.xxhash64(F.lit(part), F.filter("dims", lambda d: F.pmod(d, F.lit(parts)) == part))

    sides = F.array(*map(side, range(parts)))
    fold = F.aggregate("dims", F.lit(0).cast("long"), lambda a, d: a.bitwiseXOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(d, 58).cast("int"))))
    return listed.select("word", "n", F.length("word").alias("size"), fold.alias("fold"), sides.alias("sides"))


def near_pairs(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """``(a, a_n, b, b_n)``, ``a < b``: the pairs of words that are one edit apart."""
    vectors = written(with_vectors(words, parts))
    signatures = [
        F.xxhash64(F.lit(i), *[F.col("sides")[p] for p in range(parts) if p not in left_out])
        for i, left_out in enumerate(combinations(range(parts), 2))]
    signed = vectors.select("word", "n", "size", "fold", F.explode(F.array(*signatures)).alias("signature"))
    a, b = (signed.select("signature", *[F.col(c).alias(f"{s}_{c}") for c in ("word", "n", "size", "fold")]) for s in "ab")
    close = (
        (F.col("a_word") < F.col("b_word"))
        & (F.abs(F.col("a_size") - F.col("b_size")) <= 1)
        & (F.bit_count(F.col("a_fold").bitwiseXOR(F.col("b_fold"))) <= 2)
        & (F.levenshtein("a_word", "b_word", 1) == 1)
    )
    met = a.join(b.hint("merge"), (a["signature"] == b["signature"]) & close)
    return met.select(F.col("a_word").alias("a"), "a_n", F.col("b_word").alias("b"), "b_n").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of every word that has a form; steps double until nothing changes."""
    roots = written(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = written(roots.join(ahead.hint("merge"), "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        discard(roots)
        roots = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return roots
        roots._shared_path = after._shared_path


def spelling_variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", every: int = 199, shortest: int = 6,
                      least: int = 5, times: int = 5, parts: int = PARTS) -> DataFrame:
    """One row per word: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    Words are counted by :func:`count_words`.  Two are near if one inserted, deleted or
    replaced letter turns one into the other.  ``form`` is the near word of largest ``n``
    (the smallest by code points where several tie) if it is ``times`` as frequent, else null;
    ``root`` is where following the forms ends, the word itself if it has none.

    A null text has no words; a null id is written as the empty text in front of a run;
    repeated rows count again.  Other columns are not read.  An empty table gives none.
    """
    words = written(count_words(docs, text, doc_id, every, shortest, least))
    pairs = written(near_pairs(words, parts))
    both = pairs.select(F.inline(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))))
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    often = -F.col("best.less") >= F.col("n") * times
    judged = written(words.join(best.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(often, F.col("best.other")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n")))
    roots = _roots(judged.filter("form IS NOT NULL"))
    return judged.join(roots.hint("merge"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
