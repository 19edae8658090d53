import random

import numpy as np
import pyarrow as pa

from shellsieve.llm import toxicity
from shellsieve.llm.classifier import SubwordClassifier, bags
from shellsieve.llm.subwords import Subwords
from shellsieve.llm.tokens import buffers

INSULTS = ["idiotic", "worthless", "disgusting", "pathetic"]


def corpus(n=800, seed=6):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 200))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(1 + len(words) // 30):
                words[rng.randrange(len(words))] = rng.choice(INSULTS)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_misspellings(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train_toxicity(docs, table)
    held = docs.filter(toxicity.held_out())
    scored = {r.doc_id: r.predicted for r in toxicity.score_toxicity(held, model).collect()}
    truth = dict(labels)
    assert len(scored) > 100
    assert np.mean([truth[i] == p for i, p in scored.items()]) > 0.95
    others, known = corpus(120, seed=99)
    misspelt = {"idiotic": "idiotical", "worthless": "worthles", "disgusting": "disgustin", "pathetic": "patthetic"}
    texts = [" ".join(misspelt.get(w, w) for w in t.split()) for _, t in others]
    assert not any(w in INSULTS for t in texts for w in t.split())
    score = model.probabilities(*buffers(pa.array(texts)))[:, 1]
    toxic = np.array([t for _, t in known]) == 1
    # None of these words was seen; what they share with seen ones ranks them above clean texts.
    above = (score[toxic][:, None] > score[~toxic][None, :]).mean()
    assert above > 0.9 and (score[~toxic] >= 0.5).mean() < 0.05


def test_held_out_labels_do_not_matter(spark):
    rows, labels = corpus(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = {r.doc_id for r in docs.filter(toxicity.held_out()).collect()}
    tables = [spark.createDataFrame([(i, 1 - t if i in held and flip else t) for i, t in labels], "doc_id long, toxic int")
              for flip in (False, True)]
    a, b = (toxicity.train_toxicity(docs, t) for t in tables)
    assert (a.table == b.table).all() and (a.bias == b.bias).all()


def test_held_out_is_the_crc_of_the_id(spark):
    import zlib

    got = {r.id for r in spark.range(100).filter(toxicity.held_out("id")).collect()}
    assert got == {i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_scores_are_those_of_the_averaged_embedding():
    rows, labels = corpus(60)
    data, offsets = buffers(pa.array([t for _, t in rows] + [""]))
    found = list(bags(data, offsets, 1 << 12, (3, 4)))
    model = SubwordClassifier(2, 1 << 12, (3, 4)).fit(found[:-1], np.array([t for _, t in labels]), updates=6)
    p = model.probabilities(data, offsets)
    for (index, value), got in zip(found, p):
        logits = value.astype(float) @ model.table[index] + model.bias
        assert np.isclose(got[1], 1 / (1 + np.exp(logits[0] - logits[1])), atol=1e-4)


def test_parts_of_words():
    data, offsets = buffers(pa.array(["Ab, été", None, "ab"]))
    parts = Subwords(data, offsets, 1 << 16)
    assert parts.counts.tolist() == [2, 0, 1]
    by_word = [set(parts.bucket[parts.word == w].tolist()) for w in range(3)]
    assert by_word[0] == by_word[2]  # <ab>: two n-grams of 3, one of 4, itself
    assert parts.parts_per_word().tolist() == [4, 7, 4]


def test_edge_rows(spark, edge, edge_rows):
    table = spark.createDataFrame([(4, 1), (5, 0), (5, None), (None, 1), (9, 0)], "doc_id long, toxic int")
    model = toxicity.train_toxicity(edge, table)
    out = toxicity.score_toxicity(edge, model).collect()
    assert sorted((r.doc_id for r in out), key=repr) == sorted((d for d, _ in edge_rows), key=repr)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    kept = toxicity.drop_toxic(edge, model)
    assert kept.columns == edge.columns
    assert kept.count() == sum(r.predicted == 0 for r in out)
    none = toxicity.train_toxicity(edge, table.limit(0))
    assert {r.predicted for r in toxicity.score_toxicity(edge, none).collect()} == {0}
    assert toxicity.score_toxicity(edge.limit(0), none).count() == 0
