"""The chain model against enumeration, and the fitted scores on held-out labels."""

import itertools
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from ripplenet.llm import toxicity


def test_marginals_by_enumeration():
    draw = np.random.default_rng(0)
    for n in (1, 2, 5):
        scores, t = draw.normal(size=n), draw.normal(size=(2, 2))
        weight = {}
        for path in itertools.product((0, 1), repeat=n):
            energy = sum(s for s, y in zip(scores, path, strict=True) if y)
            weight[path] = np.exp(energy + sum(t[a, b] for a, b in itertools.pairwise(path)))
        total = sum(weight.values())
        want = [sum(w for p, w in weight.items() if p[k]) / total for k in range(n)]
        model = toxicity.Model(np.zeros(toxicity.SLOTS), 0.0, t)
        got = toxicity._marginals(model, np.concatenate([scores, scores[:1]]), np.array([n, 1]))
        assert np.allclose(got[:n], want) and np.isclose(got[n], 1 / (1 + np.exp(-scores[0])))


def test_held_out_rows(spark):
    got = spark.range(200).select("id", toxicity.held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)


def test_every_chain_of_the_sample_is_trained_on(monkeypatch):
    rows = [("\n".join(f"you idiot{i % 7} scum w{i}x{k}" for k in range(40)), 1) for i in range(300)]
    rows += [("\n".join(f"fine day c{i}x{k}" for k in range(20)), 0) for i in range(150)]
    seen, train = [], toxicity._train

    def spied(*given):
        seen.append(given)
        return train(*given)

    monkeypatch.setattr(toxicity, "_train", spied)
    monkeypatch.setattr(toxicity, "STEPS", 5)
    toxicity.fit(rows, 0.5)
    assert sum(map(len, (toxicity.chains(t) for t, _ in rows))) == len(seen[0][2]) == 300 * 40 + 150 * 20


def test_batches_give_the_same_fit(monkeypatch):
    draw = np.random.default_rng(3)
    lengths = draw.integers(1, 12, 200)
    words = draw.integers(0, 50, int(lengths.sum()))
    table = draw.integers(0, 1000, (50, 4)).astype(np.int32)
    whole = toxicity._train(words, words < 5, lengths, table)
    monkeypatch.setattr(toxicity, "BATCH_TOKENS", 40)
    parts = toxicity._train(words, words < 5, lengths, table)
    assert sum(map(len, toxicity._batches(lengths))) == 200
    assert np.allclose(whole.weights, parts.weights, atol=1e-4) and np.allclose(whole.transitions, parts.transitions, atol=1e-4)


def test_evidence_is_counted_a_part_of_the_texts_at_a_time(monkeypatch):
    draw = np.random.default_rng(5)
    rows = [(" ".join(f"{'bad' if i % 2 and w < 40 else 'w'}{w}" for w in draw.integers(0, 20_000, 400)), i % 2) for i in range(3000)]
    sample = toxicity.Sample(rows + [(rows[k][0] + " end", 1) for k in range(1, 600, 2)])
    tracemalloc.start()
    words = sample.toxic_words()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert words.any() and not words.all()
    assert peak < 50e6  # 1.2 million words of texts; all of them at once took 78 MB
    monkeypatch.setattr(toxicity, "COPY_GROUPS", 10_000)
    assert (sample.toxic_words() == words).all()


@pytest.fixture(scope="module")
def scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = toxicity.toxicity(docs, labels).join(labels, "doc_id", "left").join(docs.select("doc_id", "text"), "doc_id")
    return out.collect()


def test_accuracy_on_held_out_labels(scores):
    held = [(r["predicted"], r["toxic"], r["score"]) for r in scores if r["held_out"] and r["toxic"] is not None]
    toxic = [p for p, y, _ in held if y == 1]
    clean = [p for p, y, _ in held if y == 0]
    assert sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.01 * len(clean)
    ranked = sorted(held, key=lambda x: x[2])
    places = [i for i, x in enumerate(ranked) if x[1] == 1]
    area = (sum(places) - len(toxic) * (len(toxic) - 1) / 2) / (len(toxic) * len(clean))
    assert area >= 0.94
    assert all(0 <= x[2] <= 1 for x in held)


def test_spans_are_the_toxic_words(scores):
    words = {r["text"][s["start"] : s["end"]].lower() for r in scores if r["predicted"] for s in r["spans"]}
    assert {"idiot", "scum", "worthless", "trash", "moron"} <= words


def test_rows_without_a_use_and_empty_tables(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1), (None, 1), (4, None), (5, 0), (1, 0), (99, 1)], "doc_id bigint, toxic int")
    got = toxicity.toxicity(odd_documents.withColumn("score", F.lit("x")), labels).collect()
    assert len(got) == odd_documents.count() and all(0 <= r["score"] <= 1 for r in got)
    none = toxicity.toxicity(odd_documents, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0}
    assert toxicity.toxicity(no_documents, labels).collect() == []
