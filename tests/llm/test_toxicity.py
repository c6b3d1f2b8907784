"""Toxicity: forward-backward against enumeration, and held-out accuracy."""

import itertools
import zlib

import numpy as np

from flightops.llm import toxicity
from tests.llm.edges import no_docs, odd_docs, odd_rows


def test_marginals_equal_enumeration():
    r = np.random.default_rng(1)
    x, step = r.normal(size=(3, 6)), r.normal(size=(2, 2))
    forward, backward = toxicity._chains(x, step)
    odds = forward * backward
    for i, row in enumerate(x):
        total, marked = 0.0, np.zeros(6)
        for states in itertools.product((0, 1), repeat=6):
            weight = np.exp(sum(row[t] * s for t, s in enumerate(states)) + sum(
                step[a, b] for a, b in zip(states, states[1:])))
            total += weight
            marked += weight * np.array(states)
        assert np.allclose(odds[i] / (1 + odds[i]), marked / total)


def test_fit_learns_words_and_chains():
    r = np.random.default_rng(2)
    plain = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(200):
        words = [str(w) for w in r.choice(plain, 20)]
        states = [0] * 20
        if i % 2:
            words[7:9] = ["nasty", "brute"]
            states[7:9] = [1, 1]
        rows.append((i % 2, words, states))
    tagger = toxicity.Tagger(toxicity.fit_field(rows))
    found = tagger.marginals([["w1", "nasty", "brute", "w3"], ["w1"] * 100, []])
    assert (found[0] > 0.5).tolist() == [False, True, True, False]
    assert not (found[1] > 0.5).any() and len(found[1]) == 100 and len(found[2]) == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = toxicity.toxicity(docs, toxicity.fit(docs, labels)).join(labels, "doc_id")
    rows = scored.where("held_out").select("toxic", "predicted", "score").collect()
    hits = sum(r["toxic"] and r["predicted"] for r in rows)
    assert hits >= 0.85 * sum(r["toxic"] for r in rows)
    assert hits >= 0.9 * sum(r["predicted"] for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_cases(spark):
    labels = spark.createDataFrame(
        [(i, 0, i % 2) for i in range(1, 10)] + [(None, 0, 1), (3, None, None), (2, 0, 0)],
        "doc_id long, quality int, toxic int")
    for docs in (odd_docs(spark), no_docs(spark)):
        for marks in (labels, labels.where("1 = 0")):
            found = toxicity.toxicity(docs, toxicity.fit(docs, marks)).collect()
            assert len(found) == docs.count()
            for r in found:
                assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
                assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(
                    str(r["doc_id"]).encode()) % 5 == 0)
    assert len(odd_rows()) == odd_docs(spark).count()


def test_refit_agrees(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    one, two = toxicity.fit(docs, labels), toxicity.fit(docs.repartition(5), labels)
    assert (one["weights"] == two["weights"]).all() and np.allclose(one["score"], two["score"])
