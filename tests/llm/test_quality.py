"""Quality rules against brute force."""

import math
import re
from collections import Counter

from flightops.llm import quality
from tests.llm.edges import got, key, no_docs, odd_docs, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen, repeated = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            repeated |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(repeated), failed)


COLUMNS = ("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
           "n_repeat_words", "base_failed")


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_base_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    assert got(quality.quality_rules(docs, labels), *COLUMNS) == sorted(
        ((d, *base(t)) for d, t in rows), key=key)


def test_odd_cases(spark):
    found = quality.quality_rules(odd_docs(spark), no_labels(spark))
    assert got(found, *COLUMNS) == sorted(
        ((d, *base(t)) for d, t, _, _ in odd_rows()), key=key)
    assert {r["score"] for r in found.collect()} == {0.0}
    assert found.where("kept").select("row.*").columns == odd_docs(spark).columns
    assert quality.quality_rules(no_docs(spark), no_labels(spark)).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 1), (2, None, None)],
                                   "doc_id long, quality int, toxic int")
    assert quality.quality_rules(odd_docs(spark), labels).count() == len(odd_rows())


def test_both_ways_of_finding_repeats(spark):
    text = " ".join(f"{i} {i + 1} {i + 2}" for i in range(40)) * 2
    docs = spark.createDataFrame([(1, text), (2, "a b c d a b c")], "doc_id long, text string")
    found = quality.quality_rules(docs, no_labels(spark))
    assert got(found, "row.doc_id", "n_repeat_words") == [(1, base(text)[4]), (2, 6)]
    assert len({tuple(text.split()[i:i + 3]) for i in range(120)}) > quality.LOOKED_UP


def test_likelihood_ratio(spark):
    """Against counts of the n-grams themselves; few n-grams, so buckets rarely collide."""
    docs = spark.createDataFrame(
        [(1, "a b c"), (2, "a b"), (3, "x y z"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    buckets = 1 << 16
    grams = lambda t: (w := (t or "").split()) + list(zip(w, w[1:]))
    texts = {1: "a b c", 2: "a b", 3: "x y z", 4: None}
    raw, target = Counter(), Counter(grams(texts[1]))
    for t in texts.values():
        raw.update(grams(t))
    n, m = sum(raw.values()) + buckets, sum(target.values()) + buckets
    weight = {g: math.log((target[g] + 1) / m) - math.log((raw[g] + 1) / n) for g in raw}
    for r in quality.quality_rules(docs, labels, buckets=buckets).select(
            "row.doc_id", "score").collect():
        parts = [weight[g] for g in grams(texts[r["doc_id"]])]
        assert math.isclose(r["score"], sum(parts) / max(1, len(parts)), abs_tol=1e-9)


def test_keeps_good_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = quality.quality_rules(docs, labels).select("row.doc_id", "kept", "base_failed").join(
        labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    count = {(r["quality"], r["kept"]): r["count"] for r in found}
    assert count.get((1, False), 0) <= 0.01 * count[1, True]
    assert count.get((0, True), 0) <= 0.1 * count[0, False]


def test_keeps_good_documents_outside_the_target(spark):
    """One good document in five has no label; they are kept like the others."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    left_out = "quality = 1 and pmod(hash(doc_id), 5) = 0"
    found = quality.quality_rules(docs, labels.where(f"not ({left_out})")).select(
        "row.doc_id", "kept", "base_failed").where("not base_failed")
    unseen = found.join(labels.where(left_out), "doc_id").groupBy("kept").count().collect()
    count = {r["kept"]: r["count"] for r in unseen}
    assert count[True] >= 50 and count.get(False, 0) <= 0.05 * count[True]


def test_score_without_own_counts(spark):
    texts = ["a b c a b", "a b", "b c d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = lambda ids: spark.createDataFrame(
        [(i, 1, 0) for i in ids], "doc_id long, quality int, toxic int")
    score = lambda good, ids, unseen: {r["t"]: r["score"] for r in quality._measured(
        good, quality.weights(docs, quality.good_texts(docs, labels(ids)), 64), 64, 1.0, unseen
    ).select(quality.F.col("row.text").alias("t"), "score").collect()}
    unseen = score(quality.good_texts(docs, labels([0, 1])), [0, 1], True)
    for i, other in ((0, 1), (1, 0)):
        assert math.isclose(unseen[texts[i]], score(docs, [other], False)[texts[i]], abs_tol=1e-9)
