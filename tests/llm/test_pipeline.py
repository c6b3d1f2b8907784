"""The corpus pipeline, its SQL and its registration."""

import gc
import os
import weakref

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from flightops.llm.common import RECENT, documents, stored
from flightops.llm.sql import oracle_sql as llm_sql
from tests.compare import connect, difference
from tests.llm.edges import no_docs, odd_docs
from tests.llm.test_simhash import brute_classes, brute_print

FOLDER = "/root/testdata/sf0.001"
NAMES = ["quality rules", "simhash near-dedup", "benchmark decontamination", "source mixing",
         "token files"]


def test_stored_frames_leave_the_driver(spark):
    # the driver's memory must not grow with the frames that a session has stored
    frames, tables = [], []
    for n in range(RECENT + 8):
        df = spark.range(1).selectExpr(f"id + {n} AS v")
        tables.append(stored(df, "s"))
        frames.append(weakref.ref(df))
    last = df
    del df
    gc.collect()
    assert sum(f() is not None for f in frames) <= RECENT
    assert stored(last, "s") is tables[-1]
    assert [t.first().v for t in tables] == list(range(RECENT + 8))  # what was stored stays
    again = stored(spark.range(1).selectExpr("id + 0 AS v"), "s")
    assert again is not tables[0] and again.first().v == 0


def test_registered():
    names = [n for n in queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in queries() and set(llm_sql()) <= set(oracle_sql()) & set(queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES


@pytest.mark.parametrize("name", sorted(llm_sql()))
def test_query_equals_sql(spark, name):
    folder = "/root/testdata/sf0.01" if os.environ.get("FLIGHTOPS_ALL") else FOLDER
    con = connect(folder)
    assert difference(queries()[name](spark, folder), con, llm_sql()[name]) is None


def test_stages(spark):
    """Each stage on all that the one before kept, against plain Python."""
    docs = documents(spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, docs, FOLDER), "stage-test")
        assert after.columns == docs.columns
        kept[name] = [r.asDict() for r in after.collect()]
        docs = after
    first = {r["doc_id"] for r in kept[NAMES[0]]}
    all_ids = {r["doc_id"] for r in documents(spark, FOLDER).collect()}
    assert first < all_ids and all(len(r["text"].split()) >= 50 for r in kept[NAMES[0]])
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    assert len(good & first) >= 0.8 * len(good)
    prints = {r["doc_id"]: brute_print(r["text"]) for r in kept[NAMES[0]]}
    classes, smallest = brute_classes(set(prints.values())), {}
    for d in sorted(prints):
        smallest.setdefault(classes[prints[d]], d)
    assert {r["doc_id"] for r in kept[NAMES[1]]} == set(smallest.values())
    third = {r["doc_id"] for r in kept[NAMES[2]]}
    for r in kept[NAMES[1]]:
        if any(i in r["text"] for i in items):
            assert r["doc_id"] not in third
    assert len(third) >= 0.8 * len(smallest)
    size = lambda rows: sum(len(r["text"].split()) for r in rows)
    assert abs(size(kept[NAMES[3]]) - 1.5 * size(kept[NAMES[2]])) <= 30
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert sorted(r["doc_id"] for r in last.collect()) == sorted(
        r["doc_id"] for r in kept[NAMES[3]])


def test_run(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert rows and sum(r["n_tokens"] for r in rows) == max(
        r["start"] + r["n_tokens"] for r in rows)


@pytest.mark.parametrize("make", [odd_docs, no_docs])
def test_odd_cases(spark, make):
    docs = make(spark)
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, FOLDER), "stage-test")
        if name != NAMES[-1]:
            assert after.columns == docs.columns
            assert after.count() <= 2 * docs.count()
