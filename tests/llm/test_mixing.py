"""Mixing against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from flightops.llm import mixing
from tests.llm.edges import got, key, no_docs, odd_docs, odd_rows


def targets(sizes):
    """Excess over twice a source's size is shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return out


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def expected(rows):
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want = targets({s: sizes[s] for _, _, s in rows})
    queues, out = defaultdict(list), []
    for d, t, s in rows:
        place = hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()
        queues[s].append((place, d is not None, d or 0, size(t), d))
    for s, queue in queues.items():
        start = 0
        for _, _, _, n, d in sorted(queue, key=lambda q: q[:4]):
            room = [int(want[s]) - start - r * sizes[s] for r in (0, 1)]
            out.append((d, n, sizes[s], round(want[s], 6), sum(
                max(0, min(n, r)) for r in room)))
            start += n
    return sorted(out, key=key)


def found(df):
    return sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"])
                   for r in df.collect()), key=key)


@pytest.mark.parametrize("range_rows", [1024, 4])
def test_tables(spark, range_rows):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    assert found(mixing.mix_sizes(docs, range_rows=range_rows)) == expected(rows)


def test_uneven_sources_and_repeats(spark):
    rows = [(i, "w " * (1 + i % 7), None if i % 50 == 0 else "abcdefg"[min(6, i % 30)])
            for i in range(400)] + [(5, "w w w w w w", "f")] * 3 + [(None, "w w", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    have, want = found(mixing.mix_sizes(docs, range_rows=16)), expected(rows)
    assert have == want
    by_source = {(r[2], r[3]): 0 for r in have}
    for r in have:
        assert r[4] <= 2 * r[1]
        by_source[r[2], r[3]] += r[4]


def test_odd_cases(spark):
    rows = [(d, t, s) for d, t, _, s in odd_rows()]
    assert found(mixing.mix_sizes(odd_docs(spark))) == expected(rows)
    assert mixing.mix_sizes(no_docs(spark)).count() == 0 == mixing.mix(no_docs(spark)).count()
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)],
                                  "doc_id long, text string, source string")
    assert found(mixing.mix_sizes(empty)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_mix_rows(spark):
    docs = odd_docs(spark)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    sizes = mixing.mix_sizes(docs).groupBy("doc_id").agg({"taken": "sum"})
    want = {r[0]: r[1] for r in sizes.collect() if r[1]}
    have = Counter()
    for r in mixed.collect():
        have[r["doc_id"]] += size(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert have == want
    assert got(docs.where("1 = 0"), "doc_id") == []


@pytest.mark.parametrize("cell_rows", [1 << 17, 16])
def test_budget_ends_in_the_order_of_finish_times(spark, cell_rows):
    """What is queued before the end fills the budget, in one range and in many."""
    rows = [(i, "w " * (1 + i % 7), None if i % 50 == 0 else "abcdefg"[min(6, i % 30)])
            for i in range(400)] + [(5, "w w", "f")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert found(mixing.mix_sizes(docs, cell_rows=cell_rows)) == expected(rows)
    times = mixing.virtual_times(docs, cell_rows=cell_rows)
    end = mixing.budget_end(times, cell_rows=cell_rows).first()["end"]
    given = {r["source_key"]: min(2 * r["source_size"], r["weight"] * end)
             for r in times.collect()}
    assert sum(given.values()) == pytest.approx(1.5 * sum(size(t) for _, t, _ in rows))
    entries = mixing.queue(times).where("size > 0").collect()
    assert {r["finish"] <= end for r in entries} == {True, False}
