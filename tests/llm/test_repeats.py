"""Substring and suffix dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest

from flightops.llm import repeats
from flightops.llm.repeats import bytes_of, words_of
from flightops.llm.substring_dedup import substring_dedup
from flightops.llm.suffix_dedup import suffix_dedup
from tests.llm.edges import got, key, no_docs, odd_docs, odd_rows


def brute(rows, symbols, length):
    """(doc_id, symbols, removed) of every row."""
    first = {}
    split = [(d, float("inf") if d is None else d, symbols(t or "")) for d, t in rows]
    for _, place, found in split:
        for i in range(len(found) - length + 1):
            window = tuple(found[i:i + length])
            first[window] = min(first.get(window, place), place)
    for d, place, found in split:
        gone = np.zeros(len(found), bool)
        for i in range(len(found) - length + 1):
            if first[tuple(found[i:i + length])] < place:
                gone[i:i + length] = True
        yield d, found, gone


def expected_words(rows, length=13):
    return sorted(((d, len(w), int(g.sum()), " ".join(x for x, y in zip(w, g) if not y))
                   for d, w, g in brute(rows, str.split, length)), key=key)


def expected_bytes(rows, length=50):
    out = []
    for d, data, gone in brute(rows, lambda t: t.encode(), length):
        edges = np.diff(np.concatenate(([0], gone.astype(int))))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((d, len(data), int(gone.sum()), int((edges == 1).sum()),
                    hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=key)


def made(seed, n=90):
    r = random.Random(seed)
    words = ["ab", "c", "dé", "the", "of", "xyzzy"]
    pool = [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(8)]
    out = []
    for i in range(n):
        parts = [r.choice(pool) if r.random() < .5 else " ".join(
            r.choice(words) + str(r.randint(0, 9)) for _ in range(r.randint(1, 30)))
            for _ in range(r.randint(0, 4))]
        text = r.choice([" ".join(parts)] * 8 + [None, "a" * r.randint(0, 400),
                                                "ab " * r.randint(0, 300)])
        out.append((i if r.random() > .05 else None, text))
    return out + out[:5]


@pytest.mark.parametrize("batches", [1, 7])
@pytest.mark.parametrize("seed", [1, 2])
def test_words_and_bytes(spark, seed, batches):
    rows = made(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(substring_dedup(docs, batches=batches), "doc_id", "n_words", "n_removed",
               "kept") == expected_words(rows)
    assert got(suffix_dedup(docs, batches=batches), "doc_id", "n_bytes", "n_removed",
               "n_spans", "kept_sha256") == expected_bytes(rows)


@pytest.mark.parametrize("many", [0, 8])
@pytest.mark.parametrize("batches", [1, 7])
def test_spread_windows(spark, batches, many):
    """Names of several texts whose windows are spread over the receivers."""
    rows = made(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(substring_dedup(docs, batches=batches, many=many), "doc_id", "n_words",
               "n_removed", "kept") == expected_words(rows)
    assert got(suffix_dedup(docs, batches=batches, many=many), "doc_id", "n_bytes", "n_removed",
               "n_spans", "kept_sha256") == expected_bytes(rows)


def test_frequent_string_in_varying_context(spark):
    """No receiver gets all windows around a string that every document holds."""
    r, receivers = random.Random(6), 16
    least = "the same line stands in every document"
    texts = [f"{r.random()} {least} {r.random()}" for _ in range(600)]
    symbols, lengths = bytes_of(texts)
    order = np.arange(len(texts))
    largest = {}
    for many in (10 ** 6, 100):
        chunks = list(repeats.Windows(50, 24, receivers).chunks(
            symbols, lengths, repeats.BYTE_CODE))
        name, text, doc = (np.concatenate([c[i] for c in chunks]) for i in (4, 5, 6))
        at, smallest, flags = repeats._reduce([name], order[doc], text)
        blocks = repeats._blocks([(receiver, 0, 1, repeats._pack(
            (name[at][part], 5), (text[at][part], 5), (flags[part], 1), (smallest[part], 8)))
            for receiver, part in repeats._receivers(name[at])]).to_pylist()
        answers = [row for b in blocks for row in repeats._meet_names(
            repeats.pa.Table.from_pylist([b], repeats._blocks([]).schema), many).to_pylist()]
        got_back = repeats.pa.Table.from_pylist(answers, repeats._blocks([]).schema)
        spelled = repeats._Spelled(repeats._Names(got_back), chunks, order, receivers)
        assert spelled.blocks(0).num_rows
        texts_of_name = np.unique(spelled.name[:spelled.by_name], return_counts=True)[1]
        spread = np.bincount(spelled.to.astype(np.int64), minlength=receivers)
        largest[many] = int(max(texts_of_name, default=0)), spread
    assert largest[10 ** 6][0] >= 300 and not largest[10 ** 6][1].any()
    assert largest[100][0] <= 100
    assert largest[100][1].sum() > 5000 and largest[100][1].max() < 2 * largest[100][1].mean()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert got(suffix_dedup(docs, batches=5, many=100), "doc_id", "n_bytes", "n_removed",
               "n_spans", "kept_sha256") == expected_bytes(list(enumerate(texts)))


def test_other_lengths(spark):
    rows = made(3, 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(substring_dedup(docs, 5, 3, batches=3), "doc_id", "n_words", "n_removed",
               "kept") == expected_words(rows, 5)
    assert got(suffix_dedup(docs, 20, 8, batches=3), "doc_id", "n_bytes", "n_removed",
               "n_spans", "kept_sha256") == expected_bytes(rows, 20)


def test_odd_cases(spark):
    rows = [(d, t) for d, t, _, _ in odd_rows() if t is None or len(t) < 50000]
    docs = odd_docs(spark).where("text is null or length(text) < 50000")
    assert got(substring_dedup(docs, batches=4), "doc_id", "n_words", "n_removed",
               "kept") == expected_words(rows)
    assert got(suffix_dedup(docs, batches=4), "doc_id", "n_bytes", "n_removed", "n_spans",
               "kept_sha256") == expected_bytes(rows)
    assert substring_dedup(odd_docs(spark)).count() == len(odd_rows())
    assert substring_dedup(no_docs(spark)).count() == 0 == suffix_dedup(no_docs(spark)).count()


def test_long_text_over_chunks(spark):
    r = random.Random(5)
    text = " ".join(str(r.randint(0, 10 ** 6)) for _ in range(90000))  # several chunks
    docs = spark.createDataFrame([(1, text), (2, "start " + text[1000:] + " end")],
                                 "doc_id long, text string")
    found = {r["doc_id"]: r for r in suffix_dedup(docs, batches=2).collect()}
    assert found[1]["n_removed"] == 0 and found[2]["n_spans"] == 1
    assert found[2]["n_removed"] == len(text) - 1000 + found[2]["n_bytes"] - len(
        "start " + text[1000:] + " end")


def test_spans_and_symbols(spark):
    shared = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, shared), (2, "a b " + shared + " c")],
                                 "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in substring_dedup(docs).collect()}
    assert spans[1] == [] and [tuple(s) for s in spans[2]] == [(2, 22)]
    assert bytes_of(["é", ""])[1].tolist() == [2, 0]
    assert words_of(["a b", " ", "a"])[1].tolist() == [2, 0, 1]
