"""SimHash classes against brute force."""

import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from flightops.llm import simhash
from tests.llm.edges import key, no_docs, odd_docs, odd_rows


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(values):
    """Class of each value: links of up to three bits, closed."""
    values, parent = list(values), {}
    parent.update((v, v) for v in values)

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    return {v: root(v) for v in values}


def expected(rows):
    prints = [(d, brute_print(t)) for d, t in rows]
    classes = brute_classes({p for _, p in prints})
    smallest = {}
    for d, p in prints:
        c = classes[p]
        smallest[c] = min((x for x in (smallest.get(c), d) if x is not None), default=None)
    return sorted(((d, p, smallest[classes[p]]) for d, p in prints), key=key)


def found(df):
    return sorted(((r["doc_id"], r["print"] & (1 << 64) - 1, r["component_id"])
                   for r in df.collect()), key=key)


@pytest.mark.parametrize("many", [512, 3])
def test_tables(spark, many):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert found(simhash.near_duplicates(docs, many)) == expected(rows)


def test_odd_cases(spark):
    rows = [(d, t) for d, t, _, _ in odd_rows()]
    assert found(simhash.near_duplicates(odd_docs(spark))) == expected(rows)
    assert simhash.near_duplicates(no_docs(spark)).count() == 0


@pytest.mark.parametrize("many", [512, 8, 2])
def test_dense_classes(spark, many):
    """Many fingerprints around a few, so that keys have many members."""
    r, values = random.Random(many), set()
    for _ in range(4):
        centre = r.getrandbits(64)
        for _ in range(60):
            v = centre
            for _ in range(r.randint(0, 9)):
                v ^= 1 << r.choice((0, 1, 2, 3, 20, 31, 32, 33, 40, 62, 63))
            values.add(v)
    values |= {r.getrandbits(64) for _ in range(50)}
    signed = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(v,) for v in signed], "print long")
    rooted = simhash.classes(simhash.links(frame, many)).collect()
    ours = {v: v for v in signed} | {r["node"]: r["root"] for r in rooted}
    theirs = brute_classes(values)
    groups = lambda m, f: sorted(sorted(f(v) for v in m if m[v] == c) for c in set(m.values()))
    assert groups(ours, lambda v: v & (1 << 64) - 1) == groups(theirs, lambda v: v)


@pytest.mark.parametrize("many", [512, 2])
def test_highest_bit(spark, many):
    """A key of several members that differ in bit 63: linked at 2 bits, not at 24."""
    near = [5, 5 ^ (1 << 63) ^ 1, 5 ^ 2, 5 ^ 4]
    far = [5 ^ ((1 << 24) - 1) << 40]
    signed = np.array(near + far, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(v,) for v in signed], "print long")
    found = {(r["a"], r["b"]) for r in simhash.links(frame, many).collect()}
    assert found and all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in found)
    rooted = {r["node"]: r["root"] for r in simhash.classes(
        spark.createDataFrame(sorted(found), "a long, b long")).collect()}
    assert len({rooted.get(v, v) for v in signed[:4]}) == 1
    assert signed[4] not in set(rooted) | set(rooted.values())


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    rooted = simhash.classes(edges).collect()
    assert {r["root"] for r in rooted} == {0} and len(rooted) == 200


def test_one_of_each(spark):
    kept = simhash.one_of_each(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    rows = expected([(d, t) for d, t, _, _ in odd_rows()])
    want = {(c, p) for _, p, c in rows}
    have = [(r["doc_id"], brute_print(r["text"])) for r in kept.collect()]
    assert len(have) == len(set(have)) == len({c for c, _ in want})
    assert {d for d, _ in have} == {c for c, _ in want}
    assert simhash.one_of_each(no_docs(spark)).count() == 0
