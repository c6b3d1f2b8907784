"""Merkle manifest against a tree built in one piece."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from flightops.llm import merkle
from flightops.llm.queries import op11_merkle_manifest
from tests.llm.edges import got, key, no_docs, odd_docs

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    values = [row["doc_id"], row["source"], row["lang"],
              None if row["n_chars"] is None else row["n_chars"] + more, row["text"]]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i:i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def steps(tree, i):
    for level in tree[:-1]:
        j = i ^ 1
        yield (j < i, level[j]) if j < len(level) else (False, "")
        i //= 2


def brute(rows):
    langs = sorted({r["lang"] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees, out = {}, []
    for lang in langs:
        own = sorted((r for r in rows if r["lang"] == lang), key=lambda r: (
            r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[lang] = own, levels([leaf(r) for r in own])
    top = levels([trees[x][1][-1][0] for x in langs]) if langs else []
    for n, lang in enumerate(langs):
        own, tree = trees[lang]
        for i, r in enumerate(own):
            path = [*steps(tree, i), *steps(top, n)]
            node = leaf(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0:
                node = leaf(r, 1)
            for left, other in path:
                node = h(other + node) if left else h(node + other)
            out.append((r["doc_id"], leaf(r), tree[-1][0], top[-1][0],
                        h("".join(o for _, o in path)), node, node == top[-1][0]))
    return sorted(out, key=key)


def rows_of(docs):
    return [r.asDict() for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def tampered(docs, **options):
    n_chars = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0,
                     F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return merkle.manifest(docs, {"n_chars": n_chars}, **options)


def test_tables(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert got(op11_merkle_manifest(spark, folder), *COLUMNS) == brute(rows_of(docs))


@pytest.mark.parametrize("bits", [10, 1])
def test_odd_cases(spark, bits):
    docs = odd_docs(spark)
    assert got(tampered(docs, bits=bits), *COLUMNS) == brute(rows_of(docs))


def test_no_rows(spark):
    assert tampered(no_docs(spark)).collect() == []


@pytest.mark.parametrize("n", [1, 70])
def test_sizes(spark, n):
    """Trees of several rounds, with last runs of one node, and equal rows in a third."""
    rows = [(i if i % 3 else 7, f"t{i}" if i % 3 else "same", "l" if i % 3 else None, "s", 4)
            for i in range(n)] + [(n, "x", f"lang{i}", None, None) for i in range(n % 7)]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert got(tampered(docs, bits=2), *COLUMNS) == brute(rows_of(docs))


def test_paths_lead_to_the_root(spark):
    """A proof serves without the table; a change of any field is found, and no change is not."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    changed = {"source": F.when(F.col("doc_id") % 5 == 0, F.lit("other")).otherwise(F.col("source"))}
    found = merkle.manifest(docs, changed).collect()
    for r in found:
        assert merkle.fold(r["leaf"], r["path"]) == r["root"]
        assert r["verified"] == (r["doc_id"] % 5 != 0)
    assert all(r["verified"] for r in merkle.manifest(docs).collect())
