"""Merkle manifest of a dataset: leaves, one tree per language, a tree over their roots, proofs.

The leaf of a row is the SHA-256 of its fields, each with its length in front. The leaves of a
language stand in the order of doc_id; runs of two nodes become their hash until one is left,
the language's ``subroot``, and the subroots, in the order of the languages, likewise give the
``root``. Hashes are lowercase hex and are hashed as text.

Leaves get their places by a range shuffle, so no language is sorted in one task. Aligned
superblocks of 2^``bits`` nodes are the unit of work: going up, each superblock becomes one
node of the next round, until every tree has one node. Going down, the nodes of a superblock
are cogrouped with the outer nodes that it needs (the path of its own root), and one
``applyInPandas`` call finishes the reduction inside, joins the inner and outer siblings to
proofs and folds them. What meets in a call is one
superblock and one path.

A path lists, level by level to the root, ``<`` and the hash of a left sibling, ``>`` and that
of a right one, or ``=`` for a node that is hashed alone.

Defined results: a null field is ``-``; null lang is a language of its own, the first; null
doc_ids come first; rows of one doc_id are ordered by leaf, so that equal rows, which may hold
a third of the table, have neighbouring places and a proof each; empty text is ``0:``; very
long texts are hashed whole, in the row; an empty table gives no rows; other columns, of
whatever name, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightops.llm.common import placed, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BITS = 10  # levels of a superblock; it has 1,024 nodes


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: Mapping[str, Column]) -> Column:
    return F.sha2(F.concat(*[_field(values[c]) for c in FIELDS]), 256)


def leaves(docs: DataFrame, changed: Mapping[str, Column] | None = None) -> DataFrame:
    """Tree, doc_id and leaf of each row; ``forged`` is the leaf of the changed row, if it differs."""
    values = {c: F.col(c) for c in FIELDS}
    forged = F.lit(None).cast("string")
    if changed:
        differs = F.lit(False)
        for name, value in changed.items():
            differs = differs | ~F.col(name).eqNullSafe(value)
        forged = F.when(differs, leaf_hash(values | dict(changed)))
    return docs.select(
        # null before any text
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")).alias("tree"), "doc_id",
        leaf_hash(values).alias("node"), forged.alias("forged"))


def _hashed(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(nodes: list[str], total: int, bits: int) -> list[list[str]]:
    """The levels of a superblock of a tree with ``total`` nodes in this round."""
    levels = [nodes]
    for _ in range(min(bits, (total - 1).bit_length())):
        below = levels[-1]
        levels.append([_hashed("".join(below[i:i + 2])) for i in range(0, len(below), 2)])
    return levels


def _path(levels: list[list[str]], i: int) -> list[str]:
    """Siblings of node ``i`` inside its superblock."""
    path = []
    for level in levels[:-1]:
        if i ^ 1 < len(level):
            path.append(("<" if i & 1 else ">") + level[i ^ 1])
        else:
            path.append("=")
        i >>= 1
    return path


def fold(node: str, path: list[str]) -> str:
    """The root that a node and its path lead to."""
    for step in path:
        if step[0] == "<":
            node = _hashed(step[1:] + node)
        else:
            node = _hashed(node + step[1:])  # nothing follows "="
    return node


def proof_hash(path: list[str]) -> str:
    return _hashed("".join(step[1:] for step in path))


def _block(bits: int) -> Column:
    return F.shiftright("place", bits).alias("block")


def _reduced(nodes: DataFrame, bits: int) -> DataFrame:
    """One node per superblock."""
    def reduce(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("place")
        top = _levels(block["node"].tolist(), int(block["total"].iloc[0]), bits)[-1]
        left = (int(block["total"].iloc[0]) - 1 >> bits) + 1
        return pd.DataFrame({"tree": [key[0]], "place": [key[1]], "total": [left], "node": top})

    return nodes.select("tree", "place", "total", "node", _block(bits)).groupBy(
        "tree", "block").applyInPandas(reduce, "tree string, place long, total long, node string")


def _rounds(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """The nodes of each round; the last has one node per tree."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("total")).first()[0] or 0) > 1:
        rounds.append(stored(_reduced(rounds[-1], bits), "merkle-nodes"))
    return rounds


def _paths(nodes: DataFrame, outer: DataFrame, bits: int) -> DataFrame:
    """The path of each node to the root, from the paths of the superblocks (tree, place, path)."""
    def join(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("place")
        levels = _levels(block["node"].tolist(), int(block["total"].iloc[0]), bits)
        upper = list(above["path"].iloc[0])
        paths = [_path(levels, i) + upper for i in range(len(block))]
        return pd.DataFrame({"tree": block["tree"], "place": block["place"], "path": paths})

    return nodes.select("tree", "place", "total", "node", _block(bits)).groupBy("tree", "block").cogroup(
        outer.withColumnRenamed("place", "block").groupBy("tree", "block")
    ).applyInPandas(join, "tree string, place long, path array<string>")


def _down(rounds: list[DataFrame], outer: DataFrame, bits: int) -> DataFrame:
    """From the path of each tree's last node to those of the nodes of the first round."""
    for nodes in reversed(rounds[:-1]):
        outer = stored(_paths(nodes, outer, bits), "merkle-paths")
    return outer


_PROVED = ("tree string, doc_id long, leaf string, subroot string, root string, path array<string>, "
           "proof_sha256 string, folded_root string")


def _proved(rows: DataFrame, outer: DataFrame, bits: int) -> DataFrame:
    """Leaves of a superblock and the outer path of its root: proofs and folded roots."""
    def prove(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("place")
        levels = _levels(block["node"].tolist(), int(block["total"].iloc[0]), bits)
        upper, subroot, root = (above[c].iloc[0] for c in ("path", "subroot", "root"))
        paths = [_path(levels, i) + list(upper) for i in range(len(block))]
        given = block["forged"].where(block["forged"].notna(), block["node"])
        return pd.DataFrame({
            "tree": block["tree"], "doc_id": block["doc_id"].astype("Int64"), "leaf": block["node"],
            "subroot": subroot, "root": root, "path": paths,
            "proof_sha256": [proof_hash(p) for p in paths],
            "folded_root": [fold(n, p) for n, p in zip(given, paths)],
        })

    return rows.withColumn("block", _block(bits)).groupBy("tree", "block").cogroup(
        outer.withColumnRenamed("place", "block").groupBy("tree", "block")
    ).applyInPandas(prove, _PROVED)


def manifest(docs: DataFrame, changed: Mapping[str, Column] | None = None,
             bits: int = BITS) -> DataFrame:
    """doc_id, leaf, subroot, root, path, proof_sha256, folded_root and verified of every row.

    ``changed`` gives other values of some fields, as found later: ``folded_root`` is what the
    changed row and the proof of the original one lead to, and ``verified`` whether that is the
    root.
    """
    rows = stored(placed(leaves(docs, changed), "tree", ["doc_id", "node"], "merkle-leaves"),
                  "merkle-leaves-placed")
    rounds = _rounds(rows, bits)
    # one row per language
    subroots = rounds[-1].select(F.col("tree").alias("lang_tree"), "node")
    tops = stored(placed(subroots.withColumn("tree", F.lit("")), "tree", ["lang_tree"],
                         "merkle-subroots"), "merkle-subroots-placed")
    top_rounds = _rounds(tops, bits)
    root = top_rounds[-1].select("tree", "place", F.array().cast("array<string>").alias("path"),
                                 F.col("node").alias("root"))
    top_paths = _down(top_rounds, root.drop("root"), bits)
    # a tree of its own for each language again, with what its proofs end in
    ends = stored(tops.join(top_paths, ["tree", "place"]).join(root.select("tree", "root"), "tree")
                  .select(F.col("lang_tree").alias("tree"), F.col("node").alias("subroot"), "root",
                          "path"), "merkle-ends")
    outer = ends.select("tree", F.lit(0).cast("long").alias("place"), "path")
    if len(rounds) > 1:
        outer = _down(rounds[1:], outer, bits)
    above = outer.join(ends.select("tree", "subroot", "root"), "tree")
    return _proved(rows, above, bits).withColumn(
        "verified", F.col("folded_root") == F.col("root")).drop("tree")
