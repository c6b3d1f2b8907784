"""Near-duplicates by SimHash and deletion-variant signatures.

A text's fingerprint has a bit for each bit position that is set in more than half of the
hashes of its shingles (three words, repeats included). Fingerprints within three bits are
linked. A fingerprint is cut into two halves: of two linked fingerprints, one half differs in
one bit at most. So every half is indexed once per bit, with that bit deleted; an equality
join on these keys finds all candidates, and each is verified on all 64 bits.

Only distinct fingerprints are indexed, so copies cost nothing. Keys with two fingerprints
give their pair directly. Keys with more are joined back; members of a key share 31 bits,
and a key with many members is cut again: its other half is split into eight groups of four
bits, and three differing bits leave five of the eight groups equal. Each choice of five
groups fixes 20 more bits, so at most 2^13 fingerprints meet, whatever the input. Within a
key only links that join two parts are emitted, never all pairs.

Links become classes by alternating star steps, each written to the shared folder.

Defined results: null or empty text has fingerprint zero, linked like any other; a text with
one or two words has one shingle; null ids are skipped when the smallest id is chosen, and a
class without any id has a null component_id; repeated rows are one class.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightops.llm.common import stored

SHINGLE = 3
SEED = 42
NEAR = 3  # bits
MANY = 512  # members of a key from which it is cut again; the result is the same

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprints_of(texts: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints of texts."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
        if not found:
            continue
        if len(found) <= shingle:
            parts = [b" ".join(found)]
        else:
            joined = b" ".join(found)
            ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
            begins = np.concatenate(([0], ends[:-1] + 1))
            parts = [joined[a:b] for a, b in zip(begins[:len(found) - shingle + 1].tolist(),
                                                 ends[shingle - 1:].tolist())]
        hashes = np.array([xxh64_intdigest(p, SEED) for p in parts], "<u8")
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 14):
            bits = np.unpackbits(hashes[at:at + (1 << 14)].view(np.uint8).reshape(-1, 8),
                                 axis=1, bitorder="little")
            ones += bits.sum(0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and fingerprint (as a signed long) of every row."""

    def hashed(batches):
        for batch in batches:
            prints = fingerprints_of(batch.column(2).to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(prints)],
                ["doc_id", "text_key", "print"])

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"),
        "text").mapInArrow(hashed, "doc_id long, text_key long, print long")


def _variant_keys(value: Column) -> Column:
    """The 64 keys of a fingerprint: half, deleted bit, and the other 31 bits of the half.

    The deleted bit's place is in the upper part of the key, above the half with that bit
    cleared."""
    keys = []
    for half in range(2):
        part = F.shiftrightunsigned(value, 32) if half else value.bitwiseAND(
            F.lit(0xFFFFFFFF))
        keys += [part.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << bit))) + F.lit(
            (half * 32 + bit) << 32) for bit in range(32)]
    return F.array(*keys)


def _joining_links(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints within ``NEAR`` bits."""
    rest, links = prints, []
    while len(rest):
        # grow a class from its first member, row by row
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            one = front.pop()
            # unsigned: for a negative number the bits of its absolute value would be counted
            near = np.bitwise_count((rest ^ one).view(np.uint64)) <= NEAR
            if near.any():
                found = rest[near]
                links += [(int(one), int(x)) for x in found]
                front.extend(found)
                rest = rest[~near]
    return links


def _linked(batches):
    """Links within each key; rows of a key come together."""
    key, held = None, []
    for batch in batches:
        keys = np.asarray(batch.column(0))
        sub = np.asarray(batch.column(1))
        values = np.asarray(batch.column(2))
        cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (sub[1:] != sub[:-1])) + 1
        links = []
        for a, b in zip(np.append(0, cuts), np.append(cuts, len(keys))):
            if a == b:
                continue
            if (keys[a], sub[a]) != key:
                if held:
                    links += _joining_links(np.concatenate(held))
                key, held = (keys[a], sub[a]), []
            held.append(values[a:b])
        if links:
            yield _pairs(links)
    if held and (links := _joining_links(np.concatenate(held))):
        yield _pairs(links)


def _pairs(links) -> pa.RecordBatch:
    pairs = np.array(links, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs.min(1)), pa.array(pairs.max(1))],
                                      ["a", "b"])


def _block_keys(key: Column, value: Column) -> Column:
    """The other half of a fingerprint with each choice of three of its eight groups of four
    bits cleared, and the choice above it."""
    half = F.shiftrightunsigned(key, 37)  # 0: the key holds the lower half
    other = F.when(half == 0, F.shiftrightunsigned(value, 32)).otherwise(
        value.bitwiseAND(F.lit(0xFFFFFFFF)))
    keys = []
    for n, chosen in enumerate(combinations(range(8), 3)):
        mask = 0xFFFFFFFF ^ sum(0xF << (4 * g) for g in chosen)
        keys.append(other.bitwiseAND(F.lit(mask)) + F.lit((n + 1) << 32))
    return F.array(*keys)


def links(distinct: DataFrame, many: int = MANY) -> DataFrame:
    """Links (a < b) between distinct fingerprints ``print`` that join all within NEAR bits."""
    keyed = distinct.select("print", F.explode(_variant_keys(F.col("print"))).alias("key"))
    sizes = stored(keyed.groupBy("key").agg(
        F.count("*").alias("n"), F.min("print").alias("a"), F.max("print").alias("b")
    ).where("n > 1"), "simhash-keys")
    pairs = sizes.where("n = 2").where(
        F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= NEAR).select("a", "b")
    members = keyed.join(sizes.where("n > 2").select(F.col("key").alias("k"), "n"),
                         F.col("key") == F.col("k"))
    few = members.where(F.col("n") <= many).select("key", F.lit(0).cast("long").alias("sub"),
                                                   "print")
    cut = members.where(F.col("n") > many).select(
        "key", F.explode(_block_keys(F.col("key"), F.col("print"))).alias("sub"), "print")
    grouped = few.unionByName(cut)
    # members of a cut key differ in the sub key, so equal rows do not arise
    more = grouped.repartition("key", "sub").sortWithinPartitions("key", "sub").mapInArrow(
        _linked, "a long, b long")
    return pairs.unionByName(more).distinct()


def classes(edges: DataFrame, name: str = "simhash-stars", rounds: int = 64) -> DataFrame:
    """node and root (the smallest node of its class) for the nodes of ``edges`` (a, b)."""
    def digest(links: DataFrame):
        return links.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()

    edges = stored(edges.select("a", "b"), name)
    before = digest(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: a node's larger neighbours go to its smallest one
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("node"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("node")).where("b > a").select(
            F.col("m").alias("a"), "b").where("a < b").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        smallest = large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n"))
        several = large.join(
            smallest.where("n > 1").select(F.col("b").alias("node"), "m"),
            F.col("b") == F.col("node")).where("a > m").select(
            F.col("m").alias("a"), F.col("a").alias("b"))
        edges = stored(smallest.select(F.col("m").alias("a"), "b").unionByName(
            several).distinct(), name)
        after = digest(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"classes did not settle in {rounds} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, many: int = MANY) -> DataFrame:
    """doc_id, text_key, print, component_id and class root of every row of ``docs``."""
    prints = stored(fingerprints(docs), "simhash-prints")
    first = stored(prints.groupBy("print").agg(F.min("doc_id").alias("first_id")),
                   "simhash-first")
    rooted = classes(links(first.select("print"), many))
    class_of = first.join(rooted, F.col("print") == F.col("node"), "left").select(
        F.col("print").alias("p"), "first_id",
        F.coalesce("root", "print").alias("root"))
    smallest = class_of.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labelled = stored(class_of.join(smallest, "root").select("p", "component_id", "root"),
                      "simhash-classes")
    return prints.join(labelled, F.col("print") == F.col("p")).select(
        "doc_id", "text_key", "print", "component_id", "root")


def one_of_each(docs: DataFrame, many: int = MANY) -> DataFrame:
    """One row of each class: that of the smallest doc_id, null last."""
    rows = near_duplicates(docs, many)
    first = rows.groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("f"))
    kept = stored(first.select(F.col("f.doc_id").alias("id"), F.col("f.text_key").alias("key")),
                  "simhash-kept")
    keyed = docs.select(F.struct("*").alias("row")).withColumn(
        "text_key", F.xxhash64("row.text"))
    found = keyed.join(kept, (F.col("text_key") == F.col("key"))
                       & F.col("row.doc_id").eqNullSafe(F.col("id")))
    # repeated rows have the same id and text
    numbered = found.withColumn("n", F.row_number().over(
        Window.partitionBy("text_key", "id").orderBy("text_key")))
    return numbered.where("n = 1").select("row.*")
