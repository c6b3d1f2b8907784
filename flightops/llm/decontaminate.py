"""Benchmark decontamination with templates.

A text becomes a template: numbers, units and names (capitalised words inside a sentence)
turn into typed placeholders, other words lose case and outer punctuation. Windows of the
template are hashed and joined with the windows of all benchmark items. A hit carries the
values in its slots; within an alignment of an item in a document, an item value that meets several document
values takes the template windows that carry it out of the count, so a question whose numbers or
names were exchanged throughout is found and chance hits of bare placeholders are not. Template
windows need some plain words; all windows are also compared as they are spelled, without case
and punctuation, and these count whatever the slots say.

A document holds an item in one of three ways: half of the item's windows align; or half of
those that have enough plain words, with some value exchanged, since windows of mostly slots
cannot match in a re-parameterised copy; or a run of ``MIN_RUN`` words stands in it as spelled,
however long the item is. An item without any window of enough plain words is found as spelled
only.

The benchmark is the query set. If the hashes of its windows fit a bound, they are sent to
the tasks, which then emit hits only; otherwise all windows are emitted and joined.

Defined results: null texts and texts without words have no windows; an item shorter than the
window is one window of its own length; rows with equal doc_id and text are one document, and
so are equal items; null ids are ids like others.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightops.llm.common import stored

WINDOW = 8
MIN_PLAIN = 5  # plain words that a template window has at least; in shorter items the same share
MIN_COVERAGE = 0.5  # windows of an item that a document must hold
MIN_RUN = 20  # words of an item in one piece, as spelled, that are a hit by themselves
SENT_HASHES = 4_000_000  # window hashes that are sent to the tasks (32 MB)

# fixed: units of measure
UNITS = frozenset("""
    mm cm m km inch inches ft feet foot yard yards mile miles mg g kg ton tons tonnes lb lbs
    pound pounds oz ounce ounces ml l litre litres liter liters gallon gallons s sec second
    seconds min minute minutes h hour hours day days week weeks month months year years
    percent dollar dollars euro euros cent cents mph kmh watt watts volt volts degree degrees
""".split())

_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
_EDGES = re.compile(r"^[^\w$€£+-]+|[^\w%]+$")
_PLAIN, _NUM, _UNIT, _NAME, _NOTHING = range(5)
_ENDS = 8  # the word ends a sentence
_U = np.uint64

_WINDOWS = "key long, at int, slots array<string>"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(29))


class _Words(dict):
    """Hash of the plain form of a word, with its kind in the low bits."""

    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= 1 << 20:
            self.clear()
        bare = _EDGES.sub("", word)
        plain = bare.lower()
        if not bare:
            kind = _NOTHING
        elif _NUMBER.fullmatch(bare):
            kind = _NUM
        elif plain in UNITS:
            kind = _UNIT
        elif bare[:1].isupper():
            kind = _NAME
        else:
            kind = _PLAIN
        ends = _ENDS if word[-1:] in ".!?" else 0
        value = self[word] = (xxh64_intdigest(plain.encode("utf-8", "surrogatepass"), 3)
                              & ~15) | kind | ends
        return value


_WORDS = _Words()


def bare(word: str) -> str:
    return _EDGES.sub("", word).lower()


def template(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words that stay: place in ``words``, plain hash, kind."""
    coded = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    kind = (coded & _U(7)).astype(np.int8)
    ends = (coded & _U(_ENDS)) > 0
    first = np.append(True, ends[:-1])[:len(words)]
    kind[(kind == _NAME) & first] = _PLAIN
    at = np.flatnonzero(kind != _NOTHING)
    return at, coded[at] >> _U(4), kind[at]


def window_keys(plain: np.ndarray, kind: np.ndarray, size: int):
    """Keys of the spelled windows, those of the template windows, and how many plain words
    each has."""
    n = len(plain) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    slot = np.where(kind == _PLAIN, plain, kind.astype(np.uint64))
    spelled = np.full(n, size, np.uint64)
    typed = np.zeros(n, np.uint64)
    for i in range(size):
        spelled = _mix(spelled + plain[i:i + n])
        typed = _mix(typed + slot[i:i + n])
    count = np.cumsum(np.append(0, kind == _PLAIN))
    return spelled, typed, count[size:] - count[:-size]


def least_plain(size: int) -> int:
    """Plain words that a template window of ``size`` words has at least."""
    return min(MIN_PLAIN, -(-MIN_PLAIN * size // WINDOW))


class Wanted:
    """A set of keys; a table of their upper bits answers most questions."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.upper = np.zeros(1 << 22, bool)
        self.upper[self.keys >> _U(42)] = True

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where keys of the set stand."""
        at = np.flatnonzero(self.upper[keys >> _U(42)])
        if not len(at):
            return at
        found = np.searchsorted(self.keys, keys[at])
        found[found == len(self.keys)] = 0
        return at[self.keys[found] == keys[at]]


def _windows(text: str | None, sizes, wanted: Wanted | None):
    """(key, place, slot values) of the windows of a text whose key is wanted."""
    words = (text or "").split()
    if not words:
        return
    at, plain, kind = template(words)
    for size in sizes:
        spelled, typed, count = window_keys(plain, kind, size)
        every = np.arange(len(spelled)) if wanted is None else wanted.places(spelled)
        for i in every.tolist():
            yield int(spelled[i].view(np.int64)), i, []
        places = np.flatnonzero((count >= least_plain(size)) & (count < size))
        if wanted is not None:
            places = places[wanted.places(typed[places])]
        for i in places.tolist():
            yield int(typed[i].view(np.int64)), i, [
                f"{kind[j]}{bare(words[at[j]])}" for j in range(i, i + size)
                if kind[j] != _PLAIN]


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, key, at, slots and size of all windows of the items, and whether the window has
    enough plain words (``wordy``)."""

    def cut(batches):
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _, plain, kind = template((text or "").split())
                if len(plain):
                    size = min(window, len(plain))
                    wordy = window_keys(plain, kind, size)[2] >= least_plain(size)
                    out += [(item, *w, size, bool(wordy[w[1]]))
                            for w in _windows(text, (size,), None)]
            columns = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([
                pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.list_(pa.string())),
                pa.array(columns[4], pa.int32()), pa.array(columns[5], pa.bool_())],
                ["item_id", "key", "at", "slots", "size", "wordy"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    return rows.mapInArrow(cut, f"item_id long, {_WINDOWS}, size int, wordy boolean")


def document_windows(docs: DataFrame, sizes: list[int], wanted=None) -> DataFrame:
    """doc_id, text_key, key, at and slots of the windows of all documents.

    ``wanted``: a broadcast of the keys of the items; other windows are left out.
    """
    every = wanted is None

    def cut(batches):
        keys = None if every else wanted.value
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                piece, out = batch.slice(start, 500), []
                for doc, text_key, text in zip(*(c.to_pylist() for c in piece.columns)):
                    out += [(doc, text_key, *w) for w in _windows(text, sizes, keys)]
                if out:
                    columns = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                        pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int32()),
                        pa.array(columns[4], pa.list_(pa.string()))],
                        ["doc_id", "text_key", "key", "at", "slots"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(cut, f"doc_id long, text_key long, {_WINDOWS}")


def _longest_run(places: Column) -> Column:
    """Length of the longest run of neighbours in sorted places."""
    zero = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, place: Column) -> Column:
        run = F.when(place == acc["last"] + 1, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(place.alias("last"), run.alias("run"),
                        F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(places, zero, step, lambda acc: acc["best"])


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW,
          min_coverage: float = MIN_COVERAGE, sent_hashes: int = SENT_HASHES,
          min_run: int = MIN_RUN) -> DataFrame:
    """doc_id, text_key, item_id, n_matched, n_windows, coverage, reparameterised and run_words
    (the longest piece as spelled) for each document and item that it holds."""
    spark = docs.sparkSession
    table = stored(item_windows(items, window), "benchmark-windows")
    sizes = [r["size"] for r in table.select("size").distinct().collect()]  # at most `window`
    keys, wanted = table.select("key").distinct(), None
    if keys.count() <= sent_hashes:
        found = np.array([r["key"] for r in keys.collect()], np.int64).view(np.uint64)
        wanted = spark.sparkContext.broadcast(Wanted(found))
    hits = document_windows(docs, sizes, wanted)
    theirs = table.select("item_id", "key", F.col("at").alias("item_at"),
                          F.col("slots").alias("item_slots"), "size", "wordy")
    pairs = hits.join(theirs, "key").select(
        "doc_id", "text_key", "item_id", (F.col("at") - F.col("item_at")).alias("shift"),
        "item_at", "size", "wordy", F.arrays_zip("item_slots", "slots").alias("values"))
    # an item in one alignment has few windows and slots, however long the document is
    aligned = pairs.groupBy("doc_id", "text_key", "item_id", "shift").agg(
        F.collect_set(F.when(F.size("values") == 0, F.col("item_at"))).alias("spelled"),
        F.collect_set(F.when(F.size("values") > 0, F.struct("item_at", "values"))).alias("typed"),
        F.collect_set(F.when(F.col("wordy"), F.col("item_at"))).alias("wordy"),
        F.first("size").alias("size"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("values")))).alias("values"))
    aligned = aligned.withColumn("unsure", F.array_distinct(F.filter("values", lambda v, i: (
        v["item_slots"] == F.get("values", i - 1)["item_slots"]))["item_slots"]))
    aligned = aligned.withColumn("typed", F.filter("typed", lambda t: ~F.exists(
        t["values"], lambda v: F.array_contains("unsure", v["item_slots"]))))
    counted = aligned.select(
        "doc_id", "text_key", "item_id",
        F.exists("typed", lambda t: F.exists(
            t["values"], lambda v: v["item_slots"] != v["slots"])).alias("changed"),
        F.when(F.size("spelled") > 0, _longest_run(F.sort_array("spelled")) + F.col("size") - 1)
        .otherwise(0).alias("run_words"), "wordy",
        F.explode(F.array_union("spelled", F.col("typed.item_at"))).alias("place"),
    ).withColumn("wordy", F.array_contains("wordy", F.col("place"))).groupBy(
        "doc_id", "text_key", "item_id", "place").agg(
        F.max("changed").alias("changed"), F.max("run_words").alias("run_words"),
        F.max("wordy").alias("wordy"),
    ).groupBy("doc_id", "text_key", "item_id").agg(
        F.count("*").alias("n_matched"), F.max("changed").alias("changed"),
        F.max("run_words").alias("run_words"), F.count_if("wordy").alias("n_wordy_matched"))
    n_windows = table.groupBy("item_id", "at").agg(F.max("wordy").alias("wordy")).groupBy(
        "item_id").agg(F.count("*").alias("n_windows"), F.count_if("wordy").alias("n_wordy"))
    coverage = F.col("n_matched") / F.col("n_windows")
    held = (F.col("coverage") >= min_coverage) | (F.col("run_words") >= min_run) | (
        F.col("reparameterised") & (F.col("n_wordy_matched") >= min_coverage * F.col("n_wordy"))
        & (F.col("n_wordy_matched") > 0))
    return counted.join(n_windows.withColumnRenamed("item_id", "item"),
                        F.col("item_id").eqNullSafe(F.col("item"))).select(
        "doc_id", "text_key", "item_id", "n_matched", "n_windows", coverage.alias("coverage"),
        F.col("changed").alias("reparameterised"), "run_words", "n_wordy_matched", "n_wordy",
    ).where(held).drop("n_wordy_matched", "n_wordy")


def without_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    found = stored(leaks(docs, items, **options).select(
        F.col("doc_id").alias("id"), F.col("text_key").alias("key")).distinct(), "leaks")
    keyed = docs.select(F.struct("*").alias("row")).withColumn(
        "text_key", F.xxhash64("row.text"))
    return keyed.join(found, (F.col("text_key") == F.col("key"))
                      & F.col("row.doc_id").eqNullSafe(F.col("id")), "left_anti").select("row.*")
