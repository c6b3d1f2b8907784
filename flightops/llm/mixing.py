"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash of their id and queued; a document that is
queued again comes one source size later. Its virtual finish time is the number of its
source's words up to its end, divided by the source's weight. The mix takes the documents in
order of finish time until the total budget is used. A source is queued ``max_repeats``
times at most, so its share is bounded and the rest of the budget passes to the others by
weight: the time at which the budget ends follows from the source sizes alone. The document
that crosses this time is taken in part.

Running totals never see a whole source in one task: a source's documents are cut into
ranges of the hash, whose number grows with the input, and each range starts from the sum of
the earlier ones.

Defined results: null source is a source of its own, after all others; null text has size 0;
without any words all targets are 0; repeated rows are separate documents with equal place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightops.functions import one_row
from flightops.llm.common import stored, words

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)  # budget over the total size, as a fraction
MAX_REPEATS = 2
RANGE_ROWS = 1024  # rows of a hash range, about
CELL_ROWS = 1 << 17  # queue entries of a range of finish times, about


def source_weights(sizes: DataFrame, weights=WEIGHTS) -> DataFrame:
    """source_key, weight and source_size of every source (one row each)."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)
    return by_source.select(
        source_key().alias("source_key"), "source_size",
        F.get(F.array(*[F.lit(w) for w in weights]), place).alias("weight"))


def source_key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))


def row_key() -> Column:
    return F.xxhash64("doc_id", "source", "text")


def queue(times: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """A row for each pass over a document, with its virtual ``finish`` time."""
    passes = times.withColumn("pass", F.explode(F.array(*[F.lit(r) for r in range(max_repeats)])))
    return passes.withColumn("finish", (
        F.col("start") + F.col("size") + F.col("source_size") * F.col("pass")) / F.col("weight"))


def budget_end(times: DataFrame, share=SHARE, max_repeats: int = MAX_REPEATS,
               cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row: the virtual time at which the budget is used; null without any words.

    The queue is range-sorted by finish time. Until an entry finishes, the sources that have
    ended have given all they may (``gave``), the others their weight per unit of time; running
    totals over the order give both, inside ranges that start from the sums of the earlier ones.
    The first entry that does not finish within the budget sets the end.
    """
    last = ((F.col("pass") == max_repeats - 1)
            & (F.col("start") + F.col("size") == F.col("source_size")))
    entries = queue(times, max_repeats).where("size > 0").select(
        "finish", "source_key",
        F.when(last, F.col("weight")).otherwise(0).cast("long").alias("ends"),
        F.when(last, F.col("source_size") * max_repeats).otherwise(0).alias("gave"))
    cells = 1 + times.count() * max_repeats // cell_rows
    ranges = stored(entries.repartitionByRange(cells, "finish").withColumn(
        "cell", F.spark_partition_id()), "mixing-order")
    sums = ranges.groupBy("cell").agg(F.sum("ends").alias("ends"), F.sum("gave").alias("gave"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("cell", *[
        F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"cell_{c}") for c in ("ends", "gave")])
    # of equal finish times those that end a source come last, in the order of the sources
    order = ["finish", F.col("ends") > 0, F.col("source_key") == "n", "source_key"]
    within = Window.partitionBy("cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.select("*", *[
        F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"in_{c}") for c in ("ends", "gave")])
    totals = ranges.agg(
        F.sum("ends").alias("weights"),
        (F.sum("gave") / max_repeats * share[0] / share[1]).alias("budget"))
    level = (F.col("budget") - F.col("cell_gave") - F.col("in_gave")) / (
        F.col("weights") - F.col("cell_ends") - F.col("in_ends"))
    return one_row(placed.join(sums, "cell"), totals).withColumn("level", level).where(
        "level <= finish").agg(F.min_by("level", F.struct(
            "finish", (F.col("ends") > 0).alias("closes"),
            (F.col("source_key") == "n").alias("null_source"), "source_key")).alias("end"))


def virtual_times(docs: DataFrame, weights=WEIGHTS, share=SHARE,
                  max_repeats: int = MAX_REPEATS, range_rows: int = RANGE_ROWS,
                  cell_rows: int = CELL_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, weight, and ``start``, the words
    of its source that are queued before it. The target is what the source gives until the
    budget ends."""
    sizes = stored(docs.select(
        F.col("doc_id"), "source", F.size(words(F.col("text"))).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("place"),
        row_key().alias("row_key")),
        "mixing-sizes")
    rows, digits = sizes.count(), 0
    while rows > range_rows << (4 * digits):
        digits += 1
    placed = sizes.select("doc_id", "size", "place", "row_key", source_key().alias("source_key"),
                          F.substring("place", 1, digits).alias("part"))
    parts = placed.groupBy("source_key", "part").agg(F.sum("size").alias("part_size"))
    before = Window.partitionBy("source_key").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    parts = parts.select("source_key", "part", F.coalesce(
        F.sum("part_size").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("source_key", "part").orderBy(
        "place", "doc_id", "size", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    queued = placed.withColumn("in_part", F.coalesce(F.sum("size").over(within), F.lit(0)))
    times = stored(queued.join(parts, ["source_key", "part"]).join(
        source_weights(sizes, weights), "source_key").select(
        "doc_id", "size", "source_size", "weight", "source_key", "row_key",
        (F.col("part_start") + F.col("in_part")).alias("start")), "mixing-times")
    most = (F.col("source_size") * max_repeats).cast("double")
    return one_row(times, budget_end(times, share, max_repeats, cell_rows)).withColumn(
        "target", F.least(most, F.coalesce(F.col("end") * F.col("weight"), most))).drop("end")


def taken(repeat) -> Column:
    """Words that the mix takes from the given pass over a document."""
    end = F.floor("target") - (F.col("start") + F.col("source_size") * repeat)
    return F.greatest(F.lit(0), F.least(F.col("size"), end)).cast("long")


def mix_sizes(docs: DataFrame, max_repeats: int = MAX_REPEATS, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken words of every document."""
    timed = virtual_times(docs, max_repeats=max_repeats, **options)
    total = sum((taken(r) for r in range(max_repeats)), F.lit(0))
    return timed.select("doc_id", "size", "source_size", "target",
                        total.cast("long").alias("taken"))


def mix(docs: DataFrame, max_repeats: int = MAX_REPEATS, **options) -> DataFrame:
    """The mix itself in the order of its finish times, with the columns of ``docs``: a row
    for each pass over a document; where the budget ends, the words taken."""
    timed = virtual_times(docs, max_repeats=max_repeats, **options)
    # repeated rows have one key; each of them gets a place of its own
    same = Window.partitionBy("row_key").orderBy("start")
    entries = queue(timed.withColumn("n", F.row_number().over(same)), max_repeats).select(
        F.col("row_key").alias("key"), F.col("n").alias("entry"), "source_key", "pass", "size",
        taken(F.col("pass")).alias("taken"), "finish").where("taken > 0")
    rows = docs.select(F.struct("*").alias("row"), row_key().alias("row_key"))
    rows = rows.withColumn("n", F.row_number().over(
        Window.partitionBy("row_key").orderBy("row_key")))
    mixed = rows.join(entries, (F.col("row_key") == F.col("key"))
                      & (F.col("n") == F.col("entry"))).orderBy(
        "finish", "source_key", "row_key", "entry", "pass")
    cut = F.array_join(F.slice(words(F.col("row.text")), F.lit(1), F.col("taken").cast("int")),
                       " ")
    text = F.when(F.col("taken") < F.col("size"), cut).otherwise(F.col("row.text"))
    out = mixed.select("row", text.alias("text"))
    values = {"text": F.col("text"), "n_chars": F.when(
        F.col("text") == F.col("row.text"), F.col("row.n_chars") if "n_chars" in docs.columns
        else None).otherwise(F.length("text").cast("long"))}
    return out.select(*[values.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
