"""Quality rules: counts per document and a hashed n-gram likelihood ratio.

The n-grams (words and pairs of neighbours) of all documents are hashed into a fixed number
of buckets and counted twice: over the corpus, and over the documents that a label calls
good. A document's score is the mean over its n-grams of ``log p_target - log p_raw`` with
add-alpha smoothing. How far an unseen good document falls below zero depends on the amount of
labels and of corpus, so the cut comes from the good documents themselves: each is scored without
its own counts in the target, and the cut is lowered until 1 % of them at most fall below it.
Everything is DataFrame functions; the only shuffles are the join of labels to texts and one row
per task and bucket. The good documents are stored once.

Defined results: null text has no words; a document below 50 words fails; without any good
label the ratio is 0 and only the base rules decide; repeated rows and null ids are scored
row by row, and count as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightops.llm.common import SPACES, let, stored, words

BUCKETS = 1 << 17
ALPHA = 1.0
MIN_SCORE = -0.2  # nats per n-gram; the cut is never above
MAX_LOST = 0.01  # share of the good documents, scored as unseen, that the cut may reject
SCORE_STEPS = 10_000  # a nat, for the quantile only
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAP_BITS = 23  # bits of the map of good ids, as a power of two: 1 MB; changes the plan only
LOOKED_UP = 32  # changes the plan only
SYMBOLS = "[#*$%&|<>]"  # fixed


def _bucket(*parts: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")


def _grams(w: Column, buckets: int) -> Column:
    """Bucket of each word, then of each pair of neighbours."""
    pairs = F.transform(w, lambda a, i: _bucket(a, F.get(w, i + 1), buckets=buckets))
    return F.concat(F.transform(w, lambda a: _bucket(a, buckets=buckets)),
                    F.slice(pairs, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))))


def good_documents(labels: DataFrame) -> DataFrame:
    """Ids that some label calls good."""
    return labels.where("quality = 1 and doc_id is not null").select(
        F.col("doc_id").alias("good_id")).distinct()


def _place(value: Column) -> Column:
    return F.pmod(F.xxhash64(value.cast("string")), F.lit(1 << MAP_BITS))


def _id_map(ids: DataFrame) -> DataFrame:
    """One row with a bitmap of the hashes of ``good_id``: 2^MAP_BITS bits, whatever their number."""
    cells = ids.groupBy(F.shiftright(_place(F.col("good_id")), 6).alias("cell")).agg(F.bit_or(
        F.call_function("shiftleft", F.lit(1).cast("long"),
                        _place(F.col("good_id")).bitwiseAND(63).cast("int"))).alias("bits"))
    every = ids.sparkSession.range(1 << (MAP_BITS - 6)).withColumnRenamed("id", "cell")
    return every.join(cells, "cell", "left").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("cell", F.coalesce("bits", F.lit(0)).alias("bits")))),
        lambda c: c["bits"]).alias("map"))


def good_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that some label calls good: their text.

    Only rows whose id may be among the good ones are shuffled for the join."""
    ids = stored(good_documents(labels), "quality-good-ids")
    mapped = stored(_id_map(ids), "quality-good-map").scalar()
    place = _place(F.col("id"))
    maybe = F.call_function("shiftrightunsigned", F.get("map", F.shiftright(place, 6).cast("int")),
                            place.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
    texts = docs.select(F.col("doc_id").alias("id"), "text", mapped.alias("map")).where(
        maybe).select("id", "text")
    # labels cover a share of all documents, so they are never small where texts are many
    return texts.join(ids.hint("merge"), F.col("id") == F.col("good_id"),
                      "left_semi").select("text")


def _bucket_counts(texts: DataFrame, name: str, buckets: int) -> DataFrame:
    """Occurrences ``name`` of each ``bucket`` in ``texts``."""
    pairs = texts.select(
        F.explode(let(words(F.col("text")), lambda w: F.arrays_zip(
            w.alias("a"), F.concat(F.slice(w, F.lit(2), F.size(w)), F.array(F.lit(None)))
            .alias("b")))).alias("p"))
    first, second = F.col("p")["a"], F.col("p")["b"]
    grams = pairs.where(first.isNotNull()).select(F.explode(F.array(
        _bucket(first, buckets=buckets),
        F.when(second.isNotNull(), _bucket(first, second, buckets=buckets)))).alias("bucket"))
    return grams.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias(name))


def weights(docs: DataFrame, good: DataFrame, buckets: int = BUCKETS,
            alpha: float = ALPHA) -> DataFrame:
    """One row with the log ratio of every bucket, in order, the same with one occurrence less in
    the target (``unseen``), the target counts and their sum; ``buckets`` bounds its size.
    ``good``: the texts of the target."""
    counts = _bucket_counts(docs, "raw", buckets).join(
        _bucket_counts(good, "target", buckets), "bucket", "left")
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    one = every.join(counts, "bucket", "left").select(
        "bucket", F.coalesce("raw", F.lit(0)).alias("raw"),
        F.coalesce("target", F.lit(0)).alias("target"),
    ).agg(
        F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"),
        F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("counts"))

    def ratio(less: int) -> Column:
        return F.transform("counts", lambda x: (
            F.log((F.greatest(x["target"] - less, F.lit(0)) + alpha)
                  / (F.col("all_target") + alpha * buckets))
            - F.log((x["raw"] + alpha) / (F.col("all_raw") + alpha * buckets))))

    none = F.transform("counts", lambda x: F.lit(0.0))
    some = F.col("all_target") > 0
    return one.select(F.when(some, ratio(0)).otherwise(none).alias("weights"),
                      F.when(some, ratio(1)).otherwise(none).alias("unseen"), F.col("counts.target").alias("target"), "all_target")


def _own_repeats(grams: Column, alpha: float) -> Column:
    """What a text of the target adds to the sum of its ``unseen`` weights by the n-grams that it
    has more than once: for n occurrences n (log(seen - 1) - log(seen - n)), smoothed."""
    zero = F.struct(F.lit(-1).alias("bucket"), F.lit(1).cast("long").alias("n"),
                    F.lit(0.0).alias("sum"))

    def closed(acc: Column) -> Column:
        seen = F.get("target", acc["bucket"])
        return F.when(acc["n"] == 1, acc["sum"]).otherwise(acc["sum"] + acc["n"] * (
            F.log(seen - 1 + alpha) - F.log(seen - acc["n"] + alpha)))

    def step(acc: Column, bucket: Column) -> Column:
        same = acc["bucket"] == bucket
        return F.struct(bucket.alias("bucket"),
                        F.when(same, acc["n"] + 1).otherwise(F.lit(2).cast("long")).alias("n"),
                        F.when(same, acc["sum"]).otherwise(closed(acc)).alias("sum"))

    # without the first occurrence of each
    again = let(F.sort_array(grams), lambda s: F.filter(s, lambda x, i: x == F.get(s, i - 1)))
    return F.aggregate(again, zero, step, closed)


def repeat_words(w: Column) -> Column:
    """Words in windows of three that occur twice or more in the text."""
    grams = F.slice(
        F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))),
        F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))

    def union(p: Column) -> Column:
        """Words in the windows that start at the sorted positions ``p``."""
        return F.aggregate(F.transform(p, lambda x, i: F.least(
            F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0),
            lambda a, x: a + x)

    def looked_up(g: Column, repeated: Column) -> Column:
        return F.array_compact(F.transform(g, lambda x, i: F.when(
            F.array_contains(repeated, x), i)))

    def by_sorting(g: Column) -> Column:
        placed = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return let(placed, lambda s: F.array_sort(F.array_compact(F.transform(
            s, lambda x, i: F.when((x["g"] == F.get(s, i - 1)["g"])
                                   | (x["g"] == F.get(s, i + 1)["g"]), x["i"])))))

    def covered(g: Column) -> Column:
        repeated = let(F.sort_array(g), lambda s: F.array_distinct(F.filter(
            s, lambda x, i: x == F.get(s, i - 1))))
        # both ways give the same positions; looking up many values takes longer than sorting
        return let(repeated, lambda r: F.when(F.size(r) == 0, F.lit(0)).otherwise(let(
            F.when(F.size(r) <= LOOKED_UP, looked_up(g, r)).otherwise(by_sorting(g)), union)))

    return let(grams, covered)


def _measured(docs: DataFrame, table: DataFrame, buckets: int, alpha: float,
              unseen: bool = False) -> DataFrame:
    """``row`` (all columns of ``docs``), the base counts, ``score`` and ``base_failed``; of texts
    of the target the score without their own counts, if ``unseen``, and only what it needs."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1),
                     lambda line: F.trim(line, F.lit(SPACES)) != "")

    def scored(grams: Column, n: Column) -> Column:
        name = "unseen" if unseen else "weights"
        total = F.aggregate(grams, F.lit(0.0), lambda a, b: a + F.get(name, b))
        if unseen:
            words_left = F.col("all_target") + alpha * buckets
            total = total - _own_repeats(grams, alpha) - n * (
                F.log(words_left - n) - F.log(words_left))
        return total / n

    def counts(w: Column) -> Column:
        n = F.greatest(2 * F.size(w) - 1, F.lit(1))
        grams = _grams(w, buckets)
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
            (let(grams, lambda g: scored(g, n)) if unseen else scored(grams, n)).alias("score"),
            *([] if unseen else [
                F.length(F.array_join(w, "")).cast("long").alias("word_chars")]))

    # the table is one value for the whole query: the optimizer puts it where it is used
    needed = ("unseen", "target", "all_target") if unseen else ("weights",)
    source = docs.select(F.struct("*").alias("row"),
                         *(table.select(c).scalar().alias(c) for c in needed))
    # a generator, so that a filter on the result does not compute the counts again
    plain = {} if unseen else {
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": let(
            lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")}
    counted = source.select("row", F.inline(F.array(F.struct(
        let(words(text), counts).alias("c"), *(c.alias(n) for n, c in plain.items())))))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.select("row", "c.*", *plain).withColumn("base_failed", failed)


def cut(good: DataFrame, table: DataFrame, min_score: float = MIN_SCORE,
        max_lost: float = MAX_LOST, buckets: int = BUCKETS, alpha: float = ALPHA) -> DataFrame:
    """One row with the least score that is kept, from all texts of the target."""
    unseen = _measured(good, table, buckets, alpha, unseen=True).where("not base_failed")
    # rounded down, so the quantile merges few distinct values
    steps = F.floor(F.col("score") * SCORE_STEPS)
    return unseen.agg(F.least(F.lit(min_score), F.coalesce(
        F.percentile(steps, max_lost) / SCORE_STEPS, F.lit(min_score))).alias("cut"))


def quality_rules(docs: DataFrame, labels: DataFrame, min_score: float = MIN_SCORE,
                  buckets: int = BUCKETS, alpha: float = ALPHA,
                  max_lost: float = MAX_LOST) -> DataFrame:
    """``row`` (all columns of ``docs``), the base counts, ``score``, ``base_failed``, ``kept``."""
    good = stored(good_texts(docs, labels), "quality-good")
    table = stored(weights(docs, good, buckets, alpha), "quality-weights")
    least = stored(cut(good, table, min_score, max_lost, buckets, alpha), "quality-cut").scalar()
    return _measured(docs, table, buckets, alpha).withColumn(
        "kept", ~F.col("base_failed") & (F.col("score") >= least))
