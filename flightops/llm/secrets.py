"""Secret scan with corpus-wide ownership frequency.

Three base patterns give the candidate spans of every text. Further candidates are long
mixed strings (kind ``token``) outside the base spans. The hash of each candidate value is
counted over the corpus by distinct repositories (source and language) and owners (source):
values that many owners carry are copied examples, values of few owners look live. A
``token`` span is reported only when its value looks live; base spans always stay.

Only DataFrame functions run here. Positions come from the lengths of the texts between the
matches. Defined results: null text is empty, null source or lang counts as one owner or
repository of its own, repeated rows are scanned row by row and do not raise a frequency.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightops.llm.common import let, stored

# fixed: the base patterns, and the least length of the part that is the secret
ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
          r"([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the same as AKIA[A-Z0-9]+ with 18 characters or more
HEX = r"[0-9a-f]{16,}"  # the same as [0-9a-f]+ with 16 characters or more
MIN_ASSIGN = 12

TOKEN = r"[A-Za-z0-9+/_-]{24,}"
MAX_OWNERS = 2  # values of more owners are copied examples

SPAN = "array<struct<start:long,rank:int,end:long,kind:string,value:string>>"


def _spans(text: Column, pattern: str, kind: str, rank: int, value) -> Column:
    """Non-overlapping matches with their code point positions; no match costs one search."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def placed(g: Column) -> Column:
        def add(acc: Column, m: Column) -> Column:
            start = acc["at"] + F.length(F.get(g, acc["i"]))
            end = start + F.length(m)
            span = F.struct(start.cast("long").alias("start"), F.lit(rank).alias("rank"),
                            end.cast("long").alias("end"), F.lit(kind).alias("kind"),
                            value(m).alias("value"))
            return F.struct((acc["i"] + 1).alias("i"), end.alias("at"),
                            F.concat(acc["out"], F.array(span)).alias("out"))

        zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"),
                        F.array().cast(SPAN).alias("out"))
        return F.aggregate(found, zero, add, lambda acc: acc["out"])

    return F.when(text.rlike(pattern), let(gaps, placed)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    assign = F.filter(
        _spans(text, ASSIGN, "assign", 0, lambda m: F.regexp_extract(m, f"^{ASSIGN}", 1)),
        lambda s: F.length(s["value"]) >= MIN_ASSIGN)
    return F.array_sort(F.concat(
        assign, _spans(text, ACCESS, "access", 1, lambda m: m),
        _spans(text, HEX, "hex", 2, lambda m: m)))


def token_spans(text: Column, base: Column) -> Column:
    """Long strings of digits and both cases, outside the base spans."""
    spans = _spans(text, TOKEN, "token", 3, lambda m: m)
    return F.filter(spans, lambda s: (
        s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]")
        & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))


def ownership(candidates: DataFrame) -> DataFrame:
    """Distinct owners and repositories of each ``value_hash``."""
    owned = candidates.select("value_hash", "owner", "repository").distinct()
    by_owner = owned.groupBy("value_hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("value_hash").agg(
        F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def secret_scan(docs: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and added spans, live and example counts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    scanned = docs.select(
        "doc_id", text.alias("text"), F.coalesce("source", F.lit("\0")).alias("owner"),
        F.concat_ws("\1", F.coalesce("source", F.lit("\0")), F.coalesce("lang", F.lit("\0")))
        .alias("repository"))
    scanned = scanned.select("doc_id", "owner", "repository", let(
        base_spans(F.col("text")), lambda b: F.struct(
            b.alias("base"), token_spans(F.col("text"), b).alias("more"))).alias("s"))
    scanned = stored(scanned.select(
        "doc_id", F.col("s.base").alias("base"), F.col("s.more").alias("more"), "owner",
        "repository"), "secret-spans")
    key = F.xxhash64("base", "more")
    candidates = scanned.where(F.size("base") + F.size("more") > 0).select(
        "doc_id", key.alias("key"), "owner", "repository",
        F.explode(F.concat("base", "more")).alias("span"),
    ).withColumn("value_hash", F.md5("span.value"))
    # a row's spans follow from doc_id and key, so repeated rows are judged once
    placed = candidates.select("doc_id", "key", "span", "value_hash").distinct()
    judged = placed.join(ownership(candidates), "value_hash").select(
        F.col("doc_id").alias("id"), F.col("key").alias("k"), "span", "n_owners",
        (F.col("n_owners") <= max_owners).alias("live"))
    by_doc = judged.groupBy("id", "k").agg(
        F.sum(F.col("live").cast("long")).alias("n_live"),
        F.sum((~F.col("live")).cast("long")).alias("n_example"),
        F.collect_list(F.when(F.col("live") & (F.col("span.kind") == "token"), F.col("span")))
        .alias("added"))
    joined = scanned.withColumn("key", key).join(
        by_doc, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k")), "left")
    return joined.select(
        "doc_id", "base", F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_example", F.lit(0)).alias("n_example"),
        F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(SPAN))))
        .alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
