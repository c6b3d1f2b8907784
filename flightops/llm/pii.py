"""Personal data, and the terms around it that would give it away.

Four patterns give the base spans of every text: emails, IP addresses, payment cards and
phone numbers; their values are the protected entities. The corpus then says how strongly a
term reveals an entity. For the words within ``WINDOW`` words of a span,

    disclosure(t, e) = PMI(t, e) / IC(e),
    PMI(t, e) = log(N n(t, e) / (n(t) n(e))),  IC(e) = log(N / n(e)),

where N counts the rows, n(t) those with the term anywhere in the text, n(e) those with the
entity, and n(t, e) those in which the term stands near it. 1 means that the term is seen in
no other company. Pairs met in fewer than ``MIN_TEXTS`` different texts are no evidence, so
copies of a text do not convict its words, and entities that many rows share (little
information) are public. A term of a disclosure from ``REMOVE`` on is removed, from
``GENERALISE`` on it is generalised; base spans always stay. ``sanitised`` writes the texts.

A pass over the texts gives spans and the pairs of the windows, a second one counts the terms
of the pairs in all texts: a bitmap of a fixed size tells the tasks which words may be such
terms, each task adds up its counts, and a join with the pairs drops the words that only
share a bit. No pair of all terms or documents is built, and no key is gathered whole.

Defined results: null text is empty and has no spans; empty tables give no rows; null doc_ids
are documents; repeated rows are scanned and counted row by row and have equal results; equal
spans found for several entities count once, removal before generalisation; very long texts
and words are read whole; other columns, of whatever name, are not read.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightops.llm.common import stored

KINDS = ("email", "ip", "card", "phone", "remove", "generalise")
WINDOW = 5  # words before and behind a span
MIN_TEXTS = 3
MIN_INFORMATION = 3.0  # nats; an entity in more than a twentieth of the rows is public
REMOVE, GENERALISE = 0.8, 0.5
MAP_BITS = 23  # bits of the bitmap of terms, as a power of two: 1 MB
FLUSH = 1 << 17  # terms that a task counts before it passes them on
REMEMBERED, LONG_WORD = 1 << 18, 64  # words that a task keeps the term of, and their length

# fixed: the base patterns. Digits and runs are taken whole, so a search never starts anew
# inside a run that has failed
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CORE = re.compile(r"[^\W_](?:.*[^\W_])?", re.DOTALL)

SPANS = "array<struct<start:long,rank:int,end:long,entity:long>>"
NEAR = "array<struct<entity:long,term:long,start:long,end:long>>"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        free = found.end() if found else at + 1
        if found:
            yield start, free
        at = text.find("@", max(at + 1, free))


def _small(part: str) -> bool:
    digits = part.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, rank of the kind, end, normalised value), in the order of the digest."""
    found = [(a, 0, b, text[a:b].lower()) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            found.append((m.start(), 1, m.end(), m[0]))
    for m in CARD.finditer(text):
        digits = _digits(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end(), digits))
    for m in PHONE.finditer(text) if "+" in text else ():
        digits = _digits(m[0])
        if 9 <= len(digits) <= 15:
            found.append((m.start(), 3, m.end(), digits))
    return sorted(found)


def _hash(text: str) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(text)).astype(np.int64))


def term(word: str) -> tuple[int, int, str] | None:
    """Start and end inside the word, and the term: what stands between its first and last
    letter or digit, in lower case; None without a letter or below two characters."""
    core = CORE.search(word)
    if core and len(core[0]) > 1 and any(map(str.isalpha, core[0])):
        return core.start(), core.end(), core[0].lower()
    return None


def near_terms(text: str, spans: list[tuple[int, int, int, str]], window: int = WINDOW
               ) -> list[tuple[int, int, int, int]]:
    """(entity, term, start, end) of the terms within ``window`` words of each span.

    Words that touch a base span are part of it, and are no terms."""
    if not spans:
        return []
    terms = []
    ends = np.maximum.accumulate([s[2] for s in spans])
    starts = [s[0] for s in spans]
    for m in WORD.finditer(text):
        i = bisect.bisect_left(starts, m.end())  # spans before i start before the word's end
        if not i or ends[i - 1] <= m.start():
            found = term(m[0])
            terms.append((m.start(), found and (
                _hash(found[2]), m.start() + found[0], m.start() + found[1])))
    places = [t[0] for t in terms]
    out = []
    for start, rank, end, value in spans:
        entity = _hash(f"{rank}:{value}")
        first, last = bisect.bisect_left(places, start), bisect.bisect_left(places, end)
        out += [(entity, *t) for _, t in terms[max(0, first - window):first]
                + terms[last:last + window] if t]
    return out


def _scanned(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("doc_id", pa.int64()), ("text_key", pa.int64()),
        ("base", pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()),
                                     ("end", pa.int64()), ("entity", pa.int64())]))),
        ("near", pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.int64()),
                                     ("start", pa.int64()), ("end", pa.int64())])))])
    for batch in batches:
        for at in range(0, len(batch), 512):
            ids, keys, base, near = [], [], [], []
            part = batch.slice(at, 512)
            for doc, key, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                spans = base_spans(text or "")
                ids.append(doc)
                keys.append(key)
                base.append([{"start": a, "rank": r, "end": b, "entity": _hash(f"{r}:{v}")}
                             for a, r, b, v in spans])
                near.append([{"entity": e, "term": t, "start": a, "end": b}
                             for e, t, a, b in near_terms(text or "", spans, window)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip((ids, keys, base, near), schema)], schema=schema)


def _counted(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows that hold each term of the bitmap."""
    wanted: dict[str, int | None] = {}
    counts: Counter[int] = Counter()

    def term_of(word: str) -> int | None:
        found = term(word)
        if not found:
            return None
        key = _hash(found[2])
        bit = key & ((1 << MAP_BITS) - 1)
        return key if bitmap[bit >> 6] >> np.uint64(bit & 63) & np.uint64(1) else None

    def passed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())],
            ["term", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            keys = set()
            for word in set(WORD.findall(text or "")):
                key = wanted.get(word, 0)
                if key == 0:
                    key = term_of(word)
                    if len(word) <= LONG_WORD:
                        if len(wanted) >= REMEMBERED:
                            wanted.clear()
                        wanted[word] = key
                if key is not None:
                    keys.add(key)
            counts.update(keys)
            if len(counts) >= FLUSH:
                yield passed()
                counts.clear()
    if counts:
        yield passed()


def scan(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_key, base spans and the terms near them, of every row; stored."""
    def scanned(batches):
        return _scanned(batches, window)

    return stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text"
    ).mapInArrow(scanned, f"doc_id long, text_key long, base {SPANS}, near {NEAR}"), "pii-spans")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term and ``n_term``, the rows of ``docs`` that hold it, for the ``terms``."""
    bit = F.col("term").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    # at most 2^(MAP_BITS - 6) rows, whatever the number of terms
    cells = terms.groupBy(F.shiftright(bit, 6).alias("cell")).agg(F.bit_or(
        F.expr(f"shiftleft(1L, CAST(term & 63 AS INT))")).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    bitmap[np.asarray(cells.column("cell"))] = np.asarray(cells.column("bits")).view(np.uint64)

    def counted(batches):
        return _counted(batches, bitmap)

    found = docs.select("text").mapInArrow(counted, "term long, n long")
    return found.groupBy("term").agg(F.sum("n").alias("n_term")).join(terms, "term", "left_semi")


def disclosures(docs: DataFrame, scanned: DataFrame, min_texts: int = MIN_TEXTS,
                min_information: float = MIN_INFORMATION, generalise: float = GENERALISE) -> DataFrame:
    """entity, term, counts and disclosure of the pairs from ``generalise`` on."""
    rows = scanned.count()
    # the copies of a text are one row before the pairs meet
    pairs = scanned.where(F.size("near") > 0).select("text_key", F.explode(F.array_distinct(
        F.transform("near", lambda n: F.struct(n["entity"], n["term"])))).alias("pair")).groupBy(
        "pair.entity", "pair.term", "text_key").agg(F.count("*").alias("copies")).groupBy(
        "entity", "term").agg(F.sum("copies").alias("n_both"), F.count("*").alias("n_texts"))
    pairs = stored(pairs.where(F.col("n_texts") >= min_texts), "pii-pairs")
    entities = scanned.where(F.size("base") > 0).select(
        F.explode(F.array_distinct("base.entity")).alias("entity")).groupBy("entity").agg(
        F.count("*").alias("n_entity"))
    information = F.log(F.lit(float(rows)) / F.col("n_entity"))
    kept = stored(pairs.join(entities, "entity").withColumn("information", information).where(
        F.col("information") >= min_information), "pii-evidence")
    counts = term_counts(docs, stored(kept.select("term").distinct(), "pii-terms"))
    shared = F.log(F.lit(float(rows)) * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
    return kept.join(counts, "term").withColumn("disclosure", shared / F.col("information")).where(
        F.col("disclosure") >= generalise)


def personal_data(docs: DataFrame, window: int = WINDOW, min_texts: int = MIN_TEXTS,
                  min_information: float = MIN_INFORMATION, remove: float = REMOVE,
                  generalise: float = GENERALISE) -> DataFrame:
    """doc_id, text_key, base and all spans (start, rank, end) of every row of ``docs``."""
    scanned = scan(docs, window)
    found = stored(disclosures(docs, scanned, min_texts, min_information, generalise).select(
        F.col("entity").alias("e"), F.col("term").alias("t"),
        F.when(F.col("disclosure") >= remove, KINDS.index("remove")).otherwise(
            KINDS.index("generalise")).alias("rank")), "pii-terms-found")
    # repeated rows have the same spans
    windows = scanned.where(F.size("near") > 0).select(
        "doc_id", "text_key", F.explode("near").alias("near"))
    hits = windows.join(found, (F.col("near.entity") == F.col("e")) & (F.col("near.term") == F.col("t")))
    placed = hits.groupBy("doc_id", "text_key", "near.start", "near.end").agg(
        F.min("rank").alias("rank")).groupBy(
        F.col("doc_id").alias("id"), F.col("text_key").alias("key")).agg(
        F.collect_list(F.struct("start", "rank", "end")).alias("added"))
    joined = scanned.select("doc_id", "text_key", F.transform("base", lambda s: F.struct(
        s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))).alias("base")
    ).join(placed, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left")
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")
    return joined.select("doc_id", "text_key", "base", F.array_sort(F.concat(
        "base", F.coalesce("added", none))).alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def replaced(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text without its spans: base spans and generalised terms leave a placeholder, a
    removed term leaves nothing. Of spans that overlap the first gives the placeholder."""
    out, at = [], 0
    for start, rank, end in spans:
        if start >= at:
            kind = KINDS[rank]
            out.append(text[at:start])
            if kind == "generalise":
                out.append("[NAME]" if text[start:start + 1].isupper() else "[TERM]")
            elif kind != "remove":
                out.append(f"[{kind.upper()}]")
        at = max(at, end)
    return "".join(out) + text[at:]


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with their columns, the text without personal data. Null stays null."""
    found = personal_data(docs, **options).where(F.size("spans") > 0).select(
        F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "spans").distinct()
    rows = docs.select(F.struct("*").alias("row")).join(
        found, F.col("row.doc_id").cast("long").eqNullSafe(F.col("id"))
        & (F.xxhash64("row.text") == F.col("key")), "left")

    @F.pandas_udf("string")
    def without(text, starts, ranks, ends):
        return text.combine(starts.combine(ranks.combine(ends, lambda r, e: (r, e)), lambda s, x: (s, *x)),
                            lambda t, x: t if t is None or x[0] is None else replaced(t, list(zip(*x))))

    clean = without("row.text", "spans.start", "spans.rank", "spans.end")
    out = rows.select("row", F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(clean).alias("clean"))
    return out.select(*[F.col("clean").alias(c) if c == "text" else F.col("row").getField(c).alias(c)
                        for c in docs.columns])
