"""Substring dedup of words by runs of windows named by hash.

Every run of windows (``repeats``) is named by a hash, as in op10, and the name gives the first
document that spells it. Windows whose run spells several texts are looked up one by one. No
greedy Relative Lempel-Ziv parse is made: ``n_factors`` counts afterwards how often the first
document changes within the covered words.

Defined results: null text has no words; documents shorter than a window keep all words;
null doc_ids come after all others; rows with equal ids do not shorten each other.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flightops.llm.repeats import MANY, NO_ID, mark_repeats, words_of

WINDOW = 13
GRAM = 5

SCHEMA = ("doc_id long, n_words long, n_removed long, n_factors long, kept string, "
          "spans array<struct<start:long,end:long>>")


def _write(keep_text: bool):
    def write(texts, ids, lengths, covered, first):
        out = {name: [] for name in (
            "doc_id", "n_words", "n_removed", "n_factors", "kept", "spans")}
        at = 0
        for doc_id, text, n in zip(ids, texts, lengths.tolist()):
            gone = covered[at:at + n]
            kept = text.encode("utf-8", "surrogatepass").split()
            removed = int(gone.sum())
            spans, factors = [], 0
            if removed:
                kept = list(compress(kept, (~gone).tolist()))
                edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                spans = [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()]
                source = first[at:at + n]
                factors = int(((source != NO_ID) & (np.append(NO_ID, source[:-1]) != source)
                               ).sum())
            data = b" ".join(kept)
            out["kept"].append(data.decode("utf-8", "surrogatepass") if keep_text
                               else hashlib.sha256(data).hexdigest())
            for name, value in (("doc_id", doc_id), ("n_words", n), ("n_removed", removed),
                                ("n_factors", factors), ("spans", spans)):
                out[name].append(value)
            at += n
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        return pa.table([
            *(pa.array(out[c], pa.int64()) for c in (
                "doc_id", "n_words", "n_removed", "n_factors")),
            pa.array(out["kept"], pa.string()), pa.array(out["spans"], pa.list_(span))],
            list(out))

    return write


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM,
                    keep_text: bool = True,
                    batches: int | None = None, many: int = MANY) -> DataFrame:
    """One row per row of ``docs``: counts, removed spans in words, and ``kept``, the words
    that stay (``keep_text=False``: the SHA-256 of them)."""
    return mark_repeats(docs, words_of, _write(keep_text), SCHEMA, window, gram, batches,
                        many=many)
