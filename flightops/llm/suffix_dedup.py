"""Suffix-array dedup by distributed prefix doubling.

The suffixes of all texts are compared on prefixes of growing length. A round pairs the rank
of a position with the rank of the position ``offset`` bytes on, brings equal pairs together
in a Spark shuffle and ranks them anew; positions of unique rank leave, and the rounds end
past the threshold. Ranks are 64-bit names instead of places in the sorted order, because
only equality of prefixes decides, so a first round needs no sort of single bytes: the
prefix of 24 bytes is named within the task, and of each neighbourhood only the position
with the least name is sent (any 50 bytes hold one). The next round compares the text of the
run around it, the last one the single prefixes of 50 bytes, each named by its first 24
bytes and what follows.

Defined results: null text is empty; texts shorter than the threshold keep all bytes; null
doc_ids come after all others; rows with equal ids do not shorten each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flightops.llm.repeats import BYTE_CODE, MANY, bytes_of, mark_repeats

THRESHOLD = 50
FIRST = 24  # bytes compared in the first round

SCHEMA = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
          "spans array<struct<start:long,end:long>>")


def _write(texts, ids, lengths, covered, first):
    out = {name: [] for name in (
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
    at = 0
    for doc_id, text, n in zip(ids, texts, lengths.tolist()):
        gone = covered[at:at + n]
        data = text.encode("utf-8", "surrogatepass")
        edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
        spans = edge.reshape(-1, 2).tolist()
        if spans:
            data = np.frombuffer(data, np.uint8)[~gone].tobytes()
        for name, value in (
                ("doc_id", doc_id), ("n_bytes", n), ("n_removed", int(gone.sum())),
                ("n_spans", len(spans)), ("kept_sha256", hashlib.sha256(data).hexdigest()),
                ("spans", [{"start": a, "end": b} for a, b in spans])):
            out[name].append(value)
        at += n
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    return pa.table([
        *(pa.array(out[c], pa.int64()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")),
        pa.array(out["kept_sha256"], pa.string()), pa.array(out["spans"], pa.list_(span))],
        list(out))


def suffix_dedup(docs: DataFrame, threshold: int = THRESHOLD, first: int = FIRST,
                 batches: int | None = None, many: int = MANY) -> DataFrame:
    """One row per row of ``docs``: byte counts, removed spans and the hash of what stays."""
    return mark_repeats(docs, bytes_of, _write, SCHEMA, threshold, first, batches,
                        BYTE_CODE, many)
