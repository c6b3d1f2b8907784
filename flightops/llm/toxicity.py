"""Toxic spans and document scores with a linear-chain conditional random field.

Labels mark documents, not words, so labelled tokens are derived: over all labelled
documents of the training part, each hashed feature of a word (the word, its first and last
letters) is counted by the documents that hold it, toxic and other. A word of a toxic
document is a toxic token if one of its features is much more frequent in toxic documents.
The field has two states per token; emission weights belong to the hashed features of the
word, transition weights to neighbouring states. It is fitted by gradient ascent on the exact
likelihood over a bounded sample: ``fit_documents`` documents of each class, chosen by a hash
of their ids, and at most ``FIT_SEQUENCES`` sequences of each.

Every whole text is then scored: forward-backward marginals per token give the toxic spans,
and a logistic function of the largest marginal and of the expected number of toxic tokens
(fitted on the sample) gives the document's score. Only the text enters a score.

Defined results: null and empty texts have no token and are scored as such; without toxic labels all
scores are 0; rows with a null label or id are not used for training; repeated rows are
scored row by row. Held out are ids whose crc32 modulo 5 is 0; a null id is never held out.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = 1 << 18
FIT_DOCUMENTS = 1000  # of each class
FIT_SEQUENCES = 4  # of each document
SEQUENCE = 64  # tokens of a chain
MIN_DOCUMENTS = 3  # toxic documents that hold a toxic feature
MIN_SHARE = 0.01  # of all toxic documents, likewise
MIN_RATIO = 20.0
ROUNDS = 80
SPAN_AT = 0.5

_EDGES = "".join(chr(c) for c in chain(range(33, 48), range(58, 65), range(91, 97),
                                       range(123, 127)))


def bare(word: str) -> str:
    return word.strip(_EDGES).lower()


def features(word: str) -> list[int]:
    """Hashed features of a bare word."""
    from xxhash import xxh32_intdigest

    parts = (f"={word}", f"<{word[:3]}", f"<<{word[:4]}", f"<<<{word[:5]}", f">{word[-4:]}")
    return [xxh32_intdigest(p.encode("utf-8", "surrogatepass"), 11) % HASHES for p in parts]


class _Cache(dict):
    """Values of words, computed once; emptied when there are many."""

    def __init__(self, value):
        super().__init__()
        self.value = value

    def __missing__(self, word):
        if len(self) >= 1 << 19:
            self.clear()
        found = self[word] = self.value(word)
        return found


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_marks(labels: DataFrame) -> DataFrame:
    """id and toxic (0 or 1) of the labelled training documents."""
    known = labels.where("toxic is not null and doc_id is not null")
    return known.where(~is_held_out(F.col("doc_id"))).groupBy(
        F.col("doc_id").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))


def toxic_features(docs: DataFrame, marks: DataFrame, min_documents: int = MIN_DOCUMENTS,
                   min_share: float = MIN_SHARE, min_ratio: float = MIN_RATIO) -> np.ndarray:
    """Which of the ``HASHES`` features are much more frequent in toxic documents; counted
    over all training documents."""

    def count(batches):
        known = _Cache(lambda w: features(bare(w)))
        seen, documents = np.zeros((2, HASHES), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = set(chain.from_iterable(
                    map(known.__getitem__, set((text or "").split()))))
                seen[toxic, list(found)] += 1
                documents[toxic] += 1
        # the last row counts the documents
        at = np.append(np.flatnonzero(seen.any(0)), HASHES)
        table = np.append(seen, documents[:, None], 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(table[1, at]), pa.array(table[0, at])],
            ["feature", "toxic", "other"])

    texts = docs.select("doc_id", "text").where(~is_held_out(F.col("doc_id")))
    # labels cover a share of all documents, so they are never small where texts are many
    joined = texts.join(marks.hint("merge"), F.col("doc_id") == F.col("id"))
    counts = joined.select("toxic", "text").mapInArrow(
        count, "feature long, toxic long, other long").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    table = np.zeros((HASHES + 1, 2))
    for batch in counts.toArrow().to_batches():  # at most HASHES + 1 rows
        table[batch.column(0).to_numpy()] = np.stack(
            [batch.column(1).to_numpy(), batch.column(2).to_numpy()], 1)
    toxic, other = np.maximum(table[-1], 1)
    return (table[:-1, 0] >= max(min_documents, min_share * toxic)) & (
        table[:-1, 0] / toxic >= min_ratio * (table[:-1, 1] + 0.5) / other)


def chosen_documents(docs: DataFrame, marks: DataFrame, fit_documents: int) -> DataFrame:
    """toxic and text of at most ``fit_documents`` ids of each class."""
    order = [F.xxhash64("id"), "id"]
    chosen = marks.where("toxic = 1").orderBy(*order).limit(fit_documents).unionByName(
        marks.where("toxic = 0").orderBy(*order).limit(fit_documents))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col(
        "id")).select("toxic", "text")


def sample(docs: DataFrame, marks: DataFrame, suspicious: np.ndarray,
           fit_documents: int = FIT_DOCUMENTS) -> list[tuple[int, list[str], list[int]]]:
    """(toxic, words, states) of the chosen documents; of each the sequences with most
    suspicious words, so that the field sees them in other documents too."""

    def cut(batches):
        known = _Cache(lambda w: bool(suspicious[features(bare(w))].any()))
        for batch in batches:
            out = []
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (text or "").split()
                parts = [words[i:i + SEQUENCE] for i in range(0, len(words), SEQUENCE)]
                found = [[int(known[w]) for w in p] for p in parts]
                order = sorted(range(len(parts)), key=lambda i: (-sum(found[i]), i))
                out += [(toxic, parts[i], [toxic * f for f in found[i]])
                        for i in order[:FIT_SEQUENCES]]
            columns = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([
                pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.list_(pa.string())),
                pa.array(columns[2], pa.list_(pa.int32()))], ["toxic", "words", "states"])

    rows = chosen_documents(docs, marks, fit_documents).mapInArrow(
        cut, "toxic int, words array<string>, states array<int>")
    found = [(r["toxic"], list(r["words"]), list(r["states"])) for r in rows.collect()]
    return sorted(found)  # repeated rows and task order do not change the fit


def _chains(x: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward odds of state 1 of chains (rows of log emission odds ``x``)."""
    e = np.exp(np.clip(x, -40, 40))
    forward, backward = np.empty_like(e), np.ones_like(e)
    (a, b), (c, d) = np.exp(step)
    forward[:, 0] = e[:, 0]
    for t in range(1, x.shape[1]):
        r = forward[:, t - 1]
        forward[:, t] = np.clip(e[:, t] * (b + r * d) / (a + r * c), 1e-30, 1e30)
    for t in range(x.shape[1] - 2, -1, -1):
        q = e[:, t + 1] * backward[:, t + 1]
        backward[:, t] = np.clip((c + d * q) / (a + b * q), 1e-30, 1e30)
    return forward, backward


def fit_field(sequences, rounds: int = ROUNDS) -> dict:
    """Emission weights, bias and transition weights."""
    words = sorted({w for _, seq, _ in sequences for w in seq})
    place = {w: i for i, w in enumerate(words)}
    parts = np.array([features(bare(w)) for w in words], np.int64).reshape(-1, 5)
    x_at = np.full((len(sequences), SEQUENCE), -1)
    states = np.zeros((len(sequences), SEQUENCE))
    for i, (_, seq, state) in enumerate(sequences):
        x_at[i, :len(seq)] = [place[w] for w in seq]
        states[i, :len(seq)] = state
    real = x_at >= 0
    pairs = real[:, 1:]
    seen = [((states[:, :-1] == i) & (states[:, 1:] == j) & pairs).sum()
            for i in (0, 1) for j in (0, 1)]
    weights, bias, step = np.zeros(HASHES), -2.0, np.zeros((2, 2))
    pace_w, pace_o = np.full(HASHES, 1e-8), np.full(5, 1e-8)
    for _ in range(rounds if len(sequences) else 0):
        emission = weights[parts].sum(1) + bias
        x = np.where(real, emission[x_at], -40.0)
        forward, backward = _chains(x, step)
        odds = forward * backward
        missing = (states - odds / (1 + odds)) * real
        by_word = np.bincount(x_at[real], missing[real], len(words))
        slope = np.bincount(parts.ravel(), np.repeat(by_word, 5), HASHES) - 0.01 * weights
        (a, b), (c, d) = np.exp(step)
        q = np.exp(x[:, 1:]) * backward[:, 1:]
        r = forward[:, :-1]
        joint = np.stack([np.full_like(q, a), b * q, r * c, r * d * q])
        joint = (joint / joint.sum(0) * pairs).sum((1, 2))
        others = np.append(np.array(seen) - joint - 0.01 * step.ravel(), by_word.sum())
        pace_w += slope ** 2
        pace_o += others ** 2
        weights += 0.5 * slope / np.sqrt(pace_w)
        step += 0.2 * (others[:4] / np.sqrt(pace_o[:4])).reshape(2, 2)
        bias += 0.2 * others[4] / np.sqrt(pace_o[4])
    return {"weights": weights.astype(np.float32), "bias": float(bias), "step": step}


class Tagger:
    """Marginals of whole texts."""

    def __init__(self, field: dict):
        self.field = field
        self.known = _Cache(lambda w: float(
            field["weights"][features(bare(w))].sum() + field["bias"]))

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Probability of state 1 per word of each text."""
        sizes = np.array([len(t) for t in texts], np.int64)
        flat = np.fromiter(map(self.known.__getitem__, chain.from_iterable(texts)),
                           np.float64, int(sizes.sum()))
        rows = -(-sizes // SEQUENCE)
        x = np.full(int(rows.sum()) * SEQUENCE, -40.0)
        begins = (np.cumsum(rows) - rows) * SEQUENCE
        at = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))
        x[at] = flat
        forward, backward = _chains(x.reshape(-1, SEQUENCE), self.field["step"])
        odds = (forward * backward).ravel()[at]
        return np.split(odds / (1 + odds), np.cumsum(sizes)[:-1]) if len(texts) else []


def summary(marginals: np.ndarray) -> tuple[float, ...]:
    """What a document's score depends on: log odds of the largest marginal (bounded), the
    expected number of likely toxic tokens and their share, both as logarithms."""
    if not len(marginals):
        return -10.0, 0.0, 0.0
    top = float(np.clip(marginals.max(), 1e-5, 1 - 1e-5))
    likely = float(marginals[marginals > 0.1].sum())
    return (float(np.log(top / (1 - top))), float(np.log1p(likely)),
            float(np.log1p(1000 * likely / len(marginals))))


def fit_score(chosen: DataFrame, field: dict, rounds: int = 50) -> np.ndarray:
    """Weights of the logistic function of ``summary`` over whole chosen documents, by
    Newton's method with a ridge."""
    sent = chosen.sparkSession.sparkContext.broadcast(field)

    def summarise(batches):
        tagger = Tagger(sent.value)
        for batch in batches:
            found = [summary(m) for m in tagger.marginals(
                [(t or "").split() for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.float64()) for c in zip(*found))],
                ["toxic", "top", "likely", "share"])

    rows = sorted(tuple(r) for r in chosen.mapInArrow(
        summarise, "toxic int, top double, likely double, share double").collect())
    toxic = np.array([r[0] for r in rows], float)
    given = np.array([[1.0, *r[1:]] for r in rows])
    weights, ridge = np.zeros(4), np.diag([1e-3, 0.1, 0.1, 0.1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(given @ weights, -30, 30)))
        slope = given.T @ (toxic - p) - ridge @ weights
        curve = (given * (p * (1 - p))[:, None]).T @ given + ridge
        weights = weights + np.linalg.solve(curve, slope)
    return weights


def fit(docs: DataFrame, labels: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> dict | None:
    """The field and the score function; None without toxic tokens to learn from."""
    marks = training_marks(labels)
    sequences = sample(docs, marks, toxic_features(docs, marks), fit_documents)
    if not any(any(states) for _, _, states in sequences):
        return None
    field = fit_field(sequences)
    chosen = chosen_documents(docs, marks, fit_documents)
    return field | {"score": fit_score(chosen, field)}


def toxicity(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, held_out, score, predicted and the toxic spans (word places, end exclusive)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # HASHES weights

    def score(batches):
        field = sent.value
        tagger = field and Tagger(field)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                piece = batch.slice(start, 500)
                texts = [(t or "").split() for t in piece.column(1).to_pylist()]
                if not tagger:
                    scores, spans = [0.0] * len(texts), [[]] * len(texts)
                else:
                    scores, spans = [], []
                    for m in tagger.marginals(texts):
                        z = float(np.dot(field["score"], (1.0, *summary(m))))
                        scores.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
                        edge = np.flatnonzero(np.diff(
                            (m > SPAN_AT).astype(np.int8), prepend=0, append=0))
                        spans.append([{"start": a, "end": b}
                                      for a, b in edge.reshape(-1, 2).tolist()])
                span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
                yield pa.RecordBatch.from_arrays([
                    piece.column(0), pa.array(scores, pa.float64()),
                    pa.array(spans, pa.list_(span))], ["doc_id", "score", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(
        score, "doc_id long, score double, spans array<struct<start:long,end:long>>").select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
