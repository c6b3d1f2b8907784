"""Token counts with a transducer compiled from a merge vocabulary.

A subword vocabulary with ranked merges has one encoding per text, and a sequence of pieces
is that encoding exactly if each two neighbours stay apart when encoded together. So the
last piece of every prefix follows from the last pieces of the shorter prefixes: reading one
more character picks the only piece that ends there and may follow. ``Transducer`` compiles
these transitions as they are met and annotates each state with the number of pieces emitted
so far; sorted words share the states of their common prefixes.

No piece reaches over a place where a space mark follows another character, so at such a
place every state maps to the start state. The map of a chunk of text is therefore a head, a
count and a tail; ``compose`` joins two neighbours, and ``compose_all`` folds the maps of a
long text pairwise, level by level, as a parallel prefix scan does.

Defined results: null text is empty and has no tokens, rows are counted one by one, so
repeated rows and null ids give equal rows.
"""

from __future__ import annotations

import re
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"  # fixed: stands for a space in the vocabulary
CHUNK = 1 << 16  # characters
REMEMBERED = 1 << 19  # words whose count a task keeps
LIMIT = 4096

_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Transducer:
    """Counts the pieces of a text for a vocabulary of ranked pieces.

    ``ranks`` maps a piece to its rank (a smaller rank merges first). A character outside the
    vocabulary emits its UTF-8 bytes.
    """

    def __init__(self, ranks: dict[str, float]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.words: dict[str, int] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text, by applying the merges in order of rank."""
        parts = list(text)
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], float("inf")), i)
                           for i in range(len(parts) - 1))
            if rank == float("inf"):
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def starts(self, piece: str) -> bool:
        if (known := self.whole.get(piece)) is None:
            known = self.whole[piece] = self.merged(piece) == [piece]
        return known

    def follows(self, left: str, right: str) -> bool:
        if (known := self.pairs.get((left, right))) is None:
            known = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return known

    def count_all(self, units: list[str]) -> list[int]:
        """Counts of texts that come in sorted order."""
        ranks, longest, pairs = self.ranks, self.longest, self.pairs
        last, emitted, before, out = [""], [0], "", []
        for unit in units:
            shared, most = 0, min(len(unit), len(before))
            while shared < most and unit[shared] == before[shared]:
                shared += 1
            del last[shared + 1:], emitted[shared + 1:]
            for end in range(shared + 1, len(unit) + 1):
                for begin in range(max(0, end - longest), end):
                    piece = unit[begin:end]
                    if piece not in ranks and end - begin > 1:
                        continue
                    if begin:
                        left = last[begin]
                        if (fits := pairs.get((left, piece))) is None:
                            fits = self.follows(left, piece)
                    else:
                        fits = self.starts(piece)
                    if fits:
                        break
                last.append(piece)
                emitted.append(emitted[begin] + (
                    1 if piece in ranks else len(piece.encode())))
            before = unit
            out.append(emitted[-1])
        return out

    def learn(self, words: set[str]) -> None:
        """Count words that are not yet known; the oldest counts go when there are many."""
        new = sorted(words.difference(self.words))
        if len(self.words) + len(new) > REMEMBERED:
            self.words.clear()
            new = sorted(words)
        self.words.update(zip(new, self.count_all(new)))

    def count(self, marked: str) -> int:
        """Pieces of a text in which marks stand for spaces."""
        units = _UNIT.findall(marked)
        self.learn(set(units))
        return sum(map(self.words.__getitem__, units))

    def chunk_map(self, chunk: str) -> tuple:
        """(head, count, tail) of a chunk, or (text,) if no reset lies within it."""
        units = _UNIT.findall(chunk)
        if len(units) < 2:
            return (chunk,)
        inner = units[1:-1]
        self.learn(set(inner))
        return units[0], sum(map(self.words.__getitem__, inner)), units[-1]

    def compose(self, a: tuple, b: tuple) -> tuple:
        if len(a) == 1:
            return self._prepend(a[0], b)
        if len(b) == 1:
            joined = self.chunk_map(a[2] + b[0])
            if len(joined) == 1:
                return a[0], a[1], joined[0]
            return a[0], a[1] + self.count(joined[0]) + joined[1], joined[2]
        return a[0], a[1] + self.count(a[2] + b[0]) + b[1], b[2]

    def _prepend(self, text: str, b: tuple) -> tuple:
        if len(b) == 1:
            return self.chunk_map(text + b[0])
        joined = self.chunk_map(text + b[0])
        if len(joined) == 1:
            return joined[0], b[1], b[2]
        return joined[0], joined[1] + self.count(joined[2]) + b[1], b[2]

    def compose_all(self, maps: list[tuple]) -> int:
        while len(maps) > 1:
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i]
                    for i in range(0, len(maps), 2)]
        (one,) = maps
        if len(one) == 1:
            return self.count(one[0])
        return self.count(one[0]) + one[1] + self.count(one[2])

    def count_texts(self, texts: list[str], chunk: int = CHUNK) -> list[int]:
        """Counts of whole texts; a mark is put before each."""
        split, odd = [], {}
        for i, text in enumerate(texts):
            text = text.replace(MARK, " ") if MARK in text else text
            if not text:
                split.append(())
            elif len(text) > chunk or text[0] == " " or "  " in text:
                odd[i] = MARK + text.replace(" ", MARK)
                split.append(())
            else:
                split.append(text.split(" "))
        seen = set(chain.from_iterable(split))
        self._learn_plain(seen)
        counts = [sum(map(self.plain.__getitem__, pieces)) for pieces in split]
        for i, marked in odd.items():
            counts[i] = self.compose_all([self.chunk_map(marked[at:at + chunk])
                                          for at in range(0, len(marked), chunk)])
        return counts

    plain: dict[str, int] = {}

    def _learn_plain(self, words: set[str]) -> None:
        """Counts of words, each with one mark before it, by the word alone."""
        if len(self.plain) + len(words) > REMEMBERED or "plain" not in vars(self):
            self.plain = {}
        new = sorted(words.difference(self.plain))
        self.plain.update(zip(new, self.count_all([MARK + w for w in new])))


_COMPILED: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    """The transducer of a sentencepiece model file, compiled once per process."""
    if path not in _COMPILED:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        _COMPILED[path] = Transducer({
            model.id_to_piece(i): -model.get_score(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)
                    or model.is_unused(i))})
    return _COMPILED[path]


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT,
                 chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""

    def count(batches):
        transducer = compiled(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()),
                pa.array(transducer.count_texts(texts, chunk), pa.int64()),
            ], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit)
