"""Windows of symbols that also start in an earlier document, found without listing them all.

A document is a sequence of symbols (bytes, or words). For a window length L and a gram
length k, each window is named by the least hash of its grams; neighbours with the same name
form a run, about 2 / (L - k + 2) runs per symbol. Equal windows have equal names, so

1. per batch of documents, the runs are reduced to one entry per name: the smallest doc_id,
   and whether all runs of that name spell the same text. Entries of all batches meet by
   name. Names of one document only are dropped: nothing in their runs repeats.
2. names that always spell the same text are settled: their windows first start in the
   smallest document.
3. for the other names each distinct text of a run is sent once, with the hashes of its
   windows, and single windows meet; the answer comes in the order of the question.
   A name that may spell more than ``MANY`` texts (a frequent string in varying context, the
   edges of a passage that many share) has no receiver of its own here: each batch sends its
   distinct windows of such names once, to receivers chosen by the window. So a receiver
   holds at most ``MANY`` texts of a name, and of a window one entry per batch.

Every batch gets back only what concerns it and marks its documents. Batches are hash groups
of documents of about 8 MB; their number, and that of the receivers, follows from the size of
the texts. What a batch sends is reduced within the batch first, so a passage that a third of
all documents share is one entry per batch. Entries travel in compressed blocks, one per pair of sender and receiver.

A name is the number of its receiver and 40 more bits; texts of a run are told apart by 40
bits and windows of a name by 48, or by 48 beside their receiver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_ID = np.iinfo(np.int64).max  # a null doc_id comes after all others
CHUNK = 1 << 18  # symbols that are hashed at a time
BATCH_BYTES = 8 << 20
MANY = 4096  # texts of a name from which its windows are spread; the result is the same

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK = "receiver int, batch int, stage int, data binary"
_KEY = 40  # bits of a name beside its receiver


def _mix(h: np.ndarray, odd: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(odd)
    return h ^ (h >> _U(29))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Windows:
    """Names of the runs of windows in a sequence of documents."""

    def __init__(self, length: int, gram: int, receivers: int):
        self.length, self.gram, self.receivers = length, gram, _U(receivers)
        n = CHUNK + length + 1
        self.powers = _powers(_BASE, n)
        self.inverse = _powers(pow(_BASE, -1, 1 << 64), n)

    def chunks(self, symbols: np.ndarray, lengths: np.ndarray,
               code: np.ndarray | None) -> Iterator[tuple]:
        """Per chunk with windows: (first position, window hashes, begin and end of each run,
        its name, its text hash, its document's index); positions count from the chunk."""
        length, gram = self.length, self.gram
        width = length - gram + 1
        ends = np.cumsum(lengths)
        for first in range(0, len(symbols), CHUNK):
            part = symbols[first:first + CHUNK + length - 1]
            part = part if code is None else code[part]
            n = min(CHUNK, len(part) - length + 1)
            if n <= 0:
                break
            sums = np.empty(len(part) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(part * self.powers[:len(part)], out=sums[1:])
            hashes = _mix((sums[length:length + n] - sums[:n]) * self.inverse[:n])
            least = _mix((sums[gram:] - sums[:-gram]) * self.inverse[:len(part) - gram + 1])
            have = 1
            while have < width:
                step = min(have, width - have)
                least = np.minimum(least[:-step], least[step:])
                have += step
            doc = np.searchsorted(ends, np.arange(first, first + n), side="right")
            inside = np.arange(first + length, first + length + n) <= ends[doc]
            change = np.ones(n, bool)
            change[1:] = (least[1:n] != least[:n - 1]) | (doc[1:] != doc[:-1])
            # a text of one repeated gram would be one long run: cut it
            begins = np.flatnonzero(change)
            at = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
            begins = np.flatnonzero((at % width == 0) & inside)
            if not len(begins):
                continue
            # the last window of a run that lies inside the document
            cuts = np.flatnonzero(at % width == 0)
            cuts, until = cuts[inside[cuts]], np.append(cuts[1:], n)[inside[cuts]]
            last = np.minimum(until, ends[doc[begins]] - first - length + 1) - 1
            name = _mix(least[begins], 0xA0761D6478BD642F)
            name = (name % self.receivers << _U(_KEY)) | (
                name // self.receivers & _U((1 << _KEY) - 1))
            text = _mix(hashes[begins] + _mix(hashes[last] + (last - begins).astype(np.uint64)),
                        0xE7037ED1A0B428DB) >> _U(24)
            yield first, hashes, begins, last, name, text, doc[begins]


def _pack(*columns: tuple[np.ndarray, int]) -> bytes:
    """Columns of integers, cut to so many bytes each, by byte place, compressed."""
    from zstandard import ZstdCompressor

    planes = [np.ascontiguousarray(
        c.view(np.uint8).reshape(-1, c.itemsize)[:, :size].T).tobytes() for c, size in columns]
    return ZstdCompressor(level=1).compress(
        len(columns[0][0]).to_bytes(4, "little") + b"".join(planes))


def _unpack(data: bytes, *sizes: int) -> list[np.ndarray]:
    from zstandard import ZstdDecompressor

    raw = ZstdDecompressor().decompress(data)
    n, at, out = int.from_bytes(raw[:4], "little"), 4, []
    for size in sizes:
        full = np.zeros((n, 8), np.uint8)
        full[:, :size] = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T
        out.append(full.reshape(-1).view(np.uint64))
        at += n * size
    return out


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys (first key first), and where each group begins in that order."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        sorted_key = key[order]
        new[1:] |= sorted_key[1:] != sorted_key[:-1]
    return order, np.flatnonzero(new)


def _blocks(rows: list[tuple]) -> pa.Table:
    """Rows of (receiver, batch, stage, data)."""
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                    ("receiver", "batch", "stage", "data"))


def _receivers(name: np.ndarray) -> list[tuple[int, slice]]:
    """Each receiver of sorted names, with its part of them."""
    to = name >> _U(_KEY)
    begins = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else []
    return [(int(to[a]), slice(a, b)) for a, b in zip(begins, np.append(begins[1:], len(to)))]


def _reduce(keys: list[np.ndarray], doc: np.ndarray, text: np.ndarray | None):
    """One entry per key, in order: (index of a member, smallest doc, flags). Flag 1: several
    documents, flag 2: several texts, and above them the power of two that their number does
    not exceed."""
    order, begins = _groups(*keys)
    docs = doc[order]
    smallest = np.minimum.reduceat(docs, begins)
    flags = (np.maximum.reduceat(docs, begins) != smallest).astype(np.uint64)
    if text is not None:
        texts = text[order]
        several = np.maximum.reduceat(texts, begins) != np.minimum.reduceat(texts, begins)
        flags |= several.astype(np.uint64) << _U(1)
        size = np.diff(np.append(begins, len(order)))
        power = np.ceil(np.log2(size)).astype(np.uint64)
        flags |= np.where(several, power, _U(0)) << _U(2)
    return order[begins], smallest, flags


def _meet(keys: list[np.ndarray], doc: np.ndarray, flags: np.ndarray,
          text: np.ndarray | None = None, many: int = MANY):
    """For entries of all batches: the smallest document of the key, whether several
    documents have it, and whether they spell several texts (1) or maybe over ``many`` (2)."""
    order, begins = _groups(*keys)
    size = np.diff(np.append(begins, len(order)))
    docs, seen = doc[order], np.bitwise_or.reduceat(flags[order], begins)
    smallest = np.minimum.reduceat(docs, begins)
    shared = (np.maximum.reduceat(docs, begins) != smallest) | (seen & _U(1) > 0)
    several = (seen & _U(2) > 0).astype(np.uint8)
    if text is not None:
        texts = text[order]
        several |= np.maximum.reduceat(texts, begins) != np.minimum.reduceat(texts, begins)
        spelled = np.add.reduceat(_U(1) << (flags[order] >> _U(2)), begins)
        several += several * (spelled > many)
    out = []
    for values in (smallest, shared, several):
        back = np.empty(len(order), values.dtype)
        back[order] = np.repeat(values, size)
        out.append(back)
    return out


def _meet_names(table: pa.Table, many: int = MANY) -> pa.Table:
    parts = [_unpack(d, 5, 5, 1, 8) for d in table.column("data").to_pylist()]
    receiver = table.column("receiver")[0].as_py()
    key, text, flags, doc = (np.concatenate(c) for c in zip(*parts))
    doc = doc.view(np.int64)
    first, shared, several = _meet([key], doc, flags, text, many)
    # a batch that only holds the first document needs a name only to spell its windows out
    wanted = shared & ((several > 0) | (doc != first) | (flags & _U(1) > 0))
    ends, rows = np.cumsum([len(p[0]) for p in parts]), []
    for batch, begin, end in zip(table.column("batch").to_pylist(), np.append(0, ends), ends):
        at = begin + np.flatnonzero(wanted[begin:end])
        if len(at):
            rows.append((receiver, batch, 1, _pack(
                (key[at], 5), (several[at], 1), (first[at], 8))))
    return _blocks(rows)


def _meet_windows(table: pa.Table) -> pa.Table:
    receiver, by_name, spread = table.column("receiver")[0].as_py(), [], []
    for batch, stage, data in zip(*(table.column(c).to_pylist() for c in (
            "batch", "stage", "data"))):
        if stage == 3:
            spread.append((batch, _unpack(data, 6, 1, 8)))
            continue
        cut = int.from_bytes(data[:4], "little")
        key, size, flags, doc = _unpack(data[4:cut], 5, 1, 1, 8)
        (window,) = _unpack(data[cut:], 6)
        size = size.astype(np.int64)
        by_name.append((batch, [np.repeat(key, size), window, np.repeat(flags, size),
                                np.repeat(doc, size)]))
    return _blocks([(receiver, batch, stage, data)
                    for stage, parts in ((2, by_name), (3, spread)) if parts
                    for batch, data in _found(parts)])


def _found(parts: list[tuple[int, list[np.ndarray]]]) -> Iterator[tuple[int, bytes]]:
    """Answers to the entries of each batch, whose columns are keys, flags and document."""
    *keys, flags, doc = (np.concatenate(c) for c in zip(*(columns for _, columns in parts)))
    doc = doc.view(np.int64)
    first, shared, _ = _meet(keys, doc, flags)
    hit = shared & ((doc != first) | (flags & _U(1) > 0))
    ends = np.cumsum([len(columns[0]) for _, columns in parts])
    for (batch, _), begin, end in zip(parts, np.append(0, ends), ends):
        if hit[begin:end].any():
            yield batch, _two(_pack((hit[begin:end].astype(np.uint8), 1)),
                              _pack((first[begin:end][hit[begin:end]], 8)))


def _two(a: bytes, b: bytes) -> bytes:
    return (len(a) + 4).to_bytes(4, "little") + a + b


def _spread(begins: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... (size of them) for every begin."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - size), size)


class _Names:
    """What a batch got back for its names, in their order."""

    def __init__(self, got: pa.Table):
        parts = [[np.full(len(key), receiver << _KEY, np.uint64) + key, several, first]
                 for receiver, stage, data in zip(*(got.column(c).to_pylist() for c in (
                     "receiver", "stage", "data"))) if stage == 1
                 for key, several, first in [_unpack(data, 5, 1, 8)]]
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [
            np.zeros(0, np.uint64)] * 3
        order = np.argsort(columns[0])
        self.name = columns[0][order]
        self.several = columns[1][order] > 0
        self.spread = columns[1][order] > 1
        self.first = columns[2][order].view(np.int64)

    def find(self, name: np.ndarray) -> np.ndarray:
        """Place of each name, or -1."""
        if not len(self.name):
            return np.full(len(name), -1)
        place = np.searchsorted(self.name, name)
        place[place == len(self.name)] = 0
        return np.where(self.name[place] == name, place, -1)


class _Spelled:
    """The distinct texts of a batch's runs whose name spells several texts, in order of the
    names; those of names whose windows are spread come last."""

    def __init__(self, names: _Names, chunks, order: np.ndarray, receivers: int):
        self.settled, self.runs = [], []  # (begin, size, first), (begin, name, text)
        found = []
        for offset, hashes, begins, last, name, text, doc in chunks:
            place = names.find(name)
            size = last - begins + 1
            known = np.flatnonzero(place >= 0)
            several = names.several[place[known]]
            done, todo = known[~several], known[several]
            earlier = names.first[place[done]]
            keep = earlier < order[doc[done]]
            self.settled.append((offset + begins[done][keep], size[done][keep], earlier[keep]))
            found.append((name[todo], text[todo], order[doc[todo]], size[todo],
                          hashes[_spread(begins[todo], size[todo])] >> _U(16),
                          offset + begins[todo]))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [
            np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 2 + [
            np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        self.run_name, self.run_text, self.run_doc, self.run_size, windows, self.begin = columns
        at, self.doc, self.flags = _reduce(
            [self.run_name, self.run_text], self.run_doc, None) if len(self.begin) else (
            np.zeros(0, np.int64), self.run_doc, self.run_name)
        spread = names.spread[names.find(self.run_name[at])] if len(at) else np.zeros(0, bool)
        moved = np.argsort(spread, kind="stable")
        at, self.doc, self.flags = at[moved], self.doc[moved], self.flags[moved]
        self.by_name = int((~spread).sum())
        self.name, self.text, self.size = (
            self.run_name[at], self.run_text[at], self.run_size[at])
        starts = np.cumsum(self.run_size) - self.run_size
        self.windows = windows[_spread(starts[at], self.size)]
        self.start = np.cumsum(self.size) - self.size
        self._spread_windows(_U(receivers))

    def _spread_windows(self, receivers: np.uint64) -> None:
        """One entry per distinct window of the spread names, in order of their receivers."""
        size = self.size[self.by_name:]
        self.first_spread = len(self.windows) - int(size.sum())
        key = _mix(self.windows[self.first_spread:] + np.repeat(
            _mix(self.name[self.by_name:]), size))
        to, key = key % receivers, key // receivers & _U((1 << 48) - 1)
        order, begins = _groups(to, key)
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.repeat(
            np.arange(len(begins)), np.diff(np.append(begins, len(order))))
        self.to, self.key = to[order[begins]], key[order[begins]]
        docs = np.repeat(self.doc[self.by_name:], size)[order]
        flags = np.repeat(self.flags[self.by_name:], size)[order]
        if not len(order):
            self.key_doc, self.key_flags = docs, flags
            return
        self.key_doc = np.minimum.reduceat(docs, begins)
        self.key_flags = np.bitwise_or.reduceat(flags, begins) | (
            np.maximum.reduceat(docs, begins) != self.key_doc).astype(np.uint64)

    def _parts(self) -> list[tuple[int, slice]]:
        return _receivers(self.to << _U(_KEY))

    def blocks(self, batch: int) -> pa.Table:
        rows = [(receiver, batch, 3, _pack(
            (self.key[part], 6), (self.key_flags[part], 1), (self.key_doc[part], 8)))
            for receiver, part in self._parts()]
        for receiver, part in _receivers(self.name[:self.by_name]):
            begin, end = self.start[part.start], self.start[part.stop - 1] + self.size[
                part.stop - 1]
            rows.append((receiver, batch, 2, _two(
                _pack((self.name[part], 5), (self.size[part].astype(np.uint8), 1),
                      (self.flags[part], 1), (self.doc[part], 8)),
                _pack((self.windows[begin:end], 6)))))
        return _blocks(rows)

    def answers(self, got: pa.Table) -> np.ndarray:
        """The first document of each window, or NO_ID."""
        first = np.full(len(self.windows), NO_ID, np.int64)
        of_key = np.full(len(self.key), NO_ID, np.int64)
        data = {(s, r): d for r, s, d in zip(*(got.column(c).to_pylist() for c in (
            "receiver", "stage", "data"))) if s > 1}
        asked = [((2, receiver), first, self.start[part.start])
                 for receiver, part in _receivers(self.name[:self.by_name])]
        asked += [((3, receiver), of_key, part.start) for receiver, part in self._parts()]
        for question, out, begin in asked:
            if question in data:
                cut = int.from_bytes(data[question][:4], "little")
                (hit,) = _unpack(data[question][4:cut], 1)
                (docs,) = _unpack(data[question][cut:], 8)
                out[begin + np.flatnonzero(hit)] = docs.view(np.int64)
        first[self.first_spread:] = of_key[self.entry]
        return first

    def place(self) -> np.ndarray:
        """The text of each run, as a place among the distinct ones."""
        both = np.append(self.name, self.run_name), np.append(self.text, self.run_text)
        order, begins = _groups(*both)
        group = np.empty(len(order), np.int64)
        group[order] = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(order))))
        place = np.empty(len(begins), np.int64)
        place[group[:len(self.name)]] = np.arange(len(self.name))
        return place[group[len(self.name):]]


def mark_repeats(docs: DataFrame, read: Callable, write: Callable, schema: str,
                 length: int, gram: int, batches: int | None = None,
                 code: np.ndarray | None = None, many: int = MANY) -> DataFrame:
    """Rows of ``write`` for all of ``docs`` (doc_id, text).

    ``read(texts)`` gives the symbols of all texts in a row and the number of symbols of
    each; a symbol is a random uint64, or the place of one in ``code``; ``write(texts, doc_ids, lengths, covered, first)`` gets, per symbol,
    whether it lies in a repeated window, and the smallest doc_id for windows that start at
    it (else ``NO_ID``), and returns an Arrow table.
    """
    if batches is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        batches = -(-size // BATCH_BYTES)
    n = max(1, batches)
    rows = docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("batch"),
        F.col("doc_id").cast("long").alias("doc_id"), "text")
    state = {}

    def chunks(symbols, lengths):
        if "windows" not in state:
            state["windows"] = Windows(length, gram, n)
        return state["windows"].chunks(symbols, lengths, code)

    def load(table: pa.Table):
        # a shuffle has no fixed order, but questions and answers must see the same runs
        rows = sorted(zip(
            (NO_ID if i is None else i for i in table.column("doc_id").to_pylist()),
            (t or "" for t in table.column("text").to_pylist())))
        texts = [t for _, t in rows]
        symbols, lengths = read(texts)
        return ([None if i == NO_ID else i for i, _ in rows], texts, symbols, lengths,
                np.array([i for i, _ in rows], np.int64))

    def send_names(table: pa.Table) -> pa.Table:
        _, _, symbols, lengths, order = load(table)
        found = [(name, text, order[doc])
                 for _, _, _, _, name, text, doc in chunks(symbols, lengths)]
        if not found:
            return _blocks([])
        name, text, doc = (np.concatenate(c) for c in zip(*found))
        at, smallest, flags = _reduce([name], doc, text)
        name, text, batch = name[at], text[at], table.column("batch")[0].as_py()
        return _blocks([(receiver, batch, 1, _pack(
            (name[part], 5), (text[part], 5), (flags[part], 1), (smallest[part], 8)))
            for receiver, part in _receivers(name)])

    def send_windows(table: pa.Table, got: pa.Table) -> pa.Table:
        if not table.num_rows or not got.num_rows:
            return _blocks([])
        _, _, symbols, lengths, order = load(table)
        spelled = _Spelled(_Names(got), chunks(symbols, lengths), order, n)
        return spelled.blocks(table.column("batch")[0].as_py())

    def mark(table: pa.Table, got: pa.Table) -> pa.Table:
        ids, texts, symbols, lengths, order = load(table)
        first = np.full(len(symbols), NO_ID, np.int64)
        if got.num_rows and table.num_rows:
            spelled = _Spelled(_Names(got), chunks(symbols, lengths), order, n)
            for begin, size, earlier in spelled.settled:
                first[_spread(begin, size)] = np.repeat(earlier, size)
            if len(spelled.begin):
                answer = spelled.answers(got)[
                    _spread(spelled.start[spelled.place()], spelled.run_size)]
                where = _spread(spelled.begin, spelled.run_size)
                earlier = answer < np.repeat(spelled.run_doc, spelled.run_size)
                first[where[earlier]] = answer[earlier]
        reach = np.cumsum(first != NO_ID, dtype=np.int32)
        if len(reach) > length:
            reach[length:] -= reach[:-length].copy()
        return write(texts, ids, lengths, reach > 0, first)

    def meet_names(table: pa.Table) -> pa.Table:
        return _meet_names(table, many)

    by_batch = rows.groupBy("batch")
    names = by_batch.applyInArrow(send_names, _BLOCK).groupBy("receiver").applyInArrow(
        meet_names, _BLOCK)
    singles = by_batch.cogroup(names.groupBy("batch")).applyInArrow(
        send_windows, _BLOCK).groupBy("receiver").applyInArrow(_meet_windows, _BLOCK)
    return by_batch.cogroup(names.unionByName(singles).groupBy("batch")).applyInArrow(
        mark, schema)


def bytes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes as symbols; ``BYTE_CODE`` has a fixed random number for each."""
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    return (np.frombuffer(b"".join(coded), np.uint8),
            np.array([len(c) for c in coded], np.int64))


BYTE_CODE = _mix(_mix(np.arange(1, 257, dtype=np.uint64)))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= 1 << 20:
            self.clear()
        value = self[word] = xxh64_intdigest(word, 7)
        return value


_HASHES = _WordHashes()


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words as symbols: their 64-bit hashes."""
    split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    lengths = np.array([len(w) for w in split], np.int64)
    return np.fromiter(map(_HASHES.__getitem__, chain.from_iterable(split)), np.uint64,
                       int(lengths.sum())), lengths
