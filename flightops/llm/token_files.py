"""Token ids in directly addressable binary files.

Documents are put in ascending doc_id order (range shuffle, sort within partitions), encoded,
closed with an end id each, and written in segments, one row of a Parquet table per segment.
A segment's ids are cut into bytes, least significant first. Level 0 holds the low byte of
every id; a continuation bitmap marks the ids that go on in the next level, and a rank
directory counts the marks before each block of bits, so the place of an id in the next
level, and with it any single id, is found without decoding its neighbours.

Layout of a segment (little endian): ``n`` levels as uint32, then per level the number of
entries (uint32), the entries, the bitmap and the directory (uint32 per block).

Encoding remembers the ids of words, cut as the tokenizer's first step does it, and encodes the
new ones of many texts together; texts whose words are not plain to see go to the tokenizer whole.

Defined results: null text is empty and gives the end id alone, null doc_ids come first,
repeated rows are written as often as they occur, in equal places; an empty table gives no
segments.
"""

from __future__ import annotations

import os
import struct
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flightops.llm.common import number_of_tasks

END_ID = 0
SEGMENT_IDS = 1 << 20
BLOCK = 512  # bits of a rank directory block
REMEMBERED = 1 << 18  # words whose ids a task keeps
TOGETHER = 64  # new words in a text
LONG = 64  # characters of a word that is remembered, at most
BATCH_BYTES = 2 << 20  # of texts that are encoded together; the last text may end beyond

SEGMENT = ("first_id long, last_id long, part int, seq int, n_ids long, doc_ids array<long>, "
           "lengths array<long>, codes binary")


def pack(ids: np.ndarray) -> bytes:
    """A segment's bytes for its ids."""
    levels, rest = [], np.asarray(ids, np.uint32)
    while True:
        more = rest > 255
        words = -(-len(rest) // BLOCK) * BLOCK
        bits = np.zeros(words, bool)
        bits[:len(rest)] = more
        counts = bits.reshape(-1, BLOCK).sum(1, dtype=np.uint32)
        directory = (np.cumsum(counts, dtype=np.uint32) - counts).astype("<u4")
        levels.append(b"".join((
            np.uint32(len(rest)).astype("<u4").tobytes(), rest.astype(np.uint8).tobytes(),
            np.packbits(bits, bitorder="little").tobytes(), directory.tobytes())))
        rest = rest[more] >> np.uint32(8)
        if not len(rest):
            return np.uint32(len(levels)).astype("<u4").tobytes() + b"".join(levels)


def sections(codes: bytes) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(entries, bitmap bytes, directory) of every level, as views."""
    out, at = [], 4
    for _ in range(int.from_bytes(codes[:4], "little")):
        n = int.from_bytes(codes[at:at + 4], "little")
        blocks, at = -(-n // BLOCK), at + 4
        entries = np.frombuffer(codes, np.uint8, n, at)
        bitmap = np.frombuffer(codes, np.uint8, blocks * BLOCK // 8, at + n)
        at += n + blocks * BLOCK // 8
        out.append((entries, bitmap, np.frombuffer(codes, "<u4", blocks, at)))
        at += 4 * blocks
    return out


def id_at(codes: bytes, i: int) -> int:
    """The i-th id of a segment: one byte, one bit and one rank per level."""
    value = 0
    for level, (entries, bitmap, directory) in enumerate(sections(codes)):
        value |= int(entries[i]) << (8 * level)
        if not bitmap[i >> 3] >> (i & 7) & 1:
            break
        block, start = i // BLOCK, i // BLOCK * BLOCK
        bits = np.unpackbits(bitmap[start >> 3:(i >> 3) + 1], bitorder="little")
        i = int(directory[block]) + int(bits[:i - start].sum())
    return value


def unpack(codes: bytes) -> np.ndarray:
    """All ids of a segment."""
    levels = sections(codes)
    rest = np.zeros(0, np.uint32)
    for entries, bitmap, _ in reversed(levels):
        ids = entries.astype(np.uint32)
        if len(rest):
            more = np.unpackbits(bitmap, count=len(ids), bitorder="little").view(bool)
            ids[more] |= rest << np.uint32(8)
        rest = ids
    return rest


# In these texts the words of the tokenizer's ByteLevel step follow from single characters. Others
# are encoded whole: special tokens, runs of spaces, characters beyond Latin-1, and characters
# whose class differs between libraries.
_ODD = bytes([*range(0x1C, 0x20), 0x85, 0xA0, 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE])
_ODD_SPACES = (b"  ", b" \n", b" \t", b" \r", b" \v", b" \f", b"<|")
_STOP = b"\x1c"  # stands behind each text
_SPACE, _LETTER, _NUMBER, _OTHER, _END = range(5)


def _class_of(char: str) -> int:
    if char.isspace():
        return _END if char.encode("latin-1") == _STOP else _SPACE
    return _LETTER if char.isalpha() else _NUMBER if char.isdigit() else _OTHER


_CLASSES = np.array([_class_of(chr(b)) for b in range(256)], np.uint8)


def _byte_names() -> dict[int, str]:
    """Latin-1 characters to the names that the ByteLevel step gives their UTF-8 bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {b: chr(b) for b in shown}
    names |= {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in names)}
    return {c: "".join(names[b] for b in chr(c).encode()) for c in range(256)}


_NAMES = _byte_names()


def _plain_bytes(text: str) -> bytes | None:
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    if len(data.translate(None, _ODD)) < len(data) or any(s in data for s in _ODD_SPACES):
        return None
    return data


def _is_plain(text: str) -> bool:
    return _plain_bytes(text) is not None


def _word_starts(data: np.ndarray) -> np.ndarray:
    """Where words of the ByteLevel step begin in plain texts, with a stop behind each text.

    A word is a contraction, or a run of one class with the space before it. Of other white space
    before a word the last character stands alone.
    """
    kind = _CLASSES[data]
    starts = np.append(True, kind[1:] != kind[:-1])
    space, word = data == ord(" "), (kind != _SPACE) & (kind != _END)
    starts |= space | (kind == _END)
    starts[1:] &= ~(space[:-1] & word[1:])
    starts[:-1] |= (kind[:-1] == _SPACE) & ~space[:-1] & word[1:]
    # a text that ends with white space and a space: one word
    starts[1:-1] &= ~(space[1:-1] & (kind[:-2] == _SPACE) & (kind[2:] == _END))
    marks = np.flatnonzero((data == ord("'")) & starts)
    after = np.append(data, np.zeros(2, np.uint8))
    one, two = after[marks + 1], after[marks + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))
    long |= (one == ord("l")) & (two == ord("l"))
    starts[marks[short | long] + 1] = False
    starts[marks[short] + 2] = True
    starts[marks[long] + 3] = True
    return starts


class Encoder:
    """Ids of texts as packed little-endian uint32, by the tokenizers library.

    The words of many plain texts are found together, and each different one is looked up once.
    New ones go to the library's model, named by bytes as its ByteLevel step does. The ids of words
    are remembered in two halves: when the newer is full it becomes the older, and words that are
    met again move on. Long words are not remembered.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same model for words that are cut and named, one a line
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        # bytes of a token: its name has a character for each byte
        names = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(names.values()) + 1, np.int64)
        self.sizes[list(names.values())] = list(map(len, names))
        self.pieces: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> list[bytes]:
        done = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in done)]

    def _learned(self, words: list[bytes]) -> list[bytes]:
        """Ids of new words. Many are encoded as one text, whose ids are cut where words end."""
        if not words:
            return []
        named = [w.decode("latin-1").translate(_NAMES) for w in words]
        packed = b"".join(self._ids(self.model, [
            "\n".join(named[at:at + TOGETHER]) for at in range(0, len(named), TOGETHER)]))
        reached = np.cumsum(self.sizes[np.frombuffer(packed, "<u4")])
        ends = np.cumsum(np.fromiter(map(len, named), np.int64, len(named)))
        cuts = (4 * np.searchsorted(reached, ends) + 4).tolist()
        return list(map(packed.__getitem__, map(slice, [0, *cuts], cuts)))

    def _remember(self, fresh: dict[bytes, bytes]) -> None:
        half = REMEMBERED // 2
        if len(self.pieces) + len(fresh) > half:
            self.older, self.pieces = self.pieces, {}
        self.pieces.update(islice(fresh.items(), half))

    def _of_words(self, words: list[bytes]) -> list[bytes]:
        found = list(map(self.pieces.get, words))
        gaps = [i for i, ids in enumerate(found) if ids is None]
        kept = list(map(self.older.get, map(words.__getitem__, gaps)))
        new = [i for i, ids in zip(gaps, kept) if ids is None]
        for i, ids in zip(gaps, kept):
            found[i] = ids
        for i, ids in zip(new, self._learned([words[i] for i in new])):
            found[i] = ids
        self._remember({words[i]: found[i] for i in gaps if len(words[i]) <= LONG})
        return found

    def _of_plain(self, texts: list[bytes]) -> list[bytes]:
        data = np.frombuffer(_STOP.join([*texts, b""]), np.uint8)
        starts = np.flatnonzero(_word_starts(data))
        ends = np.append(starts, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(
            pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)]
        ).dictionary_encode()
        which, different = words.indices.to_numpy(), words.dictionary.to_pylist()
        stop = different.index(_STOP)
        different[stop] = b" "
        coded = self._of_words(different)
        coded[stop] = b""
        # the ids of each word of the texts, from those of the different words
        lengths = np.fromiter(map(len, coded), np.int32, len(coded)) // 4
        first = np.cumsum(lengths, dtype=np.int32) - lengths
        taken = lengths[which]
        reached = np.cumsum(taken, dtype=np.int32)
        at = np.repeat(first[which] - (reached - taken), taken)
        at += np.arange(len(at), dtype=np.int32)
        ids = np.frombuffer(b"".join(coded), "<u4")[at].tobytes()
        cuts = (4 * reached[which == stop].astype(np.int64)).tolist()
        return list(map(ids.__getitem__, map(slice, [0, *cuts], cuts)))

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = list(map(_plain_bytes, texts))
        whole = iter(self._ids(self.tokenizer, [t for t, p in zip(texts, plain) if p is None]))
        cut = [p for p in plain if p is not None]
        cut = iter(self._of_plain(cut) if cut else cut)
        return [next(whole if p is None else cut) for p in plain]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID,
                      segment_ids: int = SEGMENT_IDS) -> None:
    """Write the token table of ``docs`` to ``path``."""

    def encode(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        ids, lengths, held, total = [], [], [], 0

        def segment():
            codes = pack(np.frombuffer(b"".join(held), "<u4"))
            # nulls come first, so the first and last places are the bounds
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in (
                    (ids[0], pa.int64()), (ids[-1], pa.int64()), (part, pa.int32()),
                    (seq, pa.int32()), (total, pa.int64()), (ids, pa.list_(pa.int64())),
                    (lengths, pa.list_(pa.int64())), (codes, pa.binary()))],
                ["first_id", "last_id", "part", "seq", "n_ids", "doc_ids", "lengths", "codes"])

        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
            steps = np.cumsum(sizes, dtype=np.int64) // BATCH_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(steps)) + 1).tolist(), batch.num_rows]
            for at, to in zip(cuts, cuts[1:]):
                piece = batch.slice(at, to - at)
                texts = [t or "" for t in piece.column(1).to_pylist()]
                for doc_id, coded in zip(piece.column(0).to_pylist(),
                                         encoder(tokenizer).encode(texts)):
                    ids.append(doc_id)
                    lengths.append(len(coded) // 4 + 1)
                    held += [coded, end]
                    total += lengths[-1]
                    if total >= segment_ids:
                        yield segment()
                        ids, lengths, held, total, seq = [], [], [], 0, seq + 1
        if ids:
            yield segment()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows.repartitionByRange(number_of_tasks(docs.sparkSession), "doc_id").sortWithinPartitions(
        "doc_id").mapInArrow(encode, SEGMENT).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The segments, and ``start``, the number of ids before each, by its p and s."""
    table = spark.read.parquet(path)
    order = Window.orderBy(F.asc_nulls_first("first_id"), F.asc_nulls_first("last_id"),
                           "part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = table.select("first_id", "last_id", "part", "seq", "n_ids").select(
        F.col("part").alias("p"), F.col("seq").alias("s"),
        F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("start"))
    return table, starts


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""

    def digest(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["codes"]).astype("<u4")
                ends = np.cumsum(row["lengths"])
                begins = ends - row["lengths"]
                n = len(ends)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["part"]] * n, pa.int32()),
                    pa.array([row["seq"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                    pa.array(begins, pa.int64()), pa.array(row["lengths"], pa.int64()),
                    pa.array([zlib.crc32(ids[a:b]) for a, b in zip(begins, ends)], pa.int64()),
                ], ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])

    table, starts = read_token_files(spark, path)
    per_doc = table.select("part", "seq", "doc_ids", "lengths", "codes").mapInArrow(
        digest, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return per_doc.join(starts, (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s"))
                        ).select("doc_id", (F.col("start") + F.col("at")).alias("start"),
                                 "n_tokens", "ids_crc32")
