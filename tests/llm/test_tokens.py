"""Token counts and token files against the tokenizer libraries."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from flightops.llm import token_files
from flightops.llm.common import fresh_folder
from flightops.llm.token_counts import compiled, token_counts
from tests.llm.edges import got, key, no_docs, odd_docs, odd_rows

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def byte_level():
    return Tokenizer.from_file(BYTES)


@pytest.mark.parametrize("chunk", [1 << 16, 7, 3])
def test_counts_of_random_texts(pieces, chunk):
    r = random.Random(chunk)
    parts = "aabcdeét▁  \n\t1<s>Ⅳ世😀 the of ing"
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(4000)]
    assert compiled(PIECES).count_texts(texts, chunk) == list(map(len, pieces.encode(texts)))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30), st.sampled_from([2, 5, 1 << 16]))
def test_counts_of_any_text(pieces, text, chunk):
    text = text.replace("\0", "")
    assert compiled(PIECES).count_texts([text], chunk) == [len(pieces.encode(text))]


def test_counts_of_tables(spark, pieces):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    for r in token_counts(docs, PIECES).collect():
        want = len(pieces.encode(texts[r["doc_id"]]))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (
            want, len(texts[r["doc_id"]].encode()), want > 4096)
    want = [(d, len((t or "").encode()), len(pieces.encode(t or ""))) for d, t, _, _ in odd_rows()]
    assert got(token_counts(odd_docs(spark), PIECES), "doc_id", "n_bytes",
               "n_tokens") == sorted(want, key=key)
    assert token_counts(no_docs(spark), PIECES).count() == 0


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000])
def test_codes_round_trip(n):
    r = np.random.default_rng(n)
    ids = r.choice([0, 5, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1], n).astype(np.uint32)
    codes = token_files.pack(ids)
    assert (token_files.unpack(codes) == ids).all()
    for i in r.integers(0, n, 40) if n else []:
        assert token_files.id_at(codes, int(i)) == ids[i]


def test_encoder_equals_library(byte_level):
    r = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "\t", "é", "²", "世", "'s", "1", "12", "!!", "\xa0",
             "<|endoftext|>", "\x1c", "ß", "Ω", " "]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(20000)]
    found = token_files.Encoder(BYTES).encode(texts)
    want = byte_level.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [e.ids for e in want]


def test_encoder_keeps_pieces(byte_level):
    """Pieces that are met again, in other places, and long ones, which are not remembered."""
    r = random.Random(2)
    parts = ["a", "the", "é", "ß", "'s", "'", "1", "12", "!!", ".", "\n", "\n\n", "\t", "_", "x" * 70]
    pieces = ["".join(r.choice(parts) for _ in range(r.randint(1, 5))) for _ in range(3000)]
    pieces = [p for p in pieces if not p[0].isspace()]
    texts = [" ".join(r.choices(pieces, k=r.randint(0, 30))) + r.choice(["", " ", "\n"])
             for _ in range(4000)] + [" ", " a", "a "]
    encoder = token_files.Encoder(BYTES)
    found = [ids for at in range(0, len(texts), 100) for ids in encoder.encode(texts[at:at + 100])]
    want = byte_level.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [e.ids for e in want]
    assert sum(map(token_files._is_plain, texts)) > 3900
    assert max(map(len, encoder.pieces)) <= token_files.LONG


def test_encoder_is_bounded_and_keeps_what_is_met_again(byte_level, monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 200)
    encoder = token_files.Encoder(BYTES)
    learned, learn = [], encoder._learned
    monkeypatch.setattr(encoder, "_learned", lambda words: learned.extend(words) or learn(words))
    for n in range(40):
        texts = [f"often met x{chr(97 + n % 26)}{chr(97 + n // 26)}{chr(97 + i)}" for i in range(26)]
        found = encoder.encode(texts)
        want = byte_level.encode_batch(texts, add_special_tokens=False)
        assert [np.frombuffer(f, "<u4").tolist() for f in found] == [e.ids for e in want]
        assert len(encoder.pieces) <= 100 and len(encoder.older) <= 100
    assert learned.count(b"often") == 1
    encoder.encode([" ".join(f"y{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(600))])
    assert len(encoder.pieces) <= 100 and len(encoder.older) <= 100


def test_words_of_plain_texts(byte_level):
    """Contractions, white space at ends, stops between texts: all short sequences."""
    parts = ["a", "'", "s", "re", "ll", " ", "\n", "\t", "7", "!", "é", "×"]
    texts = ["".join(t) for n in range(5) for t in itertools.product(parts, repeat=n)]
    found = token_files.Encoder(BYTES).encode(texts)
    want = byte_level.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [e.ids for e in want]


def expected_digests(rows, byte_level):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, start = [], 0
    for d, t in rows:
        ids = [*byte_level.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("segment", [1 << 20, 500])
def test_files(spark, byte_level, segment):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    path = fresh_folder(spark, "token-test")
    token_files.write_token_files(docs.repartition(3), path, BYTES, segment_ids=segment)
    columns = ("doc_id", "start", "n_tokens", "ids_crc32")
    want = expected_digests(rows, byte_level)
    assert sorted(got(token_files.token_digests(spark, path), *columns)) == sorted(want)
    part = spark.read.parquet(path).orderBy("first_id").first()
    ids = token_files.unpack(part["codes"])
    assert [token_files.id_at(part["codes"], i) for i in range(0, 400, 7)] == ids[
        :400:7].tolist()


def test_files_of_odd_cases(spark, byte_level):
    rows = [(d, t) for d, t, _, _ in odd_rows()]
    path = fresh_folder(spark, "token-test")
    token_files.write_token_files(odd_docs(spark), path, BYTES)
    columns = ("doc_id", "start", "n_tokens", "ids_crc32")
    found = got(token_files.token_digests(spark, path), *columns)
    want = expected_digests(rows, byte_level)
    # the order of rows with equal ids is free
    drop = lambda rows: sorted(((d, n, c) for d, _, n, c in rows), key=key)
    assert drop(found) == drop(want)
    ends = sorted((s, s + n) for _, s, n, _ in found)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    path = fresh_folder(spark, "token-test")
    token_files.write_token_files(no_docs(spark), path, BYTES)
    assert token_files.token_digests(spark, path).count() == 0
