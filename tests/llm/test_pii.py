"""Personal data against plain patterns and counts over all documents."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from flightops.llm import pii
from flightops.llm.queries import op13_personal_data
from tests.llm.edges import got, key, no_docs, odd_docs

COLUMNS = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
            r"\+[0-9][\x20().0-9-]+[0-9]"]


def valid(rank, found):
    digits = re.sub("[^0-9]", "", found)
    if rank == 1:
        return all(int(p) <= 255 for p in found.split("."))
    if rank == 2:
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(digits[::-1])]
        return 12 <= len(digits) <= 19 and sum(n // 10 + n % 10 for n in doubled) % 10 == 0
    return rank == 0 or 9 <= len(digits) <= 15


def base(text):
    return sorted((m.start(), rank, m.end()) for rank, p in enumerate(PATTERNS)
                  for m in re.finditer(p, text) if valid(rank, m[0]))


def value(rank, found):
    return rank, found.lower() if rank == 0 else found if rank == 1 else re.sub("[^0-9]", "", found)


def terms(text):
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        a, b = m.span()
        while a < b and not text[a].isalnum():
            a += 1
        while a < b and not text[b - 1].isalnum():
            b -= 1
        word = text[a:b].lower()
        yield m.start(), m.end(), a, b, word if b - a > 1 and any(map(str.isalpha, word)) else None


def brute(rows):
    """Rows (doc_id, text) with added spans by counting everything in one place."""
    total, n_e, n_t, both, texts = len(rows), Counter(), Counter(), Counter(), defaultdict(set)
    near = []
    for _, text in rows:
        text = text or ""
        spans, words = base(text), list(terms(text))
        n_t.update({w[4] for w in words if w[4]})
        free = [w for w in words if not any(a < w[1] and w[0] < b for a, _, b in spans)]
        here = []
        for a, rank, b in spans:
            e = value(rank, text[a:b])
            before = [w for w in free if w[0] < a][-5:]
            here += [(e, w) for w in before + [w for w in free if w[0] >= b][:5] if w[4]]
        n_e.update({value(r, text[a:b]) for a, r, b in spans})
        pairs = {(e, w[4]) for e, w in here}
        both.update(pairs)
        for p in pairs:
            texts[p].add(text)
        near.append(here)
    out = []
    for (doc, text), here in zip(rows, near):
        spans, added = base(text or ""), {}
        for e, w in here:
            information = math.log(total / n_e[e])
            if len(texts[e, w[4]]) >= 3 and information >= 3:
                share = math.log(total * both[e, w[4]] / (n_t[w[4]] * n_e[e])) / information
                if share >= 0.5:
                    rank = 4 if share >= 0.8 else 5
                    added[w[2], w[3]] = min(rank, added.get((w[2], w[3]), 9))
        every = sorted(spans + [(a, r, b) for (a, b), r in added.items()])
        say = lambda them: ",".join(f"{pii.KINDS[r]}:{a}:{b}" for a, r, b in them)
        kinds = [r for _, r, _ in spans]
        out.append((doc, *(kinds.count(i) for i in range(4)),
                    hashlib.sha256(say(spans).encode()).hexdigest(), say(every)))
    return sorted(out, key=key)


def test_tables(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select(
        "doc_id", "text").collect()]
    want = brute(rows)
    assert got(op13_personal_data(spark, folder), *COLUMNS) == want
    assert sum(r[1] for r in want) and sum(r[3] for r in want)


PIECES = ["a.b@c.de", "@", "x@y", "u@v.w.", "_q@", "1.2.3.4", "256.1.1.1", "01.002.3.255.7", "1.2.3",
          "4111 1111 1111 1111", "4111-1111-1111-1112", "00000000000000000000", "+1 (202) 555-0100",
          "+49.", "+123456789012345678", "9", "-", " ", ".", "a@b@c.de", "é", "%+", "(", "12", "\n",
          "word", "1" * 30, "+1", "x@y.z@w.v"]


@pytest.mark.parametrize("seed", range(4))
def test_base_spans(seed):
    r = random.Random(seed)
    for _ in range(2000):
        text = "".join(r.choice(PIECES) for _ in range(r.randint(0, 12)))
        assert [s[:3] for s in pii.base_spans(text)] == base(text), text


def test_long_texts():
    """Runs that fail are not searched again from each of their places."""
    for piece in ("a", "1", "1.", "1-", "+1", "a@", "+", "a.", "@a"):
        assert pii.base_spans(piece * 300_000) is not None


def leaking(n=120):
    """A name that only stands by one address, a common word beside it, and other texts."""
    rows = [(i, f"report {i} by Quixwald, mail q@example.org today and report w{i}") for i in range(4)]
    rows += [(100 + i, f"today we report w{i} by mail and x{i % 7}") for i in range(n)]
    rows += [(500, "a copy of Zemblan here: z@example.org"), (501, "a copy of Zemblan here: z@example.org"),
             (502, "a copy of Zemblan here: z@example.org")]  # one text
    return rows + [(None, None), (7, ""), (8, "Quixwald alone")]


def test_terms_that_reveal(spark):
    docs = spark.createDataFrame(leaking(), "doc_id long, text string")
    found = pii.personal_data(docs)
    rows = leaking()
    assert sorted((r["doc_id"] or -1, r["s"]) for r in found.select(
        "doc_id", pii.listed(found["spans"]).alias("s")).collect()) == sorted(
        (r[0] or -1, r[6]) for r in brute(rows))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert clean[0] == "report 0 by , mail [EMAIL] today and report w0"
    assert clean[500] == "a copy of Zemblan here: [EMAIL]"
    assert clean[8] == "Quixwald alone"
    assert clean[None] is None and clean[7] == ""


def test_odd_cases(spark):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs(spark).collect()]
    found = pii.personal_data(odd_docs(spark))
    assert sorted(((r["doc_id"], r["s"]) for r in found.select(
        "doc_id", pii.listed(found["spans"]).alias("s")).collect()), key=key) == sorted(
        ((r[0], r[6]) for r in brute(rows)), key=key)
    after = pii.sanitised(odd_docs(spark))
    assert after.columns == odd_docs(spark).columns and after.count() == len(rows)
    assert pii.personal_data(no_docs(spark)).count() == 0 == pii.sanitised(no_docs(spark)).count()
