"""Secret scan against brute force."""

import hashlib
import re
from collections import defaultdict

from flightops.llm import secrets
from flightops.llm.queries import op3_secret_scan
from tests.llm.edges import got, key, no_docs, odd_docs, odd_rows

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)


def base(text):
    text, out = text or "", []
    for m in ASSIGN.finditer(text):
        if len(m[1]) >= 12:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}", m[1]))
    for rank, kind, pattern, least in ((1, "access", r"AKIA[A-Z0-9]+", 18),
                                       (2, "hex", r"[0-9a-f]+", 16)):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}", m[0])
                for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(out)


TEXTS = [
    'Password = "abcdefghijkl" and SECRET:token=abcdefghijklmnop',
    "secret = token : abcdefghijklmnop",  # the first match is too short, and ends the second
    "tokentoken=abcdefghijkl api_key='ABCDEFGHIJKLM' apikey: 0123456789abcdef0123",
    "é😀 AKIAAKIA AKIAABCDEFGHIJ1234 x0123456789abcdefg password=short",
    "AKIA1234567890123 0123456789abcde", "", None, "passwd:" + "a" * 5000,
    "deadbeefdeadbeefdeadbeef" * 3 + "\npassword\n=abcdefghijklm",
]


def docs_of(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or {}).get(i, f"s{i}")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_base_spans(spark):
    found = secrets.secret_scan(docs_of(spark, TEXTS)).select(
        "doc_id", secrets.listed(secrets.F.col("base")).alias("base")).collect()
    for r in found:
        assert r["base"] == ",".join(s[2] for s in base(TEXTS[r["doc_id"]]))


def test_tables(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for d, t in docs:
        spans = base(t)
        kinds = [s[1] for s in spans]
        want.append((d, kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(
            ",".join(s[2] for s in spans).encode()).hexdigest()))
    assert got(op3_secret_scan(spark, folder), "doc_id", "n_assign", "n_access", "n_hex",
               "base_sha256") == sorted(want)


def test_ownership(spark):
    common, own = "Qwrtyzgh12345678qwrtyzghIJKL", "Zwrtyzgh12345678qwrtyzghIJKL"
    texts = [f"example {common} here"] * 4 + [f"my {own} key", "nothing"]
    found = {r["doc_id"]: r for r in secrets.secret_scan(docs_of(spark, texts)).select(
        "doc_id", "n_live", "n_example", secrets.listed(secrets.F.col("spans")).alias("s")
    ).collect()}
    assert (found[0]["n_live"], found[0]["n_example"], found[0]["s"]) == (0, 1, "")
    assert (found[4]["n_live"], found[4]["n_example"], found[4]["s"]) == (1, 0, "token:3:31")
    one_owner = docs_of(spark, texts, dict.fromkeys(range(6), "same"))
    assert {r["n_live"] for r in secrets.secret_scan(one_owner).collect()} == {0, 1}
    assert secrets.secret_scan(one_owner).where("n_example > 0").count() == 0


def test_ownership_counts(spark):
    rows = [("h", "o1", "r1"), ("h", "o1", "r2"), ("h", "o2", "r3"), ("h", "o1", "r1"),
            ("g", "o1", "r1")]
    counted = defaultdict(tuple, {r["value_hash"]: (r["n_owners"], r["n_repositories"])
                                  for r in secrets.ownership(spark.createDataFrame(
                                      rows, "value_hash string, owner string, repository string"
                                  )).collect()})
    assert counted == {"h": (2, 3), "g": (1, 1)}


def test_odd_cases(spark):
    found = secrets.secret_scan(odd_docs(spark)).select(
        "doc_id", secrets.listed(secrets.F.col("base")).alias("base"))
    want = [(d, ",".join(s[2] for s in base(t))) for d, t, _, _ in odd_rows()]
    assert got(found, "doc_id", "base") == sorted(want, key=key)
    assert secrets.secret_scan(no_docs(spark)).count() == 0
