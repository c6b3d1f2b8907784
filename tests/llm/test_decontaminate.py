"""Decontamination against brute force and planted items."""

from flightops.llm import decontaminate
from tests.llm.edges import no_docs, odd_docs

ITEM = ("A farmer named Alice sells 12 apples and 30 pears at the market for 5 euros each day. "
        "How many coins does Alice bring home after 12 days of hard work?")
CHANGED = ITEM.replace("Alice", "Robert").replace("12", "47").replace("5 euros", "9 dollars")
MIXED = ITEM.replace("named Alice", "named Robert").replace("12 days", "13 days").replace(
    "How many coins does Alice", "How many coins does Zelda")
PROSE = " ".join(f"filler{i} sentence goes on" for i in range(60))


def leaks(spark, docs, items, **options):
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(
        docs, items, **options).collect()}


def test_exact_and_reparameterised(spark):
    docs = [(1, f"{PROSE} {ITEM} {PROSE}"), (2, f"{PROSE}. {CHANGED} {PROSE}"), (3, PROSE),
            (4, ITEM.lower().upper()), (5, None), (6, ""), (7, f"{ITEM} {ITEM}"),
            (8, " ".join(reversed(ITEM.split())))]
    for sent in (decontaminate.SENT_HASHES, 0):
        found = leaks(spark, docs, [(1, ITEM), (2, None), (3, "other words here now")],
                      sent_hashes=sent)
        assert set(found) == {(1, 1), (2, 1), (4, 1), (7, 1)}
        assert found[2, 1]["reparameterised"] and not found[1, 1]["reparameterised"]
        assert found[1, 1]["coverage"] == 1.0


def test_inconsistent_slots_do_not_count(spark):
    assert leaks(spark, [(1, f"{PROSE} {MIXED}")], [(1, ITEM)]) == {}


def test_one_altered_value_leaves_the_spelled_windows(spark):
    """A copy with one wrong number: its template windows conflict, its words do not."""
    long = ITEM + " " + " ".join(f"then the {w} goes to town" for w in (
        "baker", "miller", "smith", "tailor", "weaver", "potter"))
    typo = long.replace("after 12 days", "after 13 days")
    swapped = long.replace("Alice", "Robert").replace("after 12 days", "after 13 days")
    found = leaks(spark, [(1, f"{PROSE} {typo}"), (2, f"{PROSE}. {swapped}")], [(1, long)])
    assert set(found) == {(1, 1), (2, 1)}
    assert not found[1, 1]["reparameterised"] and found[2, 1]["reparameterised"]
    n = len(long.split()) - 7
    assert found[1, 1]["n_matched"] == n - 8


def test_a_long_piece_of_a_longer_item(spark):
    words = [f"word{i}" for i in range(300)]
    piece = lambda n: f"{PROSE} " + " ".join(words[100:100 + n]) + f" {PROSE}"
    n = decontaminate.MIN_RUN
    found = leaks(spark, [(1, piece(100)), (2, piece(n)), (3, piece(n - 1))],
                  [(1, " ".join(words))])
    assert set(found) == {(1, 1), (2, 1)}
    assert found[1, 1]["run_words"] == 100 and found[1, 1]["coverage"] < 0.5


def test_items_of_many_slots(spark):
    maths = ("if you add 3 apples to the basket then 4 5 6 7 8 9 10 11 12 13 14 15 and 16 17 18 "
             "19 20 remain")
    other = ("if you add 21 apples to the basket then 22 23 24 25 26 27 28 29 30 31 32 33 and 34 "
             "35 36 37 38 remain")
    short, exchanged = "what is 12 times 30 here", "what is 47 times 95 here"
    found = leaks(spark, [(1, f"{PROSE} {other}"), (2, f"{PROSE} {exchanged} {PROSE}"),
                          (3, f"{PROSE} 22 23 24 25 26 27 28 29 30 31 32 33 {PROSE}")],
                  [(1, maths), (2, short)])
    assert set(found) == {(1, 1), (2, 2)}
    assert all(r["reparameterised"] for r in found.values())


def test_tables_against_text_search(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()}
    rows, queries = docs.collect(), items.collect()
    exact = {(d["doc_id"], i["item_id"]) for d in rows for i in queries
             if i["text"] in d["text"]}
    apart = lambda t: set(map(tuple, zip(*[iter(decontaminate.bare(w) for w in t.split())] * 6)))
    assert exact <= found
    texts, wanted = {d["doc_id"]: d["text"] for d in rows}, {
        i["item_id"]: i["text"] for i in queries}
    for d, i in found - exact:  # the same words in other case or spacing
        bare = " ".join(decontaminate.bare(w) for w in texts[d].split())
        assert any(" ".join(p) in bare for p in apart(wanted[i]))


def test_short_items_and_odd_cases(spark):
    found = leaks(spark, [(1, "x y three word item z"), (2, "three word")],
                  [(1, "three word item"), (2, "..."), (3, "three word item")])
    assert set(found) == {(1, 1), (1, 3)}
    items = spark.createDataFrame([(1, "no such text in the table at all here")],
                                  "item_id long, text string")
    kept = decontaminate.without_leaks(odd_docs(spark), items)
    assert kept.columns == odd_docs(spark).columns
    assert kept.count() == odd_docs(spark).count()
    assert decontaminate.without_leaks(no_docs(spark), items).count() == 0
    assert decontaminate.without_leaks(odd_docs(spark), items.where("1 = 0")).count() \
        == odd_docs(spark).count()
    prose = spark.createDataFrame([(5, odd_docs(spark).where("doc_id = 1").first()["text"])],
                                  "item_id long, text string")
    left = decontaminate.without_leaks(odd_docs(spark), prose)
    ids = {r["doc_id"] for r in left.collect()}
    assert not ids & {1, 2, 3} and left.where("doc_id is null").count() == 1
