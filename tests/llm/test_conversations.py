"""Repair of conversations against a plain search from the end."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import pytest

from flightops.llm import conversations as C
from flightops.llm.queries import op12_repair_conversations
from tests.llm.edges import got, key

COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
           "repaired_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\v\f\r"


def damage(rows):
    for conv, turn, role, text in rows:
        said = ":".join(" " if v is None else str(v) for v in (conv, turn))
        kind = zlib.crc32(said.encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        for _ in range((1, 0, 2)[(kind == 0) + 2 * (kind == 3)]):
            yield conv, turn, role, text


def cheapest(rows, faults):
    """(cost, audit, turns): roles are taken one by one, from each row to the end."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    @cache
    def best(i, last, inserts):
        found = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        if inserts < 3:
            for r in after[last]:
                if r in names:
                    cost, audit, turns = best(i, r, inserts + 1)
                    found.append((cost + 3, "I" + audit, (f"{names[r]}:", *turns)))
        if i < len(rows):
            (role, text), fault = rows[i], faults[i]
            cost, audit, turns = best(i + 1, last, 0)
            found.append((cost + 4, "D" + audit, turns))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] and role[0] in after[last]:
                    cost, audit, turns = best(i + 1, role[0], 0)
                    found.append((cost + more, "K" + audit, (f"{role}:{text}", *turns)))
                for r in after[last]:
                    if r in names:
                        cost, audit, turns = best(i + 1, r, 0)
                        found.append((cost + more + 3, "R" + audit, (f"{names[r]}:{text}", *turns)))
        return min(found, default=(10**9, "", ()))

    return best(0, "", 0)


def brute(rows):
    convs = defaultdict(list)
    for conv, *_ in rows:
        convs[conv] = []
    for conv, turn, role, text in damage(rows):
        convs[conv].append((turn, role, text))
    out = []
    for conv, said in convs.items():
        said.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(
            f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).hexdigest()))
        faults, seen = [], set()
        for _, *pair in said:
            text = pair[1].rstrip(SPACE)
            faults.append("blank" if not text else "duplicate" if tuple(pair) in seen
                          else "truncated" if text[-1] not in ".!?" else None)
            seen.add(tuple(pair))
        turns = {t for t, _, _ in said if t is not None}
        initials = [r[:1] for _, r, _ in said]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, repaired = cheapest([(r, t) for _, r, t in said], faults)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0,
                    *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost,
                    audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return sorted(out, key=key)


def query(spark, rows, path):
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", conv string, row int").write.parquet(
        f"{path}/conversations.parquet")
    return got(op12_repair_conversations(spark, str(path)), *COLUMNS)


def test_tables(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    assert got(op12_repair_conversations(spark, folder), *COLUMNS) == brute(rows)


def some_rows(seed, convs, most):
    r, rows = random.Random(seed), []
    for conv in [None, *range(convs)]:
        for n in range(r.randint(1, most)):
            turn = None if r.random() < 0.1 else n + r.choice((0, 0, 0, 3))
            role = r.choice(("system", "user", "assistant", "user", "assistant", "tool", None, ""))
            text = r.choice(("Yes.", "No", " \n", "", None, f"Well {n}!", f"é {n} ", f"Q{n}? \r\n",
                             "y" * 3000 + "."))
            rows.append((conv, turn, role, text))
            if r.random() < 0.1:
                rows.append(rows[-1])
    return rows


def test_odd_cases(spark, tmp_path):
    rows = some_rows(1, 60, 12)
    assert query(spark, rows, tmp_path) == brute(rows)


def test_runs_of_a_long_conversation(spark, tmp_path, monkeypatch):
    """A third of all rows in one conversation, cut into runs of 4 rows that meet in pairs."""
    monkeypatch.setattr(C, "RUN_BITS", 2)
    monkeypatch.setattr(C, "FAN_BITS", 1)
    rows = some_rows(2, 6, 10) + [(99, *r[1:]) for r in some_rows(3, 2, 30)]
    assert query(spark, rows, tmp_path) == brute(rows)


def test_no_rows(spark, tmp_path):
    assert query(spark, [], tmp_path) == []


@pytest.mark.parametrize("seed", range(3))
def test_edits_of_a_run(seed):
    """All short codes at random, with each state and with the ends of a conversation."""
    r = random.Random(seed)
    for _ in range(300):
        codes = "".join(r.choice("suaoSUAOx") for _ in range(r.randint(1, 9)))
        rows = [({"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}[c.lower()], "")
                for c in codes]
        faults = ["blank" if c == "x" else "truncated" if c.isupper() else None for c in codes]
        audit, left, cost = C.least_edits(codes, C.NOTHING, C.LAST)
        cost, audit = cost + C.LAST[left], audit + "I" * (C.LAST[left] // C.INSERT)
        assert (cost, audit) == cheapest(rows, faults)[:2]
