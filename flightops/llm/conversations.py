"""Repair of conversations: the cheapest edits that give turns of user and assistant.

Each row of a conversation is kept, gets the role user or assistant, or is deleted, and empty
turns may be inserted, so that the initials of the roles read ``(s?(ua)+)?``. Blank rows and
rows seen earlier must go; a row without an end mark that stays costs more. Of the cheapest
edits those with the ASCII-least audit (their initials in order) are taken.

A prefix of the roles is in one of four states: nothing yet, after the system turn, after a
user turn, after an assistant turn. Rows stand in the order of a range shuffle and are cut
into runs of at most ``RUN`` rows, so a conversation that holds a third of the table is many
runs. A run is first a matrix of 4 x 4 costs (least-plus). Scans over the runs of a
conversation, in rounds of ``FAN`` nodes, give each run the cost vector behind it, and then the
state in which it is entered. Within a run, Hirschberg's method finds the edits: the forward
cost vector of the first half and the backward one of the second half meet mid-run, the
audit-least of the optimal crossings is chosen, and both halves recurse. Inserts belong to the
row behind them, so the audits of a half that lead to one place are never prefixes of each
other and the least of the whole is made of the least of the parts.

Texts are not needed for the edits. They meet them again in a sorted stream per conversation,
whose SHA-256 is updated row by row; the digest of one conversation is sequential by nature,
and holds one batch in memory.

Defined results: null conv_id is a conversation of its own; null role and text are one space,
so a null text is blank and a null role fits no turn; null turns come first and are left out of
the gaps; rows of the same turn are ordered by the SHA-256 of role and text, so repeated rows
are neighbours; empty text is blank; very long texts are used whole; an empty table gives no
rows; other columns, of whatever name, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightops.llm.common import dealt_in_order, stored, without_gaps

RUN_BITS = 12  # a run has at most 2^12 rows
FAN_BITS = 10  # runs, or nodes of a round, that meet in one call

# fixed: what the edits cost, and the letters that end a text
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
END_MARKS = ".!?"
BLANK = r"^[ \t\n\x0B\f\r]*\z"
ENDS = r"[.!?][ \t\n\x0B\f\r]*\z"

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
FAR = 1 << 60

# the role and the state that a new user or assistant turn gives; only one fits each state
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_KEEPS = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER},
          "a": {USER: ASSISTANT}, "o": {}}


# -- edits of one run ------------------------------------------------------------

def _edits(code: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of one row."""
    yield "D", DELETE, state
    if code != "x":
        more = TRUNCATED * code.isupper()
        kept = _KEEPS[code.lower()].get(state)
        if kept is not None:
            yield "K", more, kept
        yield "R", REROLE + more, _NEXT[state]


def _row(code: str) -> tuple[tuple[tuple[int, str], ...], ...]:
    """[state before][state after]: least (cost, audit) of a row and the inserts before it."""
    table = []
    for start in STATES:
        least, state, inserts = [(FAR, "")] * 4, start, 0
        for _ in STATES:  # more inserts come to a state that was there before
            for letter, cost, after in _edits(code, state):
                least[after] = min(least[after], (INSERT * inserts + cost, "I" * inserts + letter))
            state, inserts = _NEXT[state], inserts + 1
        table.append(tuple(least))
    return tuple(table)


# s, u, a: the initial; o: any other; capitals: without an end mark; x: must go
_ROWS = {code: _row(code) for code in "suaoSUAOx"}
_STEPS = {code: tuple(tuple(cost for cost, _ in line) for line in table)
          for code, table in _ROWS.items()}

Vector = Sequence[int]


def forward(codes: str, lo: int, hi: int, vector: Vector) -> list[int]:
    """Costs of the four states after rows ``lo`` to ``hi``, from those before."""
    now = list(vector)
    for i in range(lo, hi):
        a, b, c, d = _STEPS[codes[i]]
        p, q, r, s = now
        now = [min(p + a[t], q + b[t], r + c[t], s + d[t]) for t in STATES]
    return now


def backward(codes: str, lo: int, hi: int, vector: Vector) -> list[int]:
    """Costs to go from the four states before rows ``lo`` to ``hi``, from those after."""
    p, q, r, s = vector
    for i in range(hi - 1, lo - 1, -1):
        p, q, r, s = (min(m[0] + p, m[1] + q, m[2] + r, m[3] + s) for m in _STEPS[codes[i]])
    return [p, q, r, s]


def _at(state: int) -> list[int]:
    return [0 if s == state else FAR for s in STATES]


def _crossing(codes: str, lo: int, hi: int, start: int, end: Vector, known: dict
              ) -> tuple[str, int, int]:
    """The audit-least of the cheapest edits from ``start`` to the cost vector ``end`` behind
    row ``hi``, the state in which they leave, and their own cost."""
    ahead = forward(codes, lo, hi, _at(start))
    cost = min(a + e for a, e in zip(ahead, end))
    return min((_least(codes, lo, hi, start, s, known), s, ahead[s])
               for s in STATES if ahead[s] + end[s] == cost)


def _least(codes: str, lo: int, hi: int, start: int, end: int, known: dict) -> str:
    """Audit-least of the cheapest edits of rows ``lo`` to ``hi`` between two states."""
    if hi - lo == 1:
        return _ROWS[codes[lo]][start][end][1]
    key = lo, hi, start, end
    if key not in known:
        mid = (lo + hi) // 2
        first, state, _ = _crossing(
            codes, lo, mid, start, backward(codes, mid, hi, _at(end)), known)
        known[key] = first + _least(codes, mid, hi, state, end, known)
    return known[key]


def least_edits(codes: str, start: int, end: Vector) -> tuple[str, int, int]:
    """Audit, last state and cost of the run ``codes``, entered in ``start``, left at costs ``end``."""
    return _crossing(codes, 0, len(codes), start, end, {})


def _finish(state: int) -> int:
    """Inserts that end a conversation in this state."""
    return (0, 2, 1, 0)[state]


LAST = tuple(INSERT * _finish(s) for s in STATES)


def run_matrix(codes: str) -> list[int]:
    return [c for s in STATES for c in forward(codes, 0, len(codes), _at(s))]


def _matrix_product(matrices: Iterable[Vector]) -> list[int]:
    rows = [_at(s) for s in STATES]
    for m in matrices:
        rows = [[min(FAR, *(line[k] + m[4 * k + t] for k in STATES)) for t in STATES]
                for line in rows]
    return [c for line in rows for c in line]


def _vectors_behind(matrices: Sequence[Vector], last: Vector) -> list[list[int]]:
    """The cost vector behind each matrix, from the one behind all."""
    out, now = [], [int(c) for c in last]
    for m in reversed(matrices):
        out.append(now)
        now = [min(FAR, *(int(m[4 * s + t]) + now[t] for t in STATES)) for s in STATES]
    return out[::-1]


def _composed(exits: Iterable[Vector]) -> list[int]:
    now = list(STATES)
    for e in exits:
        now = [int(e[s]) for s in now]
    return now


def _entries(exits: Sequence[Vector], first: Vector) -> list[list[int]]:
    """The state in which each run is entered, as a list of one."""
    out, now = [], int(first[0])
    for e in exits:
        out.append([now])
        now = int(e[now])
    return out


# -- scans over the runs of a conversation ------------------------------------------

def _scan(nodes: DataFrame, up: Callable, down: Callable, outer: Sequence[int]) -> DataFrame:
    """conv, run and ``given`` of each node: what ``down`` passes to it from the whole.

    ``up`` makes one value of the values of neighbouring nodes, ``down`` gives each of them its
    own from the one of their parent; ``outer`` is that of a whole conversation. A call sees at
    most 2^FAN_BITS nodes.
    """
    parent = F.shiftright("run", FAN_BITS)
    widest = nodes.groupBy("conv").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if widest <= 1:
        return nodes.select("conv", "run", F.array(*[F.lit(v).cast("long") for v in outer])
                            .alias("given"))
    families = nodes.groupBy("conv", parent.alias("parent")).agg(
        F.array_sort(F.collect_list(F.struct("run", "value"))).alias("nodes"))
    families = stored(families.select("conv", "parent", F.col("nodes.run").alias("runs"),
                                      F.col("nodes.value").alias("values")),
                      "conversation-families")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"conv": b["conv"], "run": b["parent"], "value": [
                up(values) for values in b["values"]]})

    parents = stored(families.mapInPandas(join, "conv string, run long, value array<long>"),
                     "conversation-parents")
    above = _scan(parents, up, down, outer)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(conv, run, given) for conv, runs, values, outside in zip(
                b["conv"], b["runs"], b["values"], b["given"])
                for run, given in zip(runs, down(values, outside))]
            yield pd.DataFrame(rows, columns=["conv", "run", "given"])

    return families.join(above.withColumnRenamed("run", "parent"), ["conv", "parent"]).mapInPandas(
        part, "conv string, run long, given array<long>")


# -- faults -------------------------------------------------------------------------

def _said(role: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)


def ordered(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, said and the place (``row``) of each row, stored."""
    space = F.lit(" ")
    plain = rows.select(
        conv_key().alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    said = plain.withColumn("said", _said(F.col("role"), F.col("text")))
    return without_gaps(dealt_in_order(said, ["conv", "turn", "said"], "conversation-rows"))


def conv_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-"))


def with_faults(rows: DataFrame) -> DataFrame:
    """conv, turn, row, initial, fault (blank, duplicate, truncated or null) and code."""
    initial = F.substring("role", 1, 1)
    looked = rows.select(
        "conv", "turn", "row", "said",
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
        F.col("text").rlike(BLANK).alias("blank"), (~F.col("text").rlike(ENDS)).alias("open"))
    repeated = looked.groupBy("conv", "said").agg(
        F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").select(
        F.col("conv").alias("of"), F.col("said").alias("same"), "first")
    joined = looked.join(
        repeated, (F.col("conv") == F.col("of")) & (F.col("said") == F.col("same")), "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("row") > F.col("first"), "duplicate").when(
        F.col("open"), "truncated")
    return joined.withColumn("fault", fault).select(
        "conv", "turn", "row", "initial", "fault",
        F.when(F.col("fault").isin("blank", "duplicate"), F.lit("x"))
        .when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
        .alias("code"))


def _runs(faults: DataFrame) -> DataFrame:
    """One row per run: its first row, the codes and the initials of its rows."""
    run = F.shiftright("row", RUN_BITS)
    members = F.array_sort(F.collect_list(F.struct("row", "code", "initial")))
    return faults.groupBy("conv", run.alias("run")).agg(
        F.min("row").alias("first"), members.alias("m")).select(
        "conv", "run", "first", F.array_join("m.code", "").alias("codes"),
        F.array_join("m.initial", "").alias("initials"))


def _unlike(initials: Column) -> Column:
    """Neighbouring initials that are none of su, ua and au."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(initials) - 1),
                        lambda i: F.substr(initials, i, F.lit(2)))
    wrong = F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au")))
    return F.when(F.length(initials) > 1, wrong).otherwise(0).cast("long")


def illegal_pairs(runs: DataFrame) -> DataFrame:
    """conv and the number of illegal neighbours, inside runs and from run to run."""
    before = F.lag(F.substr("initials", F.length("initials"), F.lit(1))).over(
        Window.partitionBy("conv").orderBy("run"))  # one row per run of 4,096 rows
    whole = F.concat(F.coalesce(before, F.lit("")), "initials")
    return runs.select("conv", _unlike(whole).alias("n")).groupBy("conv").agg(
        F.sum("n").alias("illegal"))


# -- repair -------------------------------------------------------------------------

def edits(runs: DataFrame) -> DataFrame:
    """conv, run, first, state, audit and cost of each run; ``left`` is the state behind it."""
    runs = stored(runs, "conversation-runs")

    def costs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"conv": b["conv"], "run": b["run"],
                                "value": [run_matrix(c) for c in b["codes"]]})

    matrices = stored(runs.select("conv", "run", "codes").mapInPandas(
        costs, "conv string, run long, value array<long>"), "conversation-costs")
    behind = _scan(matrices, _matrix_product, _vectors_behind, LAST)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [[least_edits(c, s, [int(v) for v in end]) for s in STATES]
                     for c, end in zip(b["codes"], b["given"])]
            yield pd.DataFrame({
                "conv": b["conv"], "run": b["run"], "first": b["first"], "codes": b["codes"],
                "value": [[left for _, left, _ in each] for each in found],
                "audits": [[audit for audit, _, _ in each] for each in found],
                "costs": [[cost for _, _, cost in each] for each in found]})

    chosen = stored(
        runs.select("conv", "run", "first", "codes").join(behind, ["conv", "run"]).mapInPandas(
            choose, "conv string, run long, first long, codes string, value array<long>, "
                    "audits array<string>, costs array<long>"), "conversation-choices")
    entered = _scan(chosen.select("conv", "run", "value"), _composed, _entries, [NOTHING])
    state = F.col("given")[0].cast("int")
    return chosen.join(entered, ["conv", "run"]).select(
        "conv", "run", "first", "codes", state.alias("state"),
        F.get("audits", state).alias("audit"), F.get("value", state).cast("int").alias("left"),
        F.get("costs", state).alias("cost"))


def row_edits(chosen: DataFrame) -> DataFrame:
    """conv, row, the turns inserted before a row, its letter and the role it gets if any."""
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for conv, first, codes, state, audit in zip(
                    b["conv"], b["first"], b["codes"], b["state"], b["audit"]):
                added, n = [], 0
                for letter in audit:
                    if letter == "I":
                        state = _NEXT[state]
                        added.append(_ROLE[state])
                        continue
                    role = None
                    if letter == "R":
                        state = _NEXT[state]
                        role = _ROLE[state]
                    elif letter == "K":
                        state = _KEEPS[codes[n].lower()][state]
                    rows.append((conv, first + n, added, letter, role))
                    added, n = [], n + 1
            yield pd.DataFrame(rows, columns=["conv", "row", "added", "letter", "new_role"])

    return chosen.select("conv", "first", "codes", "state", "audit").mapInPandas(
        split, "conv string, row long, added array<string>, letter string, new_role string")


def repaired_rows(rows: DataFrame, changes: DataFrame, ends: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: conv, row, place within it, role and text.

    ``changes`` come from ``row_edits``; ``ends`` has the turns that close a conversation.
    """
    joined = rows.select("conv", "row", "role", "text").join(changes, ["conv", "row"])
    own = F.when(F.col("letter") != "D", F.struct(
        F.coalesce("new_role", "role").alias("role"), F.col("text").alias("text")))
    new = F.transform("added", lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
    turns = F.filter(F.concat(new, F.array(own)), lambda t: t.isNotNull())
    inside = joined.select("conv", "row", F.posexplode(turns).alias("place", "said"))
    last = ends.select("conv", F.lit((1 << 63) - 1).alias("row"), F.posexplode(
        F.transform("added", lambda r: F.struct(r.alias("role"), F.lit("").alias("text"))))
        .alias("place", "said"))
    return inside.unionByName(last).select("conv", "row", "place", "said.role", "said.text")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the turns of each conversation; its rows come in order, in any batches."""
    conv, state, out = None, None, []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(out, pa.schema([("conv", pa.string()),
                                                          ("digest", pa.string())]))

    for b in batches:
        for c, role, text in zip(*(b.column(i).to_pylist() for i in range(3))):
            line = f"{role}:{text}".encode()
            if c != conv:
                if state:
                    out.append({"conv": conv, "digest": state.hexdigest()})
                conv, state = c, hashlib.sha256(line)
            else:
                state.update(b"\n" + line)
        yield batch()
        out = []
    if state:
        out = [{"conv": conv, "digest": state.hexdigest()}]
        yield batch()


def digests(turns: DataFrame) -> DataFrame:
    return turns.repartition("conv").sortWithinPartitions("conv", "row", "place").select(
        "conv", "role", "text").mapInArrow(_digests, "conv string, digest string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, turns): a row per conversation, and the turns of the repaired ones.

    The report has conv, gaps, blank, duplicate, truncated, illegal, cost and audit; turns are
    as in ``repaired_rows``. A conversation without rows has no row in either.
    """
    rows = ordered(rows)
    faults = stored(with_faults(rows), "conversation-faults")
    runs = stored(_runs(faults), "conversation-runs")
    chosen = stored(edits(runs), "conversation-edits")
    # the last run of a conversation says how it ends
    tails = chosen.groupBy("conv").agg(F.max_by("left", "run").alias("left"))
    closing = F.when(F.col("left") == SYSTEM, F.array(F.lit("user"), F.lit("assistant"))).when(
        F.col("left") == USER, F.array(F.lit("assistant"))).otherwise(
        F.array().cast("array<string>"))
    ends = stored(tails.select("conv", closing.alias("added")), "conversation-ends")
    totals = chosen.groupBy("conv").agg(
        F.sum("cost").alias("run_cost"),
        F.array_join(F.array_sort(F.collect_list(F.struct("run", "audit")))["audit"], "")
        .alias("run_audit")).join(ends, "conv").select(
        "conv", (F.col("run_cost") + F.size("added") * INSERT).cast("long").alias("cost"),
        F.concat("run_audit", F.repeat(F.lit("I"), F.size("added"))).alias("audit"))
    count = lambda fault: F.count_if(F.coalesce(F.col("fault") == fault, F.lit(False)))
    turns_seen = faults.groupBy("conv", "turn").agg(*[
        count(f).alias(f) for f in ("blank", "duplicate", "truncated")])
    counted = turns_seen.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
        *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")])
    report = counted.join(illegal_pairs(runs), "conv").join(totals, "conv")
    return report, repaired_rows(rows, row_edits(chosen), ends)


def repair_digests(rows: DataFrame, damaged: DataFrame) -> DataFrame:
    """Report and digest of each conversation of ``rows`` after the damage."""
    report, turns = repair(damaged)
    every = rows.select("conv_id", conv_key().alias("conv")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(report, "conv", "left").join(digests(turns), "conv", "left").select(
        "conv_id", *[zero(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("digest", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with faults put in, by a checksum of conversation and turn."""
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(key("conv_id"), F.lit(":"), key("turn")).cast("binary")) % 20
    hit = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                      F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(
        F.col("kind") == 2, F.translate("text", END_MARKS, "")).otherwise(F.col("text"))
    return hit.where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")
    ).drop("copy")
