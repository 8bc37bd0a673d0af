"""Conversation structure repair: the cheapest edits over a lattice, by bidirectional Dijkstra.

A node of the lattice is (rows taken, state of ``(s?(ua)+)?``); edges keep, rerole or delete the next row or insert a
row without text. A forward heap from the start and a reverse heap from the ends meet; they go on until no path as cheap
as the best crossing is left, and of all crossings of that cost the one with the least audit (forward part plus reverse
part) is taken. Labels are (cost, audit). Free edges only go to the next row, so nodes are settled by (cost, rows taken)
and a label is final then; audits that end at one node at one cost are never each other's beginnings, so the least
parts make the least whole.

Spark sorts the rows of each conversation into one task, which reads them as a stream: a conversation is cut after
``SEGMENT`` rows (or ``SEGMENT_BYTES``), the lattice of a segment is solved between every pair of states, and only the
best label per state is carried on, with its hash so far. So a conversation of any length takes the memory of a segment
and of its audit, which is one value of the result; its hash is one stream by definition. Repeated role and text are
found by grouped digests before, not by a memory of what a conversation held.

Defined cases: a null role or text is one blank, and so is a null key or turn where rows are drawn for damage; rows are
taken by turn, nulls first, then by role and text; a null conversation is one of its own; repeated rows are duplicates;
other first letters than s, u, a can only be reroled or deleted; texts of any length are read whole; conversations whose
rows are all dropped have zeros, an empty audit and the hash of the empty text; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costweave.llm.caching import held
from costweave.llm.common import SPACES, map_batches, table
from costweave.llm.registry import query
from costweave.session import spread

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
USER, ASSISTANT = "user", "assistant"
#: States: nothing yet, after s, after u, after a; what each role initial leads to; where a conversation may end.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
START, ENDS = 0, (0, 3)
LEGAL = ("su", "ua", "au")
#: What it costs at most to go on from the second state where the first one would: by inserts, or a deleted system row.
DETOUR = {(0, 3): 2, (0, 2): 7, (1, 3): 0, (1, 2): 5, (2, 3): 5, (3, 2): 5}
#: Rows (or bytes of text) of a conversation that are solved at a time.
SEGMENT = 64
SEGMENT_BYTES = 1 << 24
SOLUTIONS_KEPT = 20_000
#: Share of rows that are damaged in each way: the remainder of a checksum by this number.
DAMAGES = 20


# The lattice ----------------------------------------------------------------------------------------------------------


def needed(state: int) -> str:
    """Role initial of a reroled or inserted row."""
    return "a" if state == 2 else "u"


def row_edges(code: str) -> list[tuple[int, int, int, str]]:
    """(state, next state, cost, letter) of a row. Its code is its role initial (``-`` if another) and its fault."""
    initial, fault = code
    edges = [(state, state, DELETE, "D") for state in range(4)]
    if fault in "bd":
        return edges
    more = TRUNCATED if fault == "t" else 0
    for state, steps in enumerate(STEPS):
        if initial in steps:
            edges.append((state, steps[initial], KEEP + more, "K"))
        edges.append((state, steps[needed(state)], REROLE + more, "R"))
    return edges


CODES = [initial + fault for initial in "sua-" for fault in "bdt."]
INSERTS = [(state, STEPS[state][needed(state)], INSERT, "I") for state in range(4)]
AHEAD = {c: [[e[1:] for e in row_edges(c) if e[0] == s] for s in range(4)] for c in CODES}
BACK = {c: [[(e[0], *e[2:]) for e in row_edges(c) if e[1] == s] for s in range(4)] for c in CODES}
INSERT_AHEAD = [[e[1:] for e in INSERTS if e[0] == s] for s in range(4)]
INSERT_BACK = [[(e[0], *e[2:]) for e in INSERTS if e[1] == s] for s in range(4)]


@lru_cache(SOLUTIONS_KEPT)
def cheapest(codes: tuple[str, ...], start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest way over all rows from a state to one of the end states; null if none."""
    n = len(codes)
    ahead, back = {(0, start): (0, "")}, {(n, end): (0, "") for end in ends}
    labels, heaps = (ahead, back), ([(0, 0, start)], [(0, 0, end) for end in ends])
    settled: tuple[set, set] = (set(), set())
    best = 0 if n == 0 and start in ends else None
    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best):
        side = int(heaps[1][0][0] < heaps[0][0][0])
        cost, taken, state = heapq.heappop(heaps[side])
        i = n - taken if side else taken
        if (i, state) in settled[side]:
            continue
        settled[side].add((i, state))
        audit = labels[side][i, state][1]
        if side:
            edges = [(i, *e) for e in INSERT_BACK[state]]
            edges += [(i - 1, *e) for e in BACK[codes[i - 1]][state]] if i else []
        else:
            edges = [(i, *e) for e in INSERT_AHEAD[state]]
            edges += [(i + 1, *e) for e in AHEAD[codes[i]][state]] if i < n else []
        for at, other, more, letter in edges:
            label = (cost + more, letter + audit if side else audit + letter)
            node = (at, other)
            known = labels[side].get(node)
            if known is not None and known <= label:
                continue
            labels[side][node] = label
            if known is None or label[0] < known[0]:
                heapq.heappush(heaps[side], (label[0], n - at if side else at, other))
            if node in labels[1 - side]:
                met = label[0] + labels[1 - side][node][0]
                best = met if best is None else min(best, met)
    if best is None:
        return None
    crossings = (
        ahead[node][1] + back[node][1] for node in ahead if node in back and ahead[node][0] + back[node][0] == best
    )
    return best, min(crossings)


# A conversation as a stream -------------------------------------------------------------------------------------------


class Label:
    """The best way to a state so far: cost, audit since the part that all states share, hash of the repaired rows."""

    def __init__(self, cost: int, audit: str, sha):
        self.cost, self.audit, self.sha = cost, audit, sha


class Conversation:
    """Takes the rows of one conversation in order."""

    def __init__(self, key):
        self.key = key
        self.labels = {START: Label(0, "", hashlib.sha256())}
        self.shared: list[str] = []
        self.waiting: list[tuple[str, str, str]] = []  # code, role, text
        self.bytes = 0
        self.faults = dict.fromkeys("bdt.", 0)
        self.illegal = 0
        self.last: tuple | None = None
        self.turns: tuple[int, int, int] | None = None  # least, greatest, different ones

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        if len(self.waiting) >= SEGMENT or self.bytes >= SEGMENT_BYTES:
            self.advance()
        words = text.rstrip(SPACES)
        row = (turn, role, text)
        if not words:
            fault = "b"
        elif again or row == self.last:
            fault = "d"
        else:
            fault = "." if words[-1] in ".!?" else "t"
        self.faults[fault] += 1
        if self.last is not None and self.last[1][:1] + role[:1] not in LEGAL:
            self.illegal += 1
        if turn is not None:
            least, greatest, different = self.turns or (turn, turn, 0)
            new = self.last is None or turn != self.last[0]
            self.turns = (min(least, turn), max(greatest, turn), different + new)
        self.last = row
        initial = role[:1] if role[:1] in ("s", "u", "a") else "-"
        self.waiting.append((initial + fault, role, text))
        self.bytes += len(text)

    def repaired(self, audit: str, state: int, sha) -> None:
        """Adds the rows that these edits leave of the waiting ones to the hash."""
        rows = iter(self.waiting)
        for letter in audit:
            code, role, text = ("", "", "") if letter == "I" else next(rows)
            if letter == "D":
                continue
            if letter != "K":
                role = ASSISTANT if needed(state) == "a" else USER
            line = f"{role}:{text}" if state == START else f"\n{role}:{text}"  # only the start has nothing before it
            sha.update(line.encode("utf-8", "surrogatepass"))
            state = STEPS[state][role[0]]

    def advance(self) -> None:
        """Carries the labels over the waiting rows, to every state that can still be on the cheapest way."""
        codes = tuple(row[0] for row in self.waiting)
        best = {end: way for end in range(4) if (way := self.best_way(codes, (end,))) is not None}
        found = {}
        for end, (cost, audit, state, own) in best.items():
            if all(cost <= best[other][0] + more for (s, other), more in DETOUR.items() if s == end and other in best):
                sha = self.labels[state].sha.copy()
                self.repaired(own, state, sha)
                found[end] = Label(cost, audit, sha)
        common = os.path.commonprefix([label.audit for label in found.values()])
        self.shared.append(common)
        for label in found.values():
            label.audit = label.audit[len(common) :]
        self.labels, self.waiting, self.bytes = found, [], 0

    def best_way(self, codes: tuple[str, ...], ends: tuple[int, ...]) -> tuple[int, str, int, str] | None:
        """Cost and audit of the best way so far and on to the ends, the state that it goes on from, its audit from there."""
        ways = []
        for state, label in self.labels.items():
            way = cheapest(codes, state, ends)
            if way is not None:
                ways.append((label.cost + way[0], label.audit + way[1], state, way[1]))
        return min(ways, default=None)

    def close(self) -> tuple:
        cost, audit, state, own = self.best_way(tuple(row[0] for row in self.waiting), ENDS)
        sha = self.labels[state].sha
        self.repaired(own, state, sha)
        gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0
        counts = (gaps, self.faults["b"], self.faults["d"], self.faults["t"], self.illegal, cost)
        return (self.key, *counts, "".join(self.shared) + audit, sha.hexdigest())


# The plan -------------------------------------------------------------------------------------------------------------

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of (conv_id, turn, role, text): rows after damage; dropped ones have no copy."""
    blank = F.lit(" ")

    def filled(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), blank)

    kind = F.crc32(F.concat_ws(":", filled("conv_id"), filled("turn")).cast("binary")) % DAMAGES
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text"))
    role = F.when(kind == 4, USER).otherwise(filled("role"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def seen_before(rows: DataFrame) -> DataFrame:
    """Adds ``again``: an earlier turn of the conversation has a row with this role and text.

    Rows meet as digests, combined inside the tasks; only digests of several turns are joined back.
    """
    digest = [F.xxhash64("role", "text").alias("__d1"), F.xxhash64(F.lit("second"), "role", "text").alias("__d2")]
    marked = rows.select("*", *digest)
    groups = marked.where("copies > 0").groupBy("conv_id", "__d1", "__d2").agg(
        F.min("turn").alias("__least"),
        F.max("turn").alias("__most"),
        F.bool_or(F.col("turn").isNull()).alias("__null"),
    )
    several = groups.where(F.col("__null") & F.col("__least").isNotNull() | (F.col("__least") < F.col("__most"))).select(
        F.col("conv_id").alias("__conv"),
        F.col("__d1").alias("__e1"),
        F.col("__d2").alias("__e2"),
        F.when(~F.col("__null"), F.col("__least")).alias("__first"),
    )
    same = F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("__d1") == F.col("__e1")) & (F.col("__d2") == F.col("__e2"))
    again = F.col("__e1").isNotNull() & ~F.col("turn").eqNullSafe(F.col("__first"))
    return marked.join(several, same, "left").select(*rows.columns, again.alias("again"))


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text, copies): COUNTS, audit, repaired_sha256."""
    key = rows.schema["conv_id"]
    schema = T.StructType(
        [key]
        + [T.StructField(name, T.LongType(), False) for name in COUNTS]
        + [T.StructField(name, T.StringType(), False) for name in ("audit", "repaired_sha256")]
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = spread(seen_before(rows), "conv_id").sortWithinPartitions(*order)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("conversations",), object)  # lets go of what the worker kept for another operator
        open_: Conversation | None = None
        for batch in batches:
            done, kind = [], batch.schema.field(0).type
            for conv, turn, role, text, copies, again in zip(*(c.to_pylist() for c in batch.columns)):
                if open_ is None or conv != open_.key:
                    if open_ is not None:
                        done.append(open_.close())
                    open_ = Conversation(conv)
                for _ in range(copies):
                    open_.add(turn, role, text, again)
            if done:
                yield output(done, kind)
        if open_ is not None:
            yield output([open_.close()], kind)

    def output(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
        arrays = [pa.array(column, k) for column, k in zip(zip(*done), kinds)]
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return map_batches(dealt.select("conv_id", "turn", "role", "text", "copies", "again"), work, schema)


@query("op12_conversation_repair")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    return repair_conversations(damaged(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))
