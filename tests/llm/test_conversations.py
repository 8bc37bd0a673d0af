"""Conversation repair against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from costweave.llm import conversations
from costweave.llm.queries import QUERIES

WORD = r"[^\x20\x09-\x0D]"


def plain_damage(rows):
    """Rows after damage by conversation, in their order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        copies = 0 if kind == 0 else 2 if kind == 3 else 1
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * copies
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        words = re.findall(WORD, text)
        out.append("b" if not words else "d" if (role, text) in seen else "." if words[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def plain_repair(rows, faults):
    """Least (cost, audit, repaired rows) by states, row by row: a forward pass with every edit of the contract."""
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ())}

    def offer(into, state, way):
        if state is not None and (state not in into or way < into[state]):
            into[state] = way

    def inserted(ways):
        for _ in range(3):
            for state, (cost, audit, kept) in list(ways.items()):
                for role in ("user", "assistant"):
                    offer(ways, follow.get((state, role[0])), (cost + 5, audit + "I", (*kept, f"{role}:")))
        return ways

    for (_, role, text), fault in zip(rows, faults):
        ways = {}
        more = 5 * (fault == "t")
        for state, (cost, audit, kept) in inserted(best).items():
            offer(ways, state, (cost + 2, audit + "D", kept))
            if fault in "bd":
                continue
            offer(ways, follow.get((state, role[:1])), (cost + more, audit + "K", (*kept, f"{role}:{text}")))
            for new in ("user", "assistant"):
                offer(ways, follow.get((state, new[0])), (cost + 1 + more, audit + "R", (*kept, f"{new}:{text}")))
        best = ways
    return min(way for state, way in inserted(best).items() if state in ("", "a"))


def plain_conversations(rows):
    for conv, left in plain_damage(rows).items():
        faults = plain_faults(left)
        turns = {turn for turn, _, _ in left if turn is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(left, left[1:]))
        cost, audit, kept = plain_repair(left, faults)
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        yield conv, gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, digest


@pytest.mark.parametrize("segment", [conversations.SEGMENT, 3])
@pytest.mark.parametrize("name", ["tables", "odd", "none"])
def test_whole_tables(name, segment, spark, sf_dir, odd_dir, none_dir, monkeypatch):
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    folder = {"tables": sf_dir, "odd": odd_dir, "none": none_dir}[name]
    columns = ("conv_id", "turn", "role", "text")
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select(*columns).collect()]
    got = [tuple(r) for r in QUERIES["op12_conversation_repair"](spark, folder).collect()]
    assert sorted(got, key=repr) == sorted(plain_conversations(rows), key=repr)


def every_way(codes, most_inserts=4):
    """Least (cost, audit) over all edit strings with so many inserts."""
    best = None
    waiting = [(0, 0, 0, "", 0)]
    while waiting:
        i, state, cost, audit, inserts = waiting.pop()
        if best is not None and cost > best[0]:
            continue
        if i == len(codes) and state in conversations.ENDS:
            best = min(best or (cost, audit), (cost, audit))
        if inserts < most_inserts:
            after = conversations.STEPS[state][conversations.needed(state)]
            waiting.append((i, after, cost + 5, audit + "I", inserts + 1))
        if i < len(codes):
            for before, after, more, letter in conversations.row_edges(codes[i]):
                if before == state:
                    waiting.append((i + 1, after, cost + more, audit + letter, inserts))
    return best


def test_meeting_heaps_find_the_least_audit():
    draw = random.Random(0)
    for _ in range(600):
        codes = tuple(draw.choice(conversations.CODES) for _ in range(draw.randint(0, 6)))
        assert conversations.cheapest(codes, conversations.START, conversations.ENDS) == every_way(codes)


def test_a_conversation_of_any_length_keeps_a_segment(monkeypatch):
    """Rows go by; what is kept is a segment and the part of the audit on which the states do not agree."""
    draw = random.Random(1)
    conversation = conversations.Conversation(1)
    for turn in range(5_000):
        role = draw.choice(["user", "assistant", "user", "assistant", "tool"])
        conversation.add(turn, role, draw.choice(["Yes.", "no", "", "Why?"]), False)
        assert len(conversation.waiting) <= conversations.SEGMENT
    assert all(len(label.audit) < 1000 for label in conversation.labels.values())
    assert len(conversation.close()[7]) >= 5_000


def test_many_equal_rows_need_no_memory_of_them(spark):
    """One text in every turn of one conversation: found by grouped digests."""
    rows = spark.range(3000).selectExpr("cast(7 as long) conv_id", "id turn", "'user' role", "'Same.' text", "1 copies")
    (row,) = conversations.repair_conversations(rows).collect()
    assert (row["duplicate"], row["gaps"], row["illegal"], row["cost"]) == (2999, 0, 2999, 2 * 2999 + 2)
