"""Repair of conversations against enumeration of all edits, and the registered query against a plain version."""

import hashlib
import random
import zlib
from itertools import product

import pytest

from ledgernet.llm import conversation_repair as R
from ledgernet.llm.queries import repaired_conversations

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """(cost, audit, repaired) of the best edits of (role, text, must_go, truncated), by trying all of them."""
    best = None
    gaps = [("", "I", "II")] * (len(rows) + 1)
    for inserts in product(*gaps):
        for kept in product(*("D" if r[2] else "DKR" for r in rows)):
            cost, audit, top, out, legal = 0, "", "", [], True
            for extra, letter, row in zip(inserts, [*kept, ""], [*rows, None]):
                for _ in extra:
                    role = "assistant" if top == "u" else "user"
                    out.append(f"{role}:")
                    top, cost, audit = role[0], cost + 3, audit + "I"
                if not letter:
                    break
                audit += letter
                if letter == "D":
                    cost += 4
                    continue
                role = row[0] if letter == "K" else "assistant" if top == "u" else "user"
                cost += 3 * (letter == "R") + 3 * row[3]
                if (top, role[:1]) not in NEXT:
                    legal = False
                    break
                top = role[0]
                out.append(f"{role}:{row[1]}")
            if legal and top in ("", "a") and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(out))
    return best


def faults(rows):
    """(fault, must go, truncated) of (role, text) in order."""
    seen, out = set(), []
    for role, text in rows:
        core = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def expected(conversations):
    """The rows of the query, from {conv: [(turn, role, text)]}."""
    out = {}
    for conv, given in conversations.items():
        rows = []
        for turn, role, text in given:
            told = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            kind = zlib.crc32(told.encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        told = faults([r[1:] for r in rows])
        turns = [r[0] for r in rows if r[0] is not None]
        initials = [r[1][:1] for r in rows]
        cost, audit, text = cheapest([(r[1], r[2], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(rows, told)])
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        counts = [told.count(f) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def random_conversations(seed, n, longest):
    pick = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "agent"]
    texts = ["Ja.", "nein", " ", None, "", "Was?\n", "So!", "é ", "a\tb. "]
    out = {}
    for conv in range(n):
        rows = []
        for _ in range(pick.randrange(1, longest + 1)):
            role = pick.choice(["user", "assistant"] if pick.random() < 0.6 else roles)
            rows.append((pick.choice([None, *range(9)]), role, pick.choice(texts)))
        out[conv] = rows
    return out


def rows_of(spark, conversations):
    return spark.createDataFrame([(c, *r) for c, rows in conversations.items() for r in rows], SCHEMA)


def told_by(frame):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r["conv_id"]: tuple(r[n] for n in names) for r in frame.collect()}


@pytest.mark.parametrize("block", [1024, 1, 2])
def test_query_is_the_enumeration(spark, monkeypatch, block):
    """Blocks of one or two rows have to give what whole conversations give."""
    monkeypatch.setattr(R, "BLOCK_ROWS", block)
    given = random_conversations(block, 120, 4)
    given[None] = [(0, "user", "Null."), (None, "assistant", "Key.")]
    assert told_by(repaired_conversations(rows_of(spark, given))) == expected(given)


def test_blocks_and_ranges_of_a_long_conversation(spark, monkeypatch):
    """One conversation with most of the rows is cut, and repaired as if it were not."""
    pick = random.Random(5)
    texts = ["Ja.", "nein", "Was?", "So!", ""]
    rows = [(1, t, pick.choice(["user", "assistant", "tool"]), f"{t % 400} {pick.choice(texts)}") for t in range(3000)]
    rows += [(2, 0, "user", "Hallo."), (2, 1, "assistant", "Ja.")]
    frame = spark.createDataFrame(rows, SCHEMA)
    whole = R.repair(frame.coalesce(1))
    one = {r["conv_id"]: r for r in whole.summary.collect()}, {r["conv_id"]: r for r in R.digests(whole.blocks).collect()}
    monkeypatch.setattr(R, "BLOCK_ROWS", 7)
    cut = R.repair(frame)
    assert cut.blocks.count() > 400
    two = {r["conv_id"]: r for r in cut.summary.collect()}, {r["conv_id"]: r for r in R.digests(cut.blocks).collect()}
    assert one == two and one[0][1]["cost"] > 1000
    # Without merged tops: all ways through the first rows of the conversation.
    codes = [R.actions(role, R.fault_of(text, False)) for _, _, role, text in rows[:5]]
    plain = [(role, text, a[1], a[2]) for (_, _, role, text), a in zip(rows[:5], codes)]
    tops, _ = R.parse(codes, R.EMPTY)
    assert min(c + 3 * R.closing(t) for t, (c, _) in tops.items()) == cheapest(plain)[0]


def test_repaired_turns_follow_the_grammar(spark):
    given = random_conversations(11, 60, 6)
    turns = R.repair(rows_of(spark, given)).turns
    assert turns.columns == ["conv_id", "block", "position", "edit", "turn", "role", "text"]
    by = {}
    for r in turns.orderBy("conv_id", "block", "position").collect():
        if r["edit"] != "D":
            by.setdefault(r["conv_id"], []).append(r)
    for rows in by.values():
        initials = "".join(r["role"][0] for r in rows).removeprefix("s")
        assert initials == "ua" * (len(initials) // 2)
        assert all(r["text"] == "" and r["turn"] is None for r in rows if r["edit"] == "I")


def test_empty_long_and_clashing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    done = R.repair(empty)
    assert done.summary.count() == done.blocks.count() == R.digests(done.blocks).count() == 0
    assert repaired_conversations(empty).count() == 0
    odd = spark.createDataFrame(
        [("c", 0, "user", "x" * 3_000_000 + "."), ("c", 1, "assistant", "y."), ("c", 1, "assistant", "y.")],
        "block string, edits long, cost string, audit string",
    )
    done = R.repair(odd, key="block", turn="edits", role="cost", text="audit")
    assert done.summary.columns == ["block", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    assert done.blocks.columns == ["block", "block_", "edits"]
    row = done.summary.collect()[0]
    assert (row["duplicate"], row["cost"]) == (1, 4)
    assert R.digests(done.blocks).collect()[0]["audit"] == "KKD"
