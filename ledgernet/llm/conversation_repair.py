"""Repair of the structure of conversations by generalised LR parsing with weighted edits."""

from __future__ import annotations

import hashlib
from array import array
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgernet.llm.columns import field, free_name
from ledgernet.llm.shared import kept
from ledgernet.llm.words import frugal

#: Stack tops of the role grammar ``C -> H | H L; H -> s | ; L -> P | L P; P -> u a``: nothing
#: read, a system row, the user row of a pair, pairs. Only the first and the last may end.
EMPTY, HEAD, ASKED, PAIRS = range(4)
TOPS = (EMPTY, HEAD, ASKED, PAIRS)
#: The role that may come next, by top, and the top it leads to once ``u a`` is reduced.
SHIFT = {(EMPTY, "s"): HEAD, (EMPTY, "u"): ASKED, (HEAD, "u"): ASKED, (ASKED, "a"): PAIRS, (PAIRS, "u"): ASKED}
ROLES = {"u": "user", "a": "assistant"}
#: What an edited role can be at each top.
EXPECTED = {top: role for (top, role) in SHIFT if role in ROLES}
LEGAL = ("su", "ua", "au")
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Rows and characters of a block; a longer conversation is repaired block by block.
BLOCK_ROWS, BLOCK_CHARS = 1024, 1 << 20
#: Cost of what cannot be.
NEVER = 1 << 40
SPACES = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, CUT = 1, 2, 3


def steps_from(top: int, initial: str, must_go: bool, truncated: bool):
    """(edits, cost, top) of one row on a stack top, inserted rows before it included.

    Two inserted rows reach every top that more of them reach.
    """
    inserted, paid, cut = "", 0, TRUNCATED * truncated
    for _ in range(3):
        yield inserted + "D", paid + DELETE, top
        if not must_go:
            if (top, initial) in SHIFT:
                yield inserted + "K", paid + cut, SHIFT[top, initial]
            yield inserted + "R", paid + cut + REROLE, SHIFT[top, EXPECTED[top]]
        top = SHIFT[top, EXPECTED[top]]
        inserted, paid = inserted + "I", paid + INSERT


_STEPS: dict = {}


def parse(rows, entry: int):
    """Costs and ranks of the stack tops behind the rows, and for each row the links of its tops.

    ``rows`` are (initial, must_go, truncated); ``entry`` is the top before the first one. A
    link is (top before, edits): tops that several edits lead to are merged, and keep the
    link of the least (cost, audit). Audits of different tops have as many letters other than
    I as rows were read and end in one, so that none is the beginning of another: which of
    two tops with equal costs goes first is settled by the ranks of the tops before and the
    letters added, whatever follows.
    """
    tops = {entry: (0, 0)}
    links = []
    for row in rows:
        merged: dict[int, tuple] = {}
        for top, (cost, rank) in tops.items():
            steps = _STEPS.get((top, *row))
            if steps is None:
                steps = _STEPS[(top, *row)] = tuple(steps_from(top, *row))
            for edits, paid, after in steps:
                found = (cost + paid, rank, edits, top)
                if after not in merged or found < merged[after]:
                    merged[after] = found
        order = sorted(merged, key=lambda t: merged[t][1:3])
        tops = {t: (merged[t][0], i) for i, t in enumerate(order)}
        links.append({t: (m[3], m[2]) for t, m in merged.items()})
    return tops, links


def closing(top: int) -> int | None:
    """How many rows have to be inserted behind the last one."""
    return {EMPTY: 0, HEAD: 2, ASKED: 1, PAIRS: 0}[top]


def edits_between(rows, entry: int, leave: int) -> list[str]:
    """The edits of each row, inserted rows before it included, of the best way between two tops."""
    _, links = parse(rows, entry)
    out, top = [], leave
    for link in reversed(links):
        top, edits = link[top]
        out.append(edits)
    return out[::-1]


def fault_of(text: str, seen: bool) -> int:
    """The first fault of a row: blank, duplicate, truncated, or 0."""
    core = text.rstrip(SPACES)
    if not core:
        return BLANK
    return DUPLICATE if seen else CUT if core[-1] not in ".!?" else 0


def actions(role: str, fault: int) -> tuple[str, bool, bool]:
    initial = role[:1] if role[:1] in ("s", "u", "a") else ""
    return initial, fault in (BLANK, DUPLICATE), fault == CUT


def apply_edits(rows, edits: list[str], entry: int, behind: int):
    """(edit, turn, role, text) of each row and each inserted row; deleted rows keep what they were."""
    top = entry
    for (turn, role, text), letters in zip([*rows, (None, "", "")], [*edits, "I" * behind]):
        for letter in letters:
            if letter == "D":
                yield letter, turn, role, text
                continue
            now = role if letter == "K" else ROLES[EXPECTED[top]]
            yield letter, None if letter == "I" else turn, now, "" if letter == "I" else text
            top = SHIFT[top, now[:1]]


@dataclass
class Repair:
    """What was found and done.

    ``summary`` has a row per conversation: the key, ``gaps`` in its turns, rows that are
    ``blank``, ``duplicate`` or ``truncated``, ``illegal`` neighbours, and the ``cost``.
    ``blocks`` has the edits in order, up to ``BLOCK_ROWS`` rows in a block: the key, ``block``
    and ``edits``, an array of (edit, turn, role, text); ``turns`` has them as rows.
    """

    summary: DataFrame
    blocks: DataFrame

    @property
    def turns(self) -> DataFrame:
        """One row per edit: the key, ``block``, ``position`` in it, ``edit``, ``turn``, ``role``, ``text``."""
        key, block, edits = (field(self.blocks, c) for c in self.blocks.columns)
        names = ["position", "edit", "turn", "role", "text"]
        rows = self.blocks.select(key, block, F.posexplode(edits).alias("_position", "_edit"))
        taken = self.blocks.select(key, block)
        picked = [F.col("_position"), *(F.col("_edit")[n] for n in names[1:])]
        return rows.select(
            *(field(rows, c) for c in taken.columns), *(c.alias(free_name(taken, n)) for c, n in zip(picked, names))
        )


_ROW = T.StructType(
    [
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("fault", T.IntegerType()),
    ]
)
_EDIT = T.StructType(
    [
        T.StructField("edit", T.StringType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)
_FIGURES = "blank long, duplicate long, truncated long, illegal long, distinct long, least long, most long, first string, last string"


def _table(rows) -> tuple[list[int], list[int]]:
    """Costs from each top to each, and the rank of each way among those from the same top."""
    costs, ranks = [NEVER] * 16, [0] * 16
    for entry in TOPS:
        for top, (cost, rank) in parse(rows, entry)[0].items():
            costs[4 * entry + top], ranks[4 * entry + top] = cost, rank
    return costs, ranks


def _figures(rows) -> list:
    """Figures of a block's rows (turn, role, text, fault)."""
    faults = [r[3] for r in rows]
    initials = [r[1][:1] for r in rows]
    turns = [r[0] for r in rows if r[0] is not None]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    counts = [faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), illegal, len(set(turns))]
    return [*counts, turns[0] if turns else None, turns[-1] if turns else None, initials[0], initials[-1]]


def _with_faults(given: DataFrame) -> DataFrame:
    """Equal rows as one with ``copies``, and whether role and text come up at an earlier turn (``seen``).

    Both are sums and minima that Spark combines before the shuffle, and the first turns are
    joined by turn as well, so that no conversation or text is gathered.
    """
    same = ["conv", "known", "turn", "role", "digest"]
    read = given.select(
        "conv",
        F.col("turn").isNotNull().alias("known"),
        F.coalesce("turn", F.lit(0)).alias("turn"),
        "role",
        "text",
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
    )
    rows = read.groupBy(*same, "text").agg(F.count(F.lit(1)).alias("copies"))
    first = read.groupBy("conv", "role", "digest").agg(F.min(F.struct("known", "turn")).alias("at"))
    first = first.select(
        *(F.col(c).alias(f"first_{c}") for c in ("conv", "role", "digest")),
        F.col("at.known").alias("first_known"),
        F.col("at.turn").alias("first_turn"),
    )
    joined = rows.join(first, [rows["conv"].eqNullSafe(first["first_conv"]), *(rows[c] == first[f"first_{c}"] for c in same[1:])], "left")
    turn = F.when(F.col("known"), F.col("turn"))
    return joined.select("conv", turn.alias("turn"), "role", "text", "copies", F.col("first_role").isNull().alias("seen"))


def _cut_blocks(batches, kind: pa.DataType):
    """Sorted rows as blocks of one conversation each."""
    number = TaskContext.get().partitionId() << 33
    schema = _block_schema(kind)
    held, size, of, out = [], 0, None, []

    def close():
        nonlocal held, size, number
        codes = [actions(role, fault) for _, role, _, fault in held]
        costs, ranks = _table(codes)
        names = ("turn", "role", "text", "fault")
        out.append([of, number, [dict(zip(names, r)) for r in held], *_figures(held), costs, ranks])
        number += 1
        held, size = [], 0

    def send():
        columns = [pa.array(c, f.type) for c, f in zip(zip(*out), schema)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    sent = 0
    for batch in batches:
        for conv, turn, role, text, copies, seen in zip(*(c.to_pylist() for c in batch.columns)):
            if held and conv != of:
                close()
            of = conv
            fault = fault_of(text, seen)
            # Further copies stand next to the row and repeat it.
            again = fault if fault == BLANK else DUPLICATE
            for i in range(copies):
                held.append((turn, role, text, again if i else fault))
                size += len(text)
                sent += len(text) + 100
                if len(held) >= BLOCK_ROWS or size >= BLOCK_CHARS:
                    close()
                if sent >= BLOCK_CHARS and out:
                    yield send()
                    sent = 0
    if held:
        close()
    if out:
        yield send()


def _block_schema(kind: pa.DataType) -> pa.Schema:
    row = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.int32())])
    whole = [("conv", kind), ("block", pa.int64()), ("turns", pa.list_(row))]
    figures = [(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in _FIGURES.split(", ")]
    return pa.schema([*whole, *figures, ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32()))])


class _Conversation:
    """The blocks of one conversation in order: the four tops, figures so far, and links of each block."""

    def __init__(self):
        self.tops = {EMPTY: (0, 0)}
        self.blocks, self.links = array("q"), array("b")
        self.figures = [0] * 5
        self.least = self.most = self.last = None

    def add(self, block, blank, duplicate, truncated, illegal, distinct, least, most, first, last, costs, ranks) -> None:
        joint = self.last is not None and self.last + first not in LEGAL
        again = self.most is not None and least == self.most
        more = (blank, duplicate, truncated, illegal + joint, distinct - again)
        self.figures = [a + b for a, b in zip(self.figures, more)]
        self.least = least if self.least is None else self.least
        self.most = self.most if most is None else most
        self.last = last
        merged: dict[int, tuple] = {}
        for top, (cost, rank) in self.tops.items():
            for after in TOPS:
                paid = costs[4 * top + after]
                found = (cost + paid, rank, ranks[4 * top + after], top)
                if paid < NEVER and (after not in merged or found < merged[after]):
                    merged[after] = found
        order = sorted(merged, key=lambda t: merged[t][1:3])
        self.tops = {t: (merged[t][0], i) for i, t in enumerate(order)}
        self.blocks.append(block)
        self.links.extend(merged[t][3] if t in merged else -1 for t in TOPS)

    def end(self) -> tuple[list, list]:
        """(block, entry, leave, behind) of each block, and the figures with the cost."""
        cost, _, leave = min((cost + INSERT * closing(t), rank, t) for t, (cost, rank) in self.tops.items())
        behind, out = closing(leave), []
        for i in range(len(self.blocks) - 1, -1, -1):
            entry = self.links[4 * i + leave]
            out.append((self.blocks[i], entry, leave, behind))
            leave, behind = entry, 0
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.figures[4]
        return out, [gaps, *self.figures[:4], cost]


def repair(
    conversations: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> Repair:
    """The cheapest edits that make each conversation a system row or none, then pairs of user and assistant.

    Rows of a conversation stand by turn (null first), then role, then text in byte order.
    A row's first fault counts: blank (nothing but white space), duplicate (role and text
    came up before), truncated (the last character that is no white space is none of
    ``.!?``). Blank and duplicate rows have to be deleted. Keeping a row is free, giving it
    another role or inserting an empty one costs 3, deleting it 4, and a truncated row that
    stays 3 more. Of edits with equal costs those with the least audit (D, I, K, R) are taken.
    A role counts by its first character; an empty or unknown one cannot be kept.

    1. Equal rows become one with a count and learn whether they repeat an earlier turn.
    2. Rows are sorted into ranges, which cuts a conversation of any length, and become
       blocks: what each costs from each stack top to each.
    3. The blocks of a conversation, 16 costs and figures each, pass one after another, with
       four tops in memory and twelve bytes kept per block.
    4. Each block applies the edits between the tops chosen for it.

    A null role or text counts as one space, null keys are one conversation. Other columns are not
    read. An empty table gives empty results; a conversation whose rows are all deleted has a
    summary and edits, but no turn that stays.
    """
    given = conversations.select(
        field(conversations, key).alias("conv"),
        field(conversations, turn).cast("long").alias("turn"),
        F.coalesce(field(conversations, role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(field(conversations, text).cast("string"), F.lit(" ")).alias("text"),
    )
    conv = given.schema["conv"].dataType
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = _with_faults(given).repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches):
        for first in batches:
            yield from _cut_blocks((b for part in ([first], batches) for b in part), first.schema.field(0).type)

    block = T.StructType(
        [
            T.StructField("conv", conv),
            T.StructField("block", T.LongType()),
            T.StructField("turns", T.ArrayType(_ROW)),
            *T.StructType.fromDDL(_FIGURES).fields,
            T.StructField("costs", T.ArrayType(T.LongType())),
            T.StructField("ranks", T.ArrayType(T.IntegerType())),
        ]
    )
    blocks = kept(rows.mapInArrow(frugal(cut), block), "conversation-blocks")

    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    chosen = T.StructType(
        [
            T.StructField("conv", conv),
            *(T.StructField(n, T.LongType()) for n in ("block", "entry", "leave", "behind")),
            *(T.StructField(n, T.LongType()) for n in names),
        ]
    )

    def choose(batches):
        kind, of, state, out = None, None, None, []

        def send():
            columns = [pa.array(c, t) for c, t in zip(zip(*out), [kind, *[pa.int64()] * 10])]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, chosen.names)

        def end():
            ways, figures = state.end()
            for way in ways:
                # The first block of a conversation carries the figures.
                out.append([of, *way, *(figures if way is ways[-1] else [None] * 6)])
                if len(out) >= 10_000:
                    yield send()

        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, *figures in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or conv != of:
                    if state is not None:
                        yield from end()
                    of, state = conv, _Conversation()
                state.add(*figures)
        if state is not None:
            yield from end()
        if out:
            yield send()

    thin = blocks.drop("turns").repartition("conv").sortWithinPartitions("conv", "block")
    choices = kept(thin.mapInArrow(frugal(choose), chosen), "conversation-choices")

    def mend(batches):
        for batch in batches:
            conv, number, turns, entry, leave, behind = batch.columns
            out = []
            for rows, a, b, more in zip(*(c.to_pylist() for c in (turns, entry, leave, behind))):
                codes = [actions(r["role"], r["fault"]) for r in rows]
                plain = [(r["turn"], r["role"], r["text"]) for r in rows]
                done = apply_edits(plain, edits_between(codes, a, b), a, more)
                out.append([dict(zip(_EDIT.names, e)) for e in done])
            kind = pa.list_(pa.struct([("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([conv, number, pa.array(out, kind)], ["conv", "block", "edits"])

    todo = blocks.select("conv", "block", "turns").join(choices.select("block", "entry", "leave", "behind"), "block")
    todo = todo.select("conv", "block", "turns", "entry", "leave", "behind")
    mended = todo.mapInArrow(frugal(mend), T.StructType([*block.fields[:2], T.StructField("edits", T.ArrayType(_EDIT))]))
    summary = choices.where("cost is not null").select("conv", *names)

    def named(df: DataFrame) -> DataFrame:
        taken = conversations.select(field(conversations, key))
        others = [(c, free_name(taken, c)) for c in df.columns[1:]]
        return df.select(F.col("conv").alias(key), *(F.col(c).alias(n) for c, n in others))

    return Repair(named(summary), named(mended))


def digests(blocks: DataFrame) -> DataFrame:
    """(key, audit, repaired_sha256) of ``Repair.blocks``: edits in order, and the hash of ``role:text`` lines.

    Blocks of a conversation pass one after another; only its audit and the state of the hash are held.
    """
    names = blocks.columns
    key = blocks.schema[names[0]]
    schema = T.StructType([T.StructField("conv", key.dataType), *map(T.StructField, ("audit", "repaired_sha256"), [T.StringType()] * 2)])

    def run(batches):
        of, kind, audit, told, first = None, None, None, None, True

        def row():
            columns = [[of], ["".join(audit)], [told.hexdigest()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.string(), pa.string()))], schema.names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, edits in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if audit is None or conv != of:
                    if audit is not None:
                        yield row()
                    of, audit, told, first = conv, [], hashlib.sha256(), True
                audit.append("".join(e["edit"] for e in edits))
                for e in edits:
                    if e["edit"] != "D":
                        told.update(f"{'' if first else chr(10)}{e['role']}:{e['text']}".encode())
                        first = False
        if audit is not None:
            yield row()

    plain = blocks.select(*(field(blocks, n).alias(x) for n, x in zip(names, ("conv", "block", "edits"))))
    sorted_blocks = plain.repartition("conv").sortWithinPartitions("conv", "block")
    found = sorted_blocks.mapInArrow(frugal(run), schema)
    taken = blocks.select(field(blocks, names[0]))
    return found.select(F.col("conv").alias(key.name), *(F.col(c).alias(free_name(taken, c)) for c in schema.names[1:]))
