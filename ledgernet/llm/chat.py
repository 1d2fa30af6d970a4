"""Chat training examples: every assistant turn becomes the target of an example of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgernet.llm.columns import field

OPEN, END = "### ", "</turn>\n"
#: What stands for the characters that could form a mark. No escape contains another's first character
#: but as its own start, so undoing them in order restores the text.
ESCAPES = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l")]
NEWLINE = ("\n", "\\n")
TARGET = "assistant"


def escaped(text: Column, *more: tuple[str, str]) -> Column:
    """The text without backslashes of its own, ``#`` or ``<``: no mark can occur in it."""
    for plain, code in [*ESCAPES, *more]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, *more: tuple[str, str]) -> Column:
    """Undo ``escaped``."""
    for plain, code in [*more, *reversed(ESCAPES)]:
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def head(role: Column) -> Column:
    """The mark that opens a turn."""
    return F.concat(F.lit(OPEN), escaped(role, NEWLINE), F.lit("\n"))


def expand(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One example for each assistant turn: all turns before it as context, its text as target.

    Returns ``conv_id``, ``example`` (from 1), ``n_turns`` (of the example), ``formatted``,
    ``loss_start`` (0-based) and ``loss_chars``: only those characters of ``formatted`` are
    trained on, the escaped text of the reply. Turns behind the last reply, or of a
    conversation without one, form a last example without a target, so that the examples
    hold every turn.

    Turns go by ``turn`` (null first), ties by role and text; repeated rows stay. A null
    role or text counts as empty; rows with a null id form one conversation. Other columns
    are not read. An example is one row with all its context, so a conversation has to
    fit in a row; conversations of one text under many ids do not meet in a task.
    """
    c = [field(conversations, x) for x in (conv_id, turn, role, text)]
    rows = conversations.select(
        c[0].alias("conv_id"),
        F.struct(
            c[1].alias("turn"),
            F.coalesce(c[2].cast("string"), F.lit("")).alias("role"),
            F.coalesce(c[3].cast("string"), F.lit("")).alias("text"),
        ).alias("said"),
    )
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    marked = talks.select(
        "conv_id",
        F.size("said").alias("size"),
        F.transform("said", lambda s: F.concat(head(s["role"]), escaped(s["text"]), F.lit(END))).alias("turns"),
        F.filter(
            F.transform("said", lambda s, i: F.when(s["role"] == TARGET, i + 1)), lambda i: i.isNotNull()
        ).alias("replies"),
    )
    ends = F.when(F.array_contains("replies", F.col("size")), F.col("replies")).otherwise(
        F.concat("replies", F.array("size"))
    )
    return (
        marked.select("conv_id", "turns", "replies", F.posexplode(ends).alias("at", "n_turns"))
        .withColumn("trained", F.array_contains("replies", F.col("n_turns")))
        .withColumn("context", F.array_join(F.slice("turns", F.lit(1), F.col("n_turns") - 1), ""))
        .withColumn("reply", F.element_at("turns", F.col("n_turns")))
        .withColumn("opening", F.length(head(F.lit(TARGET))))
        .select(
            "conv_id",
            (F.col("at") + 1).alias("example"),
            "n_turns",
            F.concat("context", "reply").alias("formatted"),
            F.when(F.col("trained"), F.length("context") + F.col("opening")).otherwise(F.lit(0)).alias("loss_start"),
            F.when(F.col("trained"), F.length("reply") - F.col("opening") - len(END)).otherwise(F.lit(0)).alias("loss_chars"),
        )
    )


def turns_of(formatted: Column) -> Column:
    """The turns of a formatted example, as an array of (role, text)."""
    parts = F.split(formatted, END)
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)
    body = lambda t: F.substring(t, F.lit(len(OPEN) + 1), F.length(t))
    return F.transform(
        F.transform(turns, body),
        lambda t: F.struct(
            unescaped(F.substring_index(t, "\n", 1), NEWLINE).alias("role"),
            unescaped(F.substring(t, F.instr(t, "\n") + 1, F.length(t))).alias("text"),
        ),
    )


def trained_text(formatted: Column, start: Column, chars: Column) -> Column:
    """The text under the loss mask, as it was before it was escaped."""
    return unescaped(F.substring(formatted, start + 1, chars))
