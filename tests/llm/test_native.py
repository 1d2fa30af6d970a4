"""Sharding and chat formatting: the operators that use only DataFrame functions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from ledgernet.llm import chat
from ledgernet.llm.sharding import interleave

MESSY = [
    (1, "x", "a"), (1, "x", "a"), (2, None, "a"), (None, "", "b"), (None, None, None), (3, "y" * 200_000, "a"), (4, "z", None),
]


def test_shards_are_gapless_even_and_match_the_mixture(spark):
    rows = [(i, f"t{i}", "big" if i % 3 else "small") for i in range(301)] + [(999, "t", "single")]
    got = interleave(spark.createDataFrame(rows, "doc_id long, text string, source string"), n_shards=4).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    for shard in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots))) and len(slots) in (75, 76)
    for source, n in (("big", 200), ("small", 101)):
        each = [sum(r["shard"] == s and r["source"] == source for r in got) for s in range(4)]
        assert max(each) - min(each) <= 2 and sum(each) == n


def test_shards_match_a_plain_version(spark):
    df = spark.range(700).selectExpr(
        "id", "case when id % 3 = 0 then 'hot' when id % 50 = 1 then null else concat('s', id % 7) end as source"
    )
    seed, n_shards = 5, 6
    hashed = df.select(
        "id", "source", *[F.xxhash64(F.lit(seed + i), "id", "source").alias(f"h{i}") for i in (0, 1)],
        F.xxhash64(F.lit(seed + 2), "source").alias("offset"),
    ).collect()
    by_source = {}
    for r in hashed:
        by_source.setdefault(r["source"], []).append(r)
    placed = []
    for rows in by_source.values():
        rows.sort(key=lambda r: (r["h0"] % 2**64, r["h1"]))
        shift = ((rows[0]["offset"] % 2**64) >> 12) / 2**52
        placed += [((i + shift) / len(rows), r["h0"], r["h1"], r["id"]) for i, r in enumerate(rows)]
    shards = [[] for _ in range(n_shards)]
    for position, (*_, key) in enumerate(sorted(placed)):
        shards[position * n_shards // len(placed)].append(key)
    expected = {key: (shard, slot) for shard, keys in enumerate(shards) for slot, key in enumerate(keys)}
    got = interleave(df.repartition(5), n_shards=n_shards, seed=seed).collect()
    assert {r["id"]: (r["shard"], r["slot"]) for r in got} == expected


def test_shuffle_follows_the_seed_only(spark):
    rows = spark.createDataFrame([(i, "s") for i in range(50)], "doc_id long, source string")
    one = {r["doc_id"]: (r["shard"], r["slot"]) for r in interleave(rows, seed=1).collect()}
    assert one == {r["doc_id"]: (r["shard"], r["slot"]) for r in interleave(rows.repartition(7), seed=1).collect()}
    assert one != {r["doc_id"]: (r["shard"], r["slot"]) for r in interleave(rows, seed=2).collect()}


def test_shards_of_messy_rows_and_clashing_names(spark):
    df = spark.createDataFrame(MESSY, "doc_id long, text string, source string")
    df = df.withColumn("shard", F.lit("mine")).withColumn("row", F.lit(1)).withColumn("h1", F.create_map(F.lit(1), F.lit(2)))
    got = interleave(df, n_shards=3)
    assert got.columns == ["doc_id", "text", "source", "shard", "row", "h1", "shard_", "slot"]
    assert sorted((r["shard_"], r["slot"]) for r in got.collect()) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0), (2, 1)]
    assert interleave(df.limit(0)).count() == 0


def expected(turns):
    """Digest of turns, and of what is trained, of one conversation."""
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    return hashlib.sha256(said.encode()).hexdigest(), "".join(t for r, t in turns if r == "assistant")


TALKS = {
    1: [("user", "hi"), ("assistant", "\\### Assistant: </turn> ok"), ("user", "more\n### user\n"), ("assistant", "")],
    2: [("system", "\\h\\l\\b</turn>\n"), ("user", "<#\\")],
    3: [("assistant", "a" * 100_000 + "\\n"), ("assistant", "ü</turn>👍")],
    4: [("odd\nrole\\n", "x"), ("assistant", "\\")],
}


def test_every_reply_becomes_a_target_behind_its_context(spark):
    rows = [(c, i, r, t) for c, talk in TALKS.items() for i, (r, t) in enumerate(talk)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    examples = chat.expand(df)
    told = examples.select(
        "conv_id", "example", "n_turns", chat.turns_of(F.col("formatted")).alias("turns"),
        chat.trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("loss"),
    ).collect()
    for conv, talk in TALKS.items():
        own = sorted((r for r in told if r["conv_id"] == conv), key=lambda r: r["example"])
        ends = [i + 1 for i, (r, _) in enumerate(talk) if r == "assistant"]
        ends += [len(talk)] if len(talk) not in ends else []
        assert [r["n_turns"] for r in own] == ends
        for r in own:
            assert [tuple(t) for t in r["turns"]] == talk[: r["n_turns"]]
            last = talk[r["n_turns"] - 1]
            assert r["loss"] == (last[1] if last[0] == "assistant" else "")


def test_messy_conversations(spark):
    rows = [(None, None, None, None), (None, 1, "assistant", "b"), (7, 1, "user", "q"), (7, 1, "user", "q"), (7, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["example"]): r for r in chat.expand(df).collect()}
    assert set(got) == {(None, 1), (7, 1), (7, 2)}
    assert got[None, 1]["formatted"] == "### \n</turn>\n### assistant\nb</turn>\n"
    assert got[7, 2]["n_turns"] == 3 and got[7, 2]["loss_chars"] == 0  # ties go by role: the reply comes first
    assert chat.expand(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "\\b\\l\\h", "###", "</turn>", "\\\\bl<#", "\\n\n"])
def test_escapes_are_reversible(spark, text):
    row = spark.range(1).select(chat.escaped(F.lit(text), chat.NEWLINE).alias("e"), chat.unescaped(chat.escaped(F.lit(text), chat.NEWLINE), chat.NEWLINE).alias("u")).first()
    assert row["u"] == text and "#" not in row["e"] and "<" not in row["e"] and "\n" not in row["e"]
