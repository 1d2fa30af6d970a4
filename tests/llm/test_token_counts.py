"""Prefix counts against the tokenizer's own encodings of every prefix."""

import random
from pathlib import Path

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from sentencepiece.sentencepiece_model_pb2 import ModelProto

from ledgernet.llm.token_counts import PrefixCounter, count_prefixes, fitting, tokens_at

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "▁", " ▁▁a", "<s> </s><unk>", "<0x0A>", "日本語テキスト", "𝔘😀é́", "\x00\r\n\t z", "a" * 50,
    " " * 60, "x  y   z ", "Ünïcödé­ text",
]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


def random_texts(seed, n):
    pick = random.Random(seed)
    letters = ["etaoinshrdlu  ", "abcdé▁ .<>0x1\n\x00日😀ß­", "aab  ", "aeiou tion the ing"]
    return ["".join(pick.choices(letters[i % 4], k=pick.randrange(70))) for i in range(n)]


def test_every_prefix_of_odd_texts(library):
    texts = ODD + random_texts(1, 600)
    steps, starts = PrefixCounter(PATH)(pa.array(texts))
    for text, a, b in zip(texts, starts.tolist(), starts[1:].tolist()):
        text = text or ""
        assert b - a == len(text)
        prefixes = [text[:i] for i in range(1, len(text) + 1)]
        assert steps[a:b].cumsum(dtype="int64").tolist() == [len(x) for x in library.encode(prefixes)]


def test_remembered_units_and_neighbours_can_be_forgotten(library, monkeypatch):
    monkeypatch.setattr("ledgernet.llm.token_counts.REMEMBERED", 20)
    monkeypatch.setattr("ledgernet.llm.token_counts.NEIGHBOURS", 20)
    counter = PrefixCounter(PATH)
    for seed in range(5):
        texts = random_texts(seed, 40)
        steps, starts = counter(pa.array(texts))
        got = [int(steps[a:b].sum(dtype="int64")) for a, b in zip(starts, starts[1:])]
        assert got == [len(x) for x in library.encode(texts)]
    assert len(counter.apart) <= 20


def test_counts_of_documents_and_questions(spark, library):
    texts = [*ODD, "word " * 60_000, "q" * 200_000, *random_texts(9, 100)]
    docs = spark.createDataFrame([(i % 50 if i % 7 else None, t) for i, t in enumerate(texts)], "steps long, text string")
    got = count_prefixes(docs, PATH, key="steps", limit=9)
    assert got.columns == ["steps", "n_bytes", "n_chars", "n_tokens", "steps_", "fit_chars"]
    asked = got.withColumn("half", (F.col("n_chars") / 2).cast("long"))
    asked = asked.withColumn("at_half", tokens_at(F.col("steps_"), F.col("half"))).withColumn("fit", fitting(F.col("steps_"), F.lit(9)))
    rows = asked.collect()
    want = sorted((str(r[0]), len((r[1] or "").encode()), len(library.encode(r[1] or ""))) for r in docs.collect())
    assert sorted((str(r["steps"]), r["n_bytes"], r["n_tokens"]) for r in rows) == want
    assert all(r["fit"] == r["fit_chars"] for r in rows)
    by_size = {(r["n_bytes"], r["n_tokens"]): r for r in rows}
    for text in texts:
        row = by_size[len((text or "").encode()), len(library.encode(text or ""))]
        if row["n_chars"] == len(text or "") and 9 < len(text or "") < 100 and list(texts).count(text) == 1:
            fits = [i for i in range(len(text) + 1) if len(library.encode(text[:i])) <= 9]
            others = [r for r in rows if (r["n_bytes"], r["n_tokens"]) == (row["n_bytes"], row["n_tokens"])]
            assert max(fits) in {r["fit_chars"] for r in others}
            assert len(library.encode(text[: len(text) // 2])) in {r["at_half"] for r in others}


def test_empty_table_and_models_that_change_texts(spark, tmp_path):
    assert count_prefixes(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    for part, setting in (("normalizer_spec", "remove_extra_whitespaces"), ("trainer_spec", "treat_whitespace_as_suffix")):
        proto = ModelProto()
        proto.ParseFromString(Path(PATH).read_bytes())
        setattr(getattr(proto, part), setting, True)
        (tmp_path / setting).write_bytes(proto.SerializeToString())
        with pytest.raises(ValueError, match="prefix counts need"):
            PrefixCounter(str(tmp_path / setting))


def test_questions_outside_the_text(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    got = count_prefixes(docs, PATH)
    answers = got.select(
        tokens_at(F.col("steps"), F.lit(-3)).alias("a"), tokens_at(F.col("steps"), F.lit(99)).alias("b"),
        tokens_at(F.col("steps"), F.lit(None).cast("long")).alias("c"), fitting(F.col("steps"), F.lit(-1)).alias("d"), "n_tokens",
    ).collect()
    assert all(r["a"] == 0 and r["b"] == r["n_tokens"] and r["c"] is None and r["d"] == 0 for r in answers)
