import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgernet.llm.packing import WordIds, best_cuts, in_two, listed, pack, powers
from ledgernet.llm.queries import word_tokenizer

ODD = [
    "", None, "plain words, here. And More!", "<|endoftext|> a<|ENDOFTEXT|>b", "don't it's 'S", "ÉTÉ, Ünder; ßΣ. Ω:", "İ# e\u0301, \u0338",
    "a\x0bb\x0cc\x1cd\x85e\u00a0f", "中文 한국 👍👍", "12,5% $x& #y", "w" * 5000, "..,!?* ,a .b",
]


def reference(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_tokenizer()).encode(text or "", add_special_tokens=False).ids + [2]


def test_ids_are_those_of_the_tokenizer():
    ids, begin = WordIds(word_tokenizer(), 2)(pa.array(ODD))
    for i, text in enumerate(ODD):
        assert ids[begin[i] : begin[i + 1]].tolist() == reference(text)


def test_pieces_are_listed_as_they_are_and_endings_parted_behind_letters():
    words = [w for text in ODD if text for w in text.split(" ") if w]
    for some in (words, words[:1], []):
        assert listed(pa.array(some, pa.string())) == some
    core, ending, parted = in_two(pa.array(["And", "here.", "5%", "Ω:", "中文!", "..,", "x&#"]))
    assert core.to_pylist() == ["and", "here", "5%", "Ω", "中文", "..,", "x"]
    assert (ending.to_pylist(), parted.tolist()) == ([".", ":", "!", "&#"], [1, 3, 4, 6])


def test_cuts_cost_least():
    rng = np.random.default_rng(1)
    for _ in range(30):
        places = np.cumsum(rng.integers(1, 6, 9))
        penalty = rng.integers(0, 4, 9).astype(float)
        cost = lambda ends: sum(10 - (b - a) for a, b in zip((0, *ends), ends)) + sum(penalty[places.tolist().index(e)] for e in ends)  # noqa: E731,B023
        options = [
            (*some, int(places[-1]))
            for n in range(9)
            for some in itertools.combinations(places[:-1].tolist(), n)
            if all(b - a <= 10 for a, b in zip((0, *some), (*some, int(places[-1]))))
        ]
        assert cost(tuple(best_cuts(places, penalty, 10, True))) == min(map(cost, options))


@pytest.mark.parametrize("length", [16, 64])
def test_pieces_hold_every_id_once(spark, length):
    texts = ODD + ["word " * 3000] + ["short text. " * n for n in range(30)]
    rows = list(enumerate(texts)) + [(None, "null id"), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1)).repartition(2)
    got = pack(df, word_tokenizer(), length=length).collect()
    for key in {r[0] for r in rows}:
        own = sorted((r for r in got if r["doc_id"] == key), key=lambda r: r["start"])
        copies = sum(r[0] == key for r in rows)
        ids = reference(dict(rows)[key])
        assert sum(r["length"] for r in own) == copies * len(ids) and all(r["doc_tokens"] == len(ids) for r in own)
        for r in own:
            assert np.frombuffer(r["ids"], "<u4").tolist() == ids[r["start"] : r["start"] + r["length"]]
    for _, group in itertools.groupby(sorted(got, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        group = list(group)
        assert [r["offset"] for r in group] == [sum(r["length"] for r in group[:i]) for i in range(len(group))]
        assert sum(r["length"] for r in group) <= length


def test_clashing_key_and_empty_table(spark):
    df = spark.createDataFrame([("a", "x")], "start string, text string")
    assert pack(df, word_tokenizer(), key="start").columns == ["start", "start_", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    assert pack(df.limit(0), word_tokenizer(), key="start").count() == 0
    assert powers(13) == [8, 4, 1]
