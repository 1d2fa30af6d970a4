import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgernet.llm.language_id import ContextTree, identify, learn_languages

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
TEXTS = [
    ("the cat and the dog sat on the mat", "en"), ("The End of it all", "en"), ("der Hund und die Katze über dem Haus", "de"),
    ("ein kleines Haus und ein großer Baum", "de"), ("x", "de"), (None, "en"), ("no language given", None), ("", "fr"),
]


def counts(order=3):
    """Counters by language, order and context."""
    out = {}
    for text, lang in TEXTS:
        if lang is None:
            continue
        data = bytes(order) + (text or "").encode().translate(LOWER)
        mine = out.setdefault(lang, [defaultdict(Counter) for _ in range(order + 1)])
        for i in range(order, len(data)):
            for k in range(order + 1):
                mine[k][data[i - k : i]][data[i]] += 1
    return {k: v for k, v in out.items() if v[0]}


def nats(text, mine, order=3):
    """Code length by the definition: contexts from long to short, with exclusion."""
    data, total = bytes(order) + text.encode().translate(LOWER), 0.0
    for i in range(order, len(data)):
        gone = set()
        for k in range(order, -1, -1):
            seen = mine[k].get(data[i - k : i])
            if not seen:
                continue
            left = {b: n for b, n in seen.items() if b not in gone}
            room = sum(left.values()) + len(left)
            if data[i] in left:
                total -= math.log(left[data[i]] / room)
                break
            if room:
                total -= math.log(len(left) / room)
            gone |= set(seen)
        else:
            total += math.log(256 - len(gone))
    return total


@pytest.fixture(scope="module")
def model(spark):
    return learn_languages(spark.createDataFrame(TEXTS, "text string, lang string"))


def test_code_lengths_match_the_definition(spark, model):
    mine = counts()
    assert set(model) == set(mine) == {"en", "de"}
    asked = ["the mat", "über das Haus", "ZZZ qqq \x7f", "a", "der the", "日本"]
    rows = identify(spark.createDataFrame([(t,) for t in asked], "text string"), model).collect()
    for r in rows:
        cost = {lang: nats(r["text"], c) for lang, c in mine.items()}
        best = min(sorted(cost), key=cost.get)
        assert r["lang_pred"] == best
        assert r["lang_score"] == pytest.approx(1 / sum(math.exp(cost[best] - c) for c in cost.values()), abs=1e-9)


def test_probabilities_behind_any_context_sum_to_one(model):
    for keys, n in model.values():
        tree = ContextTree(keys, n, 3)
        for context in (b"\0\0\0", b"the", b"qqq", b" th"):
            head = int.from_bytes(context, "big") << 8
            shares = np.exp(-tree.costs(np.array([head | b for b in range(256)], np.uint32)))
            assert shares.sum() == pytest.approx(1)


def test_messy_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "123 ..."), (4, "the " * 100_000), (4, "the " * 100_000), (None, "und die")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang_pred", F.lit(0))
    got = identify(df, model)
    assert got.columns == ["doc_id", "text", "lang_pred", "lang_pred_", "lang_score"]
    assert sorted((r["doc_id"] or 0, r["lang_pred_"]) for r in got.collect()) == [
        (0, "de"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en")
    ]
    empty = learn_languages(spark.createDataFrame([], "text string, lang string"))
    assert empty == {} and {r["lang_pred_"] for r in identify(df, empty).collect()} == {"und"}
    assert identify(df.limit(0), model).count() == 0
    with pytest.raises(ValueError, match="lower order"):
        learn_languages(spark.createDataFrame(TEXTS, "text string, lang string"), most=3)
