import random
import re

import pytest
from pyspark.sql import functions as F

from ledgernet.llm.decontamination import find_passages

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(text, items, size=13):
    """Words, hit words and items of one text, by comparing all runs of words."""
    have, hit, names = WORD.findall(lower(text or "")), set(), set()
    for item, body in items:
        want = WORD.findall(lower(body or ""))
        n = min(size, len(want))
        windows = {tuple(want[i : i + n]) for i in range(len(want) - n + 1)} if n else set()
        for i in range(len(have) - n + 1):
            if tuple(have[i : i + n]) in windows:
                hit.update(range(i, i + n))
                names.update([str(item)] if item is not None else [])
    return len(have), len(hit), sorted(names)


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(4)
    some = ["ab", "Cd", "é", "x1", "of", "THE", "中文"]
    run = lambda n: " ".join(rng.choice(some) for _ in range(n))
    items = [(i, run(rng.choice([3, 13, 15, 30]))) for i in range(12)] + [(None, run(14)), (90, None), (91, ""), (92, "..."), (3, run(20))]
    docs = [(i, run(40) + rng.choice([" ", "\n", ", "]) + rng.choice(items)[1].__str__().upper() + "-" + run(9)) for i in range(60)]
    docs += [(100, None), (101, ""), (None, items[0][1]), (0, docs[0][1]), (102, run(30_000)), (103, "?!")]
    return docs, items


@pytest.mark.parametrize("chars", [8_000_000, 200])
def test_hits_match_brute_force(spark, cases, chars):
    docs, items = cases
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("found", F.lit("taken")).withColumn("items", F.lit(1))
    got = find_passages(df, spark.createDataFrame(items, "item_id long, text string"), automaton_chars=chars)
    assert got.columns == ["doc_id", "text", "found", "items", "found_"]
    rows = got.collect()
    assert len(rows) == len(docs)
    for r in rows:
        f = r["found_"]
        assert (f["n_words"], f["n_hit"], f["items"]) == brute(r["text"], items)
        for p in f["passages"]:
            words = WORD.findall(lower(r["text"]))
            assert WORD.findall(lower(r["text"][p["start"] : p["end"]])) == words[p["first"] : p["last"] + 1]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert find_passages(docs, none).first()["found"]["n_hit"] == 0
    assert find_passages(docs.limit(0), none).count() == 0
