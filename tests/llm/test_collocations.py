"""Phrase mining against counting all phrases in plain Python."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from ledgernet.llm import collocations as C
from ledgernet.llm.queries import best_phrases


def plain(rows, longest=3, least=10, contained=50):
    """{(lang, phrase): (a, l, r, n, score)} of (text, lang) rows."""
    counts, sizes = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            sizes[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + size])] += 1
    out = {}
    for lang, found in counts.items():
        frequent = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        for phrase, a in frequent.items():
            longer = [f for p, f in frequent.items() if len(p) > len(phrase) and 100 * f >= contained * a
                      and any(p[i : i + len(phrase)] == phrase for i in range(len(p)))]
            if longer:
                continue
            cuts = [(found[phrase[:k]], found[phrase[k:]]) for k in range(1, len(phrase))]
            score, _, left, right = min((1000000 * a * a // (x * y), k, x, y) for k, (x, y) in enumerate(cuts))
            out[lang, " ".join(phrase)] = (a, left, right, sizes[lang], score)
    return out


def mined(frame):
    rows = frame.collect()
    out = {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"], r["score"]) for r in rows}
    assert len(out) == len(rows)
    return out


def random_rows(seed, n):
    pick = random.Random(seed)
    words = ["der", "Die", "das", "é", "Ünd", "x1", "a-b", "日本", "und", "wer"]
    ends = [" ", " ", " ", " ", ", ", ". ", "\t", "\n", "  ", "!", "\r\n", ";"]
    rows = [("".join(pick.choice(words) + pick.choice(ends) for _ in range(pick.randrange(60))), pick.choice(["de", "en", None])) for _ in range(n)]
    return [*rows, (None, "de"), ("", None), (" \t.\n", "en"), (None, None), *[rows[0]] * 5]


@pytest.mark.parametrize("block", [C.BLOCK_BYTES, 500])
@pytest.mark.parametrize("longest", [2, 3, 4])
def test_all_phrases(spark, monkeypatch, block, longest):
    monkeypatch.setattr(C, "BLOCK_BYTES", block)
    monkeypatch.setattr(C, "WAITING_BYTES", 3 * block)
    rows = random_rows(longest, 250)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    got = mined(C.mine_phrases(docs, longest=longest))
    assert got == plain(rows, longest) and len(got) > 50


def test_one_phrase_makes_up_most_rows(spark):
    """Overlapping occurrences, a phrase inside a longer one, and a language told by its column only."""
    rows = [("ha " * 500, "a")] * 40 + [("new york city", "b")] * 11 + [("new york", "b")] * 12 + [("new york city", "c")] * 10
    got = mined(C.mine_phrases(spark.createDataFrame(rows, "text string, lang string")))
    assert got == plain(rows)
    assert got["b", "new york"][0] == 23 and ("b", "york city") not in got and ("c", "new york") not in got
    assert got["a", "ha ha ha"][:3] == (40 * 498, 40 * 500, 40 * 499) and ("a", "ha ha") not in got


def test_score_of_large_counts(spark):
    a, left, right = 10**13 + 3, 3 * 10**13 + 7, 2 * 10**13 + 1
    row = spark.range(1).selectExpr(
        f"1000000BD * cast({a} as decimal(14, 0)) * cast({a} as decimal(14, 0))"
        f" div (cast({left} as decimal(14, 0)) * cast({right} as decimal(14, 0))) as score"
    )
    assert row.collect()[0]["score"] == 1000000 * a * a // (left * right)


def test_ranks_and_ties(spark):
    rows = [("b c", "x")] * 10 + [("a z", "x")] * 10 + [("é f", "x")] * 10 + [("q r", "x")] * 11
    ranked = best_phrases(C.mine_phrases(spark.createDataFrame(rows, "text string, lang string")), 3).collect()
    assert [(r["rank"], r["phrase"]) for r in sorted(ranked, key=lambda r: r["rank"])] == [(1, "q r"), (2, "a z"), (3, "b c")]


def test_empty_tables_names_and_long_texts(spark):
    assert C.mine_phrases(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert C.mine_phrases(spark.createDataFrame([("one two", "a")], "text string, lang string")).count() == 0
    odd = spark.createDataFrame([("k", "One two " * 300_000, 3)], "phrase string, score string, text int")
    got = mined(C.mine_phrases(odd, text="score", lang="phrase", longest=2))
    assert got == plain([("one two " * 300_000, "k")], 2)


def test_positions_part_pieces():
    words, at, code = C.occurrences(pa.array(["a b.c  d", None, "e", "\tA"]))
    assert [words[i].as_py() for i in code] == ["a", "b", "c", "d", "e", "a"]
    assert at[1] == at[0] + 1 and at[2] > at[1] + 1 and at[3] == at[2] + 1 and at[4] > at[3] + 1 and at[5] > at[4] + 1
