"""The language model, the toxicity and the quality classifier."""

import math
import os
import random
import resource
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgernet.llm import kneser_ney
from ledgernet.llm import toxicity as tox
from ledgernet.llm.kneser_ney import discounts_of, learn_language, packed, score_language, unpacked
from ledgernet.llm.quality import FEATURES, features, learn_quality, preferences, score_quality
from ledgernet.llm.toxicity import learn_toxicity, score_toxicity, threshold


def sentences(n, seed):
    rng = random.Random(seed)
    some = [f"w{int(rng.paretovariate(0.8))}" for _ in range(300)]
    return [" ".join(rng.choice(some) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def by_definition(train):
    """Log10 probability of a text by a bigram model with modified Kneser-Ney discounts."""
    pairs, words = Counter(), Counter()
    for text in train:
        tokens = text.split() + [None]
        words.update(tokens)
        pairs.update(zip(["<s>", *tokens], tokens))
    seen, follow, types = Counter(), defaultdict(lambda: [0, 0, 0]), Counter()
    for (context, word), n in pairs.items():
        seen[context] += n
        follow[context][min(n, 3) - 1] += 1
        types[word] += 1
    times, spread = Counter(pairs.values()), Counter(types.values())
    d = discounts_of(*(times[k] for k in (1, 2, 3, 4)))
    e = discounts_of(*(spread[k] for k in (1, 2, 3, 4)))
    off = lambda n, d: d[min(n, 3) - 1] if n else 0
    rest = (e[0] * spread[1] + e[1] * spread[2] + e[2] * sum(v for k, v in spread.items() if k > 2)) / max(1, len(pairs))

    def unigram(word):
        if not pairs:
            return 1.0
        return (types[word] - off(types[word], e)) / len(pairs) + rest / (len(words) + 1)

    def share(context, word):
        if not seen[context]:
            return unigram(word)
        n = pairs[context, word]
        return (n - off(n, d) + sum(a * b for a, b in zip(d, follow[context])) * unigram(word)) / seen[context]

    return words, share


@pytest.mark.parametrize("n", [60, 1, 0])
def test_scores_match_the_definition(spark, n):
    train, asked = sentences(n, 1), sentences(20, 2) + ["", "Unseen words here", "W1 w1\tw1\n"]
    model = learn_language(spark.createDataFrame([(t,) for t in train], "text string"))
    words, share = by_definition(train)
    assert model.tokens == sum(words.values()) and model.vocabulary == len(words)
    df = spark.createDataFrame([(t,) for t in asked] + [(None,)], "text string").withColumn("lm_score", F.lit(0))
    for r in score_language(df, model).collect():
        tokens = (r["text"] or "").lower().split() + [None]
        assert r["lm_tokens"] == len(tokens) and r["lm_known"] == sum(words[t] > 0 for t in tokens)
        base = sum(math.log10((words[t] + 0.1) / (model.tokens + 0.1 * (len(words) + 1))) for t in tokens)
        score = sum(math.log10(share(c, t)) for c, t in zip(["<s>", *tokens], tokens))
        assert r["lm_base"] == pytest.approx(base, abs=1e-9) and r["lm_score_"] == pytest.approx(score, abs=1e-9)
    if n > 1:
        assert sum(share("<s>", w) for w in words) + share("<s>", "nobody") == pytest.approx(1)


def test_many_shards_need_few_files_and_handles(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "SHARD_BYTES", 3)
    train = sentences(80, 5)
    model = learn_language(spark.createDataFrame([(t,) for t in train + train[:9]], "text string"))
    assert 1 << model.layout.bits >= 2000
    files = [f for _, _, names in os.walk(model.folder) for f in names]
    assert 2 << (model.layout.bits - model.layout.shared_bits) >= len(files) > kneser_ney.MAPPED
    words, share = by_definition(train + train[:9])
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    asked = train[:20] + [" ".join(train)]  # A long text asks all shards.
    arrays = kneser_ney.Arrays(model)
    try:
        resource.setrlimit(resource.RLIMIT_NOFILE, (256, hard))
        scores = kneser_ney.score_batch(arrays, pa.array(asked))[3]
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))
    assert len(arrays.maps.open) <= kneser_ney.MAPPED
    for text, score in zip(asked, scores):
        tokens = text.lower().split() + [None]
        assert score == pytest.approx(sum(math.log10(share(c, t)) for c, t in zip(["<s>", *tokens], tokens)), abs=1e-6)


def test_packed_columns_come_back():
    a = np.sort(np.random.default_rng(1).integers(0, 2**63, 50).astype(np.uint64))
    b = np.arange(50, dtype=np.uint32)
    for x, y in zip(unpacked(packed(a, b), np.uint64, np.uint32), (a, b)):
        assert (x == y).all()


BAD = ["vile", "rotten", "scorn"]
ABEL = ["arg", "pfui"]


def said(seed, n=400):
    """(id, text, lang, toxic): bad words, other ones in each language, make a text toxic."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        plain = [f"{lang}{rng.randint(0, 4000)}" for _ in range(rng.randint(3, 80))] + [lang] * 5
        toxic = int(rng.random() < 0.25)
        for _ in range(3 * toxic):
            plain.insert(rng.randrange(len(plain)), rng.choice(BAD if lang == "en" else ABEL) + rng.choice(["", ".", "!"]))
        out.append((i, " ".join(plain), lang, toxic))
    return out


def test_stored_words_are_taken_some_at_a_time(monkeypatch):
    monkeypatch.setattr(tox, "TOGETHER", 10)
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 9, n).tolist() for n in (4, 0, 25, 3, 3, 3, 9, 1)]
    batch = pa.record_batch([pa.array(texts, pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.int32()))], ["bare", "stem"])
    some = list(tox._some_words([batch]))
    assert [x for part in some for x in part.column("bare").to_pylist()] == texts
    assert all(part.num_rows == 1 or sum(map(len, part.column("bare").to_pylist()[1:])) <= 10 for part in some) and len(some) > 3
    tokens, bounds = tox._stored_tokens(batch)
    kinds, codes = tox.distinct_words(tokens)
    assert (kinds[codes] == tokens).all() and len(kinds) == len(np.unique(tokens, axis=0))
    assert bounds.tolist() == np.cumsum([0, *map(len, texts)]).tolist()


def test_toxic_words_are_learned_and_whole_texts_read(spark):
    given = spark.createDataFrame(said(1), "doc_id long, text string, lang string, toxic int")
    model = learn_toxicity(given.drop("toxic"), given.select("doc_id", "toxic"))
    df = spark.createDataFrame(said(2, 200), "doc_id long, text string, toxicity string, toxic int")
    rows = score_toxicity(df, model).collect()
    assert rows[0].__fields__ == ["doc_id", "text", "toxicity", "toxic", "toxicity_", "is_toxic"]
    assert np.mean([r["is_toxic"] == bool(r["toxic"]) for r in rows]) > 0.95
    long = "en " * 100_000
    odd = spark.createDataFrame([(1, None), (2, ""), (3, long), (4, long + "vile rotten scorn"), (4, long)], "doc_id long, text string")
    got = [(r["doc_id"], r["is_toxic"]) for r in score_toxicity(odd, model).collect()]
    assert sorted(got) == [(1, False), (2, False), (3, False), (4, False), (4, True)]
    assert score_toxicity(odd.limit(0), model).count() == 0


def test_toxicity_is_counted_over_all_rows(spark, monkeypatch):
    from ledgernet.llm import toxicity

    monkeypatch.setattr(toxicity, "FEW", 100)
    rows = spark.createDataFrame(said(3, 3500), "doc_id long, text string, lang string, toxic int")
    model = learn_toxicity(rows.repartition(4), rows)
    words = sum(len(r[1].split()) for r in said(3, 3500))
    shares = np.exp(model.voices.astype(float))
    # The smallest share is that of a row without a word.
    totals = [0.05 / s.min() - 0.05 * len(s) for s in shares]
    assert sum(totals) == pytest.approx(words, rel=1e-3)
    asked = spark.createDataFrame(said(2, 200), "doc_id long, text string, lang string, toxic int")
    assert np.mean([r["is_toxic"] == bool(r["toxic"]) for r in score_toxicity(asked, model).collect()]) > 0.95


def test_toxicity_without_two_classes(spark):
    rows = spark.createDataFrame([(1, "a b", None, 0), (2, None, "en", 1)], "doc_id long, text string, lang string, toxic int")
    for given in (rows, rows.limit(0)):
        assert not score_toxicity(rows, learn_toxicity(given, given)).first()["is_toxic"]


def test_threshold_lies_in_the_gap():
    assert threshold(np.array([0.0, 1.0, 3.0, 4.0]), np.array([0.0, 0, 1, 1]), 9.0, 0.0) == 2.0
    assert threshold(np.array([1.0]), np.array([1.0]), 9.0, 5.0) == 9.0


def rated(seed, n=300):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(4, 90))]
        good = int(rng.random() < 0.8)
        if not good:
            kind = rng.randrange(3)
            words = [words[0]] * 40 if kind == 0 else [w.upper() + "!!" for w in words] if kind == 1 else [w + rng.choice(["***", "$$$"]) for w in words]
        out.append((i, " ".join(words) + ".", good))
    return out


def test_quality_is_learned_from_preferences(spark):
    given = spark.createDataFrame(rated(1), "doc_id long, text string, quality int")
    model = learn_quality(given, given.unionAll(given))
    assert len(model.edges) == len(FEATURES)
    df = spark.createDataFrame(rated(2), "doc_id long, text string, quality int").withColumn("quality_score", F.lit(1))
    rows = score_quality(df, model).collect()
    assert rows[0].__fields__ == ["doc_id", "text", "quality", "quality_score", "quality_score_", "is_good"]
    assert np.mean([r["is_good"] == bool(r["quality"]) for r in rows]) > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x " * 200_000), (3, "x"), (None, "\n\n")], "doc_id long, text string")
    assert score_quality(odd, model).where("quality_score between 0 and 1").count() == 5
    assert score_quality(odd.limit(0), model).count() == 0


def test_quality_is_learned_from_all_rows(spark):
    rng = random.Random(4)
    texts = [" ".join(["ab"] * rng.randint(4, 60000 if i % 50 == 0 else 90)) for i in range(6500)]
    given = spark.createDataFrame([(i, t, int(i % 100 > 0)) for i, t in enumerate(texts)], "doc_id long, text string, quality int")
    model = learn_quality(given, given)
    lengths = features(pa.array([t for i, t in enumerate(texts) if i % 100]))[:, 0]
    quantiles = np.quantile(lengths, np.linspace(0, 1, 25)[1:-1], method="inverted_cdf")
    assert set(quantiles) <= set(model.edges[0])
    pairs = preferences(given.selectExpr("doc_id mark", "quality label", "array(double(doc_id)) features"), {0: 65, 1: 6435}).collect()
    assert {r["better"][0] for r in pairs} | {r["worse"][0] for r in pairs} == set(range(6500))


def test_quality_without_labels(spark):
    rows = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, quality int")
    assert 0 <= score_quality(rows, learn_quality(rows, rows)).first()["quality_score"] <= 1
