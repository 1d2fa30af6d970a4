import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from ledgernet.llm.queries import QUERIES  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_take_an_empty_table(spark, stage):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    got = stage[1](spark, docs, SMALL)
    assert got.count() == 0
    assert stage[0] == "packing" or got.columns == docs.columns


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into and comes out of each stage, over documents with planted cases."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy(F.length("text").desc()).first()["text"]
    whole = " ".join(f"word{i}" for i in range(100))
    planted = [(-1, None), (-2, ""), (-3, "12 34 ..."), (-4, whole), (-5, whole + " more"), (-6, item), (-4, whole), (None, "no id here")]
    more = spark.createDataFrame([(i, t, "en", None, None) for i, t in planted], docs.schema)
    docs = docs.unionByName(more).withColumn("text_hash", F.lit("mine"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.kept(stage(spark, docs, SMALL), name)
        seen.append((name, docs, out))
        docs = out
    return {name: (given, out) for name, given, out in seen}


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=lambda x: (x is None, x))


def test_stages_keep_the_columns(stages):
    for given, out in list(stages.values())[:-1]:
        assert out.columns == given.columns and out.count() <= given.count()


def test_toxicity_drops_most_labelled_documents_and_few_others(spark, stages):
    given, out = stages["toxicity"]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    left = labels.join(out, "doc_id", "left_semi").groupBy("toxic").count().collect()
    whole = dict(labels.groupBy("toxic").count().collect())
    left = {r["toxic"]: r["count"] for r in left}
    assert left.get(1, 0) <= 0.2 * whole[1] and left[0] >= 0.95 * whole[0]


def test_language_drops_texts_without_letters_only(stages):
    given, out = stages["language_id"]
    assert set(ids(given)) - set(ids(out)) == {-1, -2, -3}


def test_one_of_each_group_stays(stages):
    given, out = stages["near_dedup"]
    left = ids(out)
    assert len(left) == len(set(left)) and -5 in left and -4 not in left and None in left


def test_benchmark_passages_go(stages):
    given, out = stages["decontamination"]
    assert -6 in ids(given) and -6 not in ids(out)


def test_everything_left_is_packed(stages):
    given, out = stages["packing"]
    whole = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"))
    assert ids(whole) == ids(given) and whole.where("n != m").count() == 0
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
