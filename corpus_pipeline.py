"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but
the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgernet.llm.columns import field, free_name
from ledgernet.llm.decontamination import find_passages
from ledgernet.llm.language_id import identify, learn_languages
from ledgernet.llm.minhash import near_duplicates
from ledgernet.llm.packing import pack
from ledgernet.llm.queries import table, word_tokenizer
from ledgernet.llm.shared import kept
from ledgernet.llm.toxicity import learn_toxicity, score_toxicity


def _same(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows with the columns of ``docs`` only."""
    return rows.select(*(field(rows, name) for name in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from those of them with a label, does not call toxic.

    Null and empty texts stay. Without labels of both kinds the classifier has nothing to
    tell apart and calls every text by the one kind there is, not toxic if there is none.
    """
    scored = score_toxicity(docs, learn_toxicity(docs, table(spark, sf_dir, "labels")))
    return _same(docs, scored.where(~F.col(scored.columns[-1])))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the documents themselves name.

    Rejected are texts of no language: null ones and those without a letter. Without any
    named language every document is rejected.
    """
    told = identify(docs, learn_languages(docs))
    return _same(docs, told.where(F.col(told.columns[-2]) != "und"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group that shares four fifths of its five-word shingles.

    Repeated rows are copies: one stays. Texts without words and rows without an id are in
    no group and stay.
    """
    mark = free_name(docs, "text_hash")
    found = near_duplicates(docs, size=5)
    winners = found.where("kept and doc_id is not null").select("doc_id", F.col("text_hash").alias(mark)).distinct()
    marked = docs.withColumn(mark, F.xxhash64("text"))
    chosen = marked.join(winners, ["doc_id", mark]).dropDuplicates(["doc_id", mark])
    return _same(docs, chosen).unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in 13-word passages of benchmark items."""
    marked = find_passages(docs, table(spark, sf_dir, "benchmark"))
    hit = F.col(marked.columns[-1])
    return _same(docs, marked.where(~((hit["n_hit"] > 0) & (20 * hit["n_hit"] >= hit["n_words"]))))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens, with their token ids."""
    return pack(docs, word_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The stages learn models and cannot be put in SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of all documents; what each stage returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
