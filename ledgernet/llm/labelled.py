"""Labelled documents, from which models are learned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgernet.llm.columns import field


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """(``key``, ``label``) of the documents with a text and a label 0 or 1, each pair once; texts do not move."""
    here = docs.where(field(docs, text).isNotNull()).select(field(docs, key).alias("key"))
    given = labels.select(field(labels, key).alias("key"), field(labels, label).cast("int").alias("label"))
    return here.join(given.where("label in (0, 1)"), "key").distinct()
