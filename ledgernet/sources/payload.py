"""Payload documents: one JSON object with the three raw collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgernet import schema as S
from ledgernet.functions.text import written_text
from ledgernet.operators.normalize import Collections

PAYLOAD = T.StructType(
    [T.StructField(name, T.ArrayType(S.as_written(record, "id"))) for name, record in S.RAW_COLLECTIONS.items()]
)


def scan_payloads(spark: SparkSession, path: str, one_per_line: bool = False) -> Collections:
    """Collections of all payload documents under ``path``.

    A file holds one document, or one per line, which lets Spark split large files.
    ``position`` (file, place in the collection) keeps the order of arrival; a file
    that is no JSON object with collections fails the read. An id that is no text counts
    as missing.
    """
    documents = (
        spark.read.schema(PAYLOAD)
        .options(multiLine=not one_per_line, mode="FAILFAST")
        .json(path)
        .select(
            *S.RAW_COLLECTIONS,
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
        )
    )
    return Collections(*[_rows(documents, name) for name in S.RAW_COLLECTIONS])


def _rows(documents: DataFrame, name: str) -> DataFrame:
    place = F.struct("_file", "_block", "_pos").alias("position")
    rows = documents.select("_file", "_block", F.posexplode(name).alias("_pos", "_row"))
    return rows.select("_row.*", place).withColumn("id", written_text(F.col("id")))


def collections_of(spark: SparkSession, payload: dict) -> Collections:
    """Collections of a small payload given as Python lists, such as the sample."""
    frames = []
    for name, record in S.RAW_COLLECTIONS.items():
        rows = [
            tuple(None if row.get(f.name) is None else str(row[f.name]) for f in record) + (place,)
            for place, row in enumerate(payload.get(name) or [])
        ]
        positioned = T.StructType([*record.fields, T.StructField("position", T.LongType())])
        frames.append(spark.createDataFrame(rows, positioned))
    return Collections(*frames)
