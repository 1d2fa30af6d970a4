"""Landed pages of paged collections: one JSON envelope per page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgernet import schema as S
from ledgernet.functions.text import truthy_text, written_text

#: Amounts of state records, of which the second counts where the first is absent or the number zero.
_AMOUNTS = ("Empenho", "Empenhado")


def scan_pages(
    spark: SparkSession,
    path: str,
    record: T.StructType,
    data_key: str = "data",
    max_pages: int | None = None,
    full_page: int = 1,
) -> DataFrame:
    """Records of a paged collection in page order, with ``position`` (page, place).

    Envelopes are JSON lines with the records under ``data_key`` and the page number,
    from 1, in ``page``: a field of the envelope or a ``page=N`` folder. Reading stops
    after the first page of fewer than ``full_page`` records, so with 1 at the first
    empty page, and after ``max_pages``. A page that is read and lacks the key fails, and so
    does any line that cannot be read or has no page number. An id that is no text counts
    as missing.
    """
    record = S.as_written(record, "id", *_AMOUNTS)
    envelope = T.StructType([T.StructField("page", T.LongType()), T.StructField(data_key, T.ArrayType(record))])
    pages = spark.read.schema(envelope).option("mode", "FAILFAST").json(path).withColumnRenamed(data_key, "_data")
    unnumbered = F.raise_error(F.lit("page without number")).cast("long")
    pages = pages.withColumn("page", F.coalesce("page", unnumbered))
    if max_pages:
        pages = pages.where(F.col("page") <= max_pages)
    # size() of a missing key is null, so such a page does not count as the last one.
    size = F.when(F.col("_data").isNotNull(), F.size("_data"))
    last = pages.where(size < full_page).agg(F.min("page").alias("last")).scalar()
    missing = F.raise_error(F.lit(f"page without '{data_key}'")).cast(T.ArrayType(record))
    read = pages.where(last.isNull() | (F.col("page") <= last)).withColumn("_data", F.coalesce("_data", missing))
    rows = read.select("page", F.posexplode("_data").alias("_pos", "_row")).select(
        "_row.*", F.struct("page", "_pos").alias("position")
    )
    kinds = {"id": written_text, **dict.fromkeys(_AMOUNTS, truthy_text)}
    return rows.withColumns({name: kinds[name](F.col(name)) for name in record.names if name in kinds})


def scan_offset_pages(
    spark: SparkSession,
    path: str,
    record: T.StructType,
    limit: int,
    data_key: str,
    max_pages: int | None = None,
) -> DataFrame:
    """As ``scan_pages`` for offset paging, where a page shorter than ``limit`` is the last."""
    return scan_pages(spark, path, record, data_key, max_pages, full_page=limit)


def scan_commitments(spark: SparkSession, path: str, **options) -> DataFrame:
    return scan_pages(spark, path, S.RAW_COMMITMENT, **options)


def scan_suppliers(spark: SparkSession, path: str, **options) -> DataFrame:
    return scan_pages(spark, path, S.RAW_SUPPLIER, **options)


def scan_agencies(spark: SparkSession, path: str, **options) -> DataFrame:
    return scan_pages(spark, path, S.RAW_AGENCY, **options)


def scan_state_records(spark: SparkSession, path: str, limit: int = 100, **options) -> DataFrame:
    """Flat state records, landed by offset under the key ``Empenhos``."""
    return scan_offset_pages(spark, path, S.STATE_RECORD, limit, "Empenhos", **options)
