"""Numbers in place of ids: places in their order, so that what compares ids may compare numbers."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgernet.sources.workspace import cut_lineage


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """The rows, stored, with ``number``: their places from 0 in the order of ``key``."""
    # A stored partition is a range of keys, sorted. One number per partition reaches the driver.
    ordered = cut_lineage(rows.repartitionByRange(key).sortWithinPartitions(key))
    sizes = dict(ordered.groupBy(F.spark_partition_id()).count().collect())
    before = [0, *accumulate(sizes.get(i, 0) for i in range(max(sizes, default=0)))]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    start = F.array(*[F.lit(n).cast("long") for n in before])[F.spark_partition_id()]
    return cut_lineage(ordered.withColumn("number", start + place))


def named(table: DataFrame, numbers: DataFrame, *columns: str) -> DataFrame:
    """The table with the ids of ``numbers(id, number)`` in place of the numbers in ``columns``."""
    for column in columns:
        of_id = numbers.select(F.col("number").alias(column), F.col("id").alias("_id"))
        table = table.join(of_id, column).withColumn(column, F.col("_id")).drop("_id")
    return table
