"""Connected components of a graph of links, by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgernet.sources.workspace import delete_path, scratch_path


def components(links: DataFrame, *, rounds: int = 100) -> DataFrame:
    """(``id``, ``component``): the smallest id that each end of a link reaches.

    ``links`` has columns ``a`` and ``b``. Union-find in rounds: each node hangs its
    neighbours on the smallest one it sees, larger neighbours first and then smaller ones,
    until nothing moves; the rounds grow with the logarithm of the longest path. A node's
    smallest neighbour is a partial aggregate, so a hub is never gathered in one task. Each
    round is written to the shared folder, which cuts the lineage, and the round before it
    is deleted.
    """
    spark = links.sparkSession

    def write(table: DataFrame) -> tuple[str, DataFrame]:
        path = scratch_path(spark, "links")
        table.write.parquet(path)
        return path, spark.read.schema(table.schema).parquet(path)

    path, edges = write(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    state = None
    for _ in range(rounds):
        # Larger neighbours, seen from both ends, go to the smallest neighbour.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.distinct()
        # Smaller neighbours and the node itself go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b"))
        old = path
        path, edges = write(small.where(F.col("a") != F.col("b")).distinct())
        delete_path(spark, old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            )
        state = now
    raise RuntimeError(f"links did not settle in {rounds} rounds")
