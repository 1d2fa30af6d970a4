"""Shards that all match the mixture of sources: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgernet.llm.columns import field, free_name

#: Pieces into which the order of a source, and that of all rows, is cut to rank them in parallel.
PIECES_LOG2 = 14
PIECES = 1 << PIECES_LOG2


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def interleave(df: DataFrame, *, source: str = "source", n_shards: int = 8, seed: int = 20) -> DataFrame:
    """The rows with ``shard`` (int) and ``slot`` (long, gapless from 0 within the shard).

    Rows are shuffled by a seeded hash within each source and ranked there. A row's place in
    its source as a fraction, shifted by an offset of its source so that small sources
    spread out, orders all rows; equal cuts of that order are the shards. Shard sizes differ
    by at most one, and so do a source's rows in any two shards, but for the rounding where
    a cut falls between them.

    Ranks are exact and no task sees a whole source: hash ranges of a source are ranked
    apart and moved by the counts of the ranges before, and so are ranges of the fraction.

    A null source is a source of its own. Repeated rows are kept; among rows equal in all
    columns it is open which takes which slot. An empty table gives an empty one. The new
    columns get underscores behind their names where those are taken.
    """
    shard, slot = free_name(df, "shard"), free_name(df, "slot")
    content = [field(df, f.name) for f in df.schema.fields if _hashable(f.dataType)]
    origin = field(df, source)
    # All further columns live beside one struct, so that no name of the input can clash.
    rows = df.select(
        F.struct(*[field(df, c) for c in df.columns]).alias("row"),
        origin.alias("source"),
        F.xxhash64(F.lit(seed), *content).alias("h1"),
        F.xxhash64(F.lit(seed + 1), *content).alias("h2"),
    ).withColumn("piece", F.shiftrightunsigned("h1", 64 - PIECES_LOG2))

    by_source = Window.partitionBy("source")
    before = by_source.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("source", "piece")
        .agg(F.count("*").alias("n"))
        .select(
            F.col("source").alias("of_source"),
            F.col("piece").alias("of_piece"),
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
            F.sum("n").over(by_source).alias("total"),
        )
    )
    in_piece = Window.partitionBy("source", "piece").orderBy("h1", "h2")
    offset = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 2), "source"), 12) / F.lit(float(1 << 52))
    placed = (
        rows.withColumn("rank", F.row_number().over(in_piece))
        .join(starts, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("piece") == F.col("of_piece")))
        .withColumn("fraction", (F.col("start") + F.col("rank") - 1 + offset) / F.col("total"))
        .select("row", "h1", "h2", "fraction")
        .withColumn("part", F.least(F.floor(F.col("fraction") * PIECES), F.lit(PIECES - 1)))
    )
    # At most PIECES rows: one task orders them, and every task may hold them.
    counted = placed.groupBy("part").agg(F.count("*").alias("n"))
    everything = Window.partitionBy(F.lit(0))
    parts = counted.select(
        F.col("part").alias("of_part"),
        F.coalesce(F.sum("n").over(everything.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
        F.sum("n").over(everything).alias("total"),
    )
    in_part = Window.partitionBy("part").orderBy("fraction", "h1", "h2")
    at = F.expr(f"(position * {n_shards}L) div total")
    return (
        placed.withColumn("rank", F.row_number().over(in_part))
        .join(F.broadcast(parts), F.col("part") == F.col("of_part"))
        .withColumn("position", F.col("start") + F.col("rank") - 1)
        .withColumn("cut", at)
        .select(
            "row.*",
            F.col("cut").cast("int").alias(shard),
            (F.col("position") - F.expr(f"(cut * total + {n_shards - 1}L) div {n_shards}L")).alias(slot),
        )
    )
