"""Robust statistics of node metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgernet.functions.amounts import finite
from ledgernet.functions.severity import floored
from ledgernet.operators.selection import MEDIAN_RANKS, exact_median, order_statistics

# The fourth quintile by the exclusive rule: position 4(n+1)/5 between two ranks.
_P80_RANKS = {
    "_p80_low": lambda n: max(min(4 * (n + 1) // 5, n - 1), 1),
    "_p80_high": lambda n: max(min(4 * (n + 1) // 5, n - 1), 1) + 1,
}


def median_and_mad(values: DataFrame, group: str, value: str, **options) -> DataFrame:
    """``(group, median, mad)`` over the finite values; a zero MAD takes the floor.

    ``values`` is read several times: pass a stored table.
    """
    sample = values.select(group, finite(F.col(value)).alias("v")).where("v is not null")
    median = exact_median(sample, group, "v", **options)
    deviations = sample.join(F.broadcast(median), group).select(group, F.abs(F.col("v") - F.col("median")).alias("v"))
    mad = exact_median(deviations, group, "v", name="mad", **options)
    return median.drop("n").join(mad.drop("n"), group).withColumn("mad", floored(F.col("mad")))


def robust_stats(values: DataFrame, group: str, value: str, **options) -> DataFrame:
    """``(group, n, median, mad, mean, stdev, p80)``; an empty sample counts as a single 0.0.

    Below five values the p80 is the maximum.
    """
    # A group with no finite value keeps one row, holding 0.0.
    clean = finite(F.col(value))
    groups = values.groupBy(group).agg(F.count(clean).alias("n"))
    blanks = groups.where("n = 0").select(group, F.lit(0.0).alias("v"))
    sample = values.select(group, clean.alias("v")).where("v is not null").unionByName(blanks)

    moments = sample.groupBy(group).agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("stdev"), F.max("v").alias("top")
    )
    picked = order_statistics(sample, group, "v", {**MEDIAN_RANKS, **_P80_RANKS}, **options)
    n = F.col("n")
    share = 4 * (n + 1) - 5 * F.greatest(F.least(F.floor(4 * (n + 1) / 5), n - 1), F.lit(1))
    p80 = (F.col("_p80_low") * (5 - share) + F.col("_p80_high") * share) / 5
    centred = picked.withColumn("median", (F.col("_below") + F.col("_above")) / 2)
    deviations = sample.join(F.broadcast(centred), group).select(
        group, F.abs(F.col("v") - F.col("median")).alias("v")
    )
    mad = exact_median(deviations, group, "v", name="mad", **options).drop("n")
    return (
        centred.join(moments, group)
        .join(mad, group)
        .select(
            group,
            "n",
            "median",
            floored(F.col("mad")).alias("mad"),
            "mean",
            floored(F.col("stdev")).alias("stdev"),
            F.when(n >= 5, p80).otherwise(F.col("top")).alias("p80"),
        )
    )
