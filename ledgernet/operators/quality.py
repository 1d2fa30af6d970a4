"""Record validation, de-duplication and data-quality counters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ledgernet.functions.amounts import parse_amount


class Checks(NamedTuple):
    """``valid`` says whether a row passes; ``errors`` names the rules a row breaks.

    ``valid`` alone decides on all rows, ``errors`` is worked out for rejected ones.
    """

    valid: Column
    errors: Column


def commitment_checks(amount: Column | None = None) -> Checks:
    """Checks of raw commitments; ``amount`` is the parsed amount where a column has it."""
    amount = parse_amount(F.col("valor_empenhado")) if amount is None else amount
    return Checks(
        F.col("id").isNotNull() & (F.coalesce(amount, F.lit(-1.0)) >= 0),
        _broken(
            (F.col("id").isNull(), "missing_id"),
            (amount.isNull(), "bad_amount"),
            (amount < 0, "negative_amount"),
        ),
    )


def dimension_checks() -> Checks:
    """Checks of raw suppliers and agencies."""
    return Checks(F.col("id").isNotNull(), _broken((F.col("id").isNull(), "missing_id")))


def _broken(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in rules]))


def split_valid(raw: DataFrame, checks: Checks) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejected rows with their ``errors``."""
    return raw.where(checks.valid), raw.where(~checks.valid).withColumn("errors", checks.errors)


def require_valid(raw: DataFrame, checks: Checks, kind: str) -> DataFrame:
    """The same rows; the job fails at the first row that breaks a rule."""
    message = F.concat(F.lit(f"invalid record in {kind}: "), F.array_join(checks.errors, ", "))
    return raw.where(F.when(checks.valid, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def validate(raw: DataFrame, checks: Checks, kind: str, mode: str = "strict") -> DataFrame:
    """Valid rows of a collection: ``strict`` fails on a bad row, ``quarantine`` leaves it out."""
    if mode == "strict":
        return require_valid(raw, checks, kind)
    if mode == "quarantine":
        return split_valid(raw, checks)[0]
    raise ValueError(f"unknown validation mode {mode!r}")


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of every key in the given order.

    ``order`` should be total, so that the kept row does not depend on partitioning.
    Spark limits each key to one row before the shuffle, so a key with very many
    copies costs one row per map task.
    """
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_copy", F.row_number().over(first)).where("_copy = 1").drop("_copy")


def drop_negative(df: DataFrame, amount: str = "valor_empenhado", seen: Observation | None = None) -> DataFrame:
    """Drop rows with a negative amount; ``seen`` receives how many, at no extra pass."""
    negative = F.coalesce(F.col(amount), F.lit(0.0)) < 0
    if seen is not None:
        df = df.observe(seen, F.count_if(negative).alias("dropped_negative"))
    return df.where(~negative)


def judge(
    raw: DataFrame, checks: Checks, kind: str, mode: str = "strict", parsed: dict[str, Column] | None = None
) -> DataFrame:
    """Every row with the ``errors`` it makes (none for valid rows) and the ``parsed`` columns.

    ``checks`` may name the parsed columns, so that nothing is parsed twice. ``strict`` fails
    on a bad row, ``quarantine`` keeps it beside the others.
    """
    if mode not in ("strict", "quarantine"):
        raise ValueError(f"unknown validation mode {mode!r}")
    errors = checks.errors
    if mode == "strict":
        message = F.concat(F.lit(f"invalid record in {kind}: "), F.array_join(errors, ", "))
        errors = F.when(F.size(errors) > 0, F.raise_error(message).cast("array<string>")).otherwise(errors)
    return raw.withColumns(parsed or {}).withColumn("errors", errors)


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that several rows have, with how many (``copies``): counts, added up before the shuffle."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def without_repeats(df: DataFrame, repeated: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """``dedup_first`` where the ``repeated_keys`` are known: rows of other keys are neither sorted nor gathered.

    A null key equals another null key.
    """
    named = [F.col(c).alias(f"_{c}") for c in keys]
    again = repeated.select(*named)
    same = reduce(Column.__and__, [df[c].eqNullSafe(again[f"_{c}"]) for c in keys])
    return df.join(again, same, "left_anti").unionByName(dedup_first(df.join(again, same, "left_semi"), keys, order))


def quality_report(
    df: DataFrame, kind: str, keys: Sequence[str], order: Sequence[str], amount: str | None = None
) -> DataFrame:
    """Counters ``(kind, row_count, duplicates, negatives)``; negatives count kept rows only."""
    value = F.col(amount) if amount else F.lit(None).cast("double")
    first = F.min(F.struct(*order, value.alias("_amount")))
    per_key = df.groupBy(*keys).agg(F.count("*").alias("copies"), first["_amount"].alias("_amount"))
    return per_key.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"),
        F.count_if(F.col("_amount") < 0).alias("negatives"),
    ).select(F.lit(kind).alias("kind"), "row_count", "duplicates", "negatives")
