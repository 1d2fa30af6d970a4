"""Exact order statistics of large groups without sorting a group in one task.

Spark's exact percentile keeps every distinct value of a group in one buffer. Here a
quantile sketch of each group, merged from partial ones, brackets a wanted rank in the
first scan; the second counts what lies below the bracket and its values one by one, which
settles the rank exactly or shows that the bracket missed it. A scan returns a row per
group and rank to the driver, whatever the size of the data.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Size of a sketch: its ranks are right to a share of about 0.0013.
SKETCH = 4096
#: Ranks a sketch is asked for, evenly apart.
GRID = 1024
#: Share of a group by which a bracket reaches beyond the rank on both sides.
MARGIN = 0.002
#: A bracket that holds more values is sketched once more before its values are counted.
COUNTED = 1_000_000


class Found(NamedTuple):
    """The value at a rank, how many values of the group are smaller, and how many equal it."""

    value: Any
    below: int
    equal: int


class _Bracket(NamedTuple):
    group: Any
    low: Any
    high: Any


def _literal(entries: Collection[tuple], *names: str) -> Column:
    # A handful of brackets and ranks: literals, so that a scan is one job without joins.
    return F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, entry)]) for entry in entries])


def located(
    rows: DataFrame,
    wanted: Callable[[dict], Collection[tuple[Any, int]]],
    *,
    sketch: int = SKETCH,
    margin: float = MARGIN,
    counted: int = COUNTED,
) -> tuple[dict, dict[tuple[Any, int], Found]]:
    """Sizes of the groups of ``rows(g, v)`` and the value at each ``(group, rank)`` of ``wanted(sizes)``.

    ``v`` is a finite double or a long and not null, ``g`` of low cardinality; ranks count
    from 1 to the group's size. Two scans of ``rows`` are enough unless a bracket holds more
    than ``counted`` values or misses its rank; each further scan narrows or moves it.
    """
    whole = isinstance(rows.schema["v"].dataType, T.LongType)
    summary = F.kll_sketch_agg_bigint if whole else F.kll_sketch_agg_double
    quantile = F.kll_sketch_get_quantile_bigint if whole else F.kll_sketch_get_quantile_double
    # The functions want constants.
    ranks = F.expr("array(" + ",".join(f"{i}D/{GRID}" for i in range(GRID + 1)) + ")")

    def grid(value: Column) -> Column:
        return quantile(summary(value, F.lit(sketch)), ranks).alias("grid")

    def narrowed(group: Any, values: list, rank: int, n: int) -> tuple[_Bracket, float]:
        """The bracket of a rank among ``n`` sketched values, and about how many of them it holds."""
        low = min(max(int((rank / n - margin) * GRID) - 1, 0), GRID)
        high = max(min(int((rank / n + margin) * GRID) + 2, GRID), low)
        return _Bracket(group, values[low], values[high]), n * (high - low) / GRID

    spans = {
        row["g"]: row
        for row in rows.groupBy("g")
        .agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), grid(F.col("v")))
        .collect()
    }
    sizes = {g: row["n"] for g, row in spans.items()}
    held = {(g, r): narrowed(g, spans[g]["grid"], r, sizes[g]) for g, r in wanted(sizes)}
    found: dict[tuple[Any, int], Found] = {}

    def reached(targets: Collection[tuple]) -> DataFrame:
        """Each value up to a bracket's upper end with the bracket; ranks that share one share the rows."""
        brackets = _literal(sorted({held[t][0] for t in targets}), "g", "low", "high")
        of_row = F.filter(brackets, lambda b: b["g"].eqNullSafe(F.col("g")) & (F.col("v") <= b["high"]))
        return rows.select("v", F.inline(of_row))

    def moved(target: tuple, below: bool) -> None:
        """A bracket that missed gives way to all values on the side where the rank is."""
        group, low, high = held[target][0]
        aside = _Bracket(group, spans[group]["low"], low) if below else _Bracket(group, high, spans[group]["high"])
        held[target] = aside, float(sizes[group])

    def sketch_again(targets: list[tuple]) -> None:
        inside = F.when(F.col("v") >= F.col("low"), F.col("v"))
        parts = reached(targets).groupBy("g", "low", "high").agg(
            F.count(inside).alias("n"), F.count_if(F.col("v") < F.col("low")).alias("below"), grid(inside)
        )
        of_bracket = {_Bracket(row["g"], row["low"], row["high"]): row for row in parts.collect()}
        for target in targets:
            group, rank = target
            before, row = held[target], of_bracket[held[target][0]]
            if not row["below"] < rank <= row["below"] + row["n"]:
                moved(target, rank <= row["below"])
                continue
            bracket, about = narrowed(group, row["grid"], rank - row["below"], row["n"])
            # Values too much alike to be told apart by a sketch are few: count them.
            held[target] = bracket, 0.0 if bracket == before[0] else about

    def count(targets: list[tuple]) -> None:
        # What lies below the bracket becomes one row, the first in order.
        place = F.when(F.col("v") >= F.col("low"), F.col("v")).alias("place")
        keys = ["g", "low", "high"]
        parts = reached(targets).groupBy(*keys, place).agg(F.count("*").alias("equal"))
        order = Window.partitionBy(*keys).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        summed = parts.withColumn("upto", F.sum("equal").over(order)).withColumn("below", F.col("upto") - F.col("equal"))
        asked = _literal([(*held[t][0], t[1]) for t in targets], *keys, "rank")
        hits = F.filter(
            asked,
            lambda t: t["g"].eqNullSafe(F.col("g")) & (t["low"] == F.col("low")) & (t["high"] == F.col("high"))
            & (t["rank"] > F.col("below")) & (t["rank"] <= F.col("upto")),
        )
        seen = summed.select("g", F.explode(F.transform(hits, lambda t: t["rank"])).alias("rank"), "place", "below", "equal")
        hit = {(row["g"], row["rank"]): row for row in seen.collect()}
        for target in targets:
            row = hit.get(target)
            if row is None or row["place"] is None:
                moved(target, row is not None)
            else:
                found[target] = Found(row["place"], row["below"], row["equal"])
                del held[target]

    while held:
        large = [t for t, (bracket, about) in held.items() if about > counted and bracket.low < bracket.high]
        if large:
            sketch_again(large)
        else:
            count(list(held))
    return sizes, found


def order_statistics(
    values: DataFrame, group: str, value: str, ranks: Mapping[str, Callable[[int], int]], **options
) -> DataFrame:
    """The values at the given ranks of every group: ``(group, n, <name>...)``.

    ``ranks`` gives, per output column, the 1-based rank for a group of n values; a rank
    outside 1..n gives null. ``value`` must be finite and not null. A group is a node
    type or a class of like cardinality. ``values`` is read once per scan, so pass a
    stored table; ``options`` are those of ``located``.
    """
    rows = values.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))

    def wanted(sizes: dict) -> set:
        return {(g, rank(n)) for g, n in sizes.items() for rank in ranks.values() if 1 <= rank(n) <= n}

    sizes, found = located(rows, wanted, **options)
    out = T.StructType(
        [T.StructField(group, rows.schema["g"].dataType), T.StructField("n", T.LongType())]
        + [T.StructField(name, T.DoubleType()) for name in ranks]
    )

    def at(g: Any, rank: int) -> float | None:
        return found[g, rank].value if (g, rank) in found else None

    table = [(g, n, *[at(g, rank(n)) for rank in ranks.values()]) for g, n in sizes.items()]
    return values.sparkSession.createDataFrame(table, out)


MEDIAN_RANKS = {"_below": lambda n: (n + 1) // 2, "_above": lambda n: n // 2 + 1}


def exact_median(values: DataFrame, group: str, value: str, name: str = "median", **options) -> DataFrame:
    """Exact median per group: ``(group, n, <name>)``."""
    picked = order_statistics(values, group, value, MEDIAN_RANKS, **options)
    return picked.select(group, "n", ((F.col("_below") + F.col("_above")) / 2).alias(name))


def leading_numbers(column: Column, kind: T.DataType) -> list[Column]:
    """The leading whole numbers of an order: a number itself, or the first fields of a struct up to one of another kind.

    Nulls, which come first in Spark's order, become the smallest long.
    """
    if isinstance(kind, T.IntegralType):
        return [F.coalesce(column.cast("long"), F.lit(-(1 << 63)).cast("long"))]
    numbers: list[Column] = []
    for field in kind.fields if isinstance(kind, T.StructType) else []:
        inner = leading_numbers(column[field.name], field.dataType)
        numbers += inner
        if not isinstance(field.dataType, T.IntegralType):
            break
    return numbers


def first_rows(rows: DataFrame, limit: int, group: Column, position: str, **options) -> DataFrame:
    """The first ``limit`` rows by ``group``, a number of low cardinality, and ``position``; all if there are no more.

    The rows stay where they are. The rank of the last one is located among the leading
    numbers of ``position``; only rows that equal it there are put in order. Rows that tie with
    the last in the whole order stay too. A position without leading numbers (a text) has
    its first ``limit`` keys of the last group ordered.
    """
    counted = options.get("counted", COUNTED)
    place = F.col(position)
    level = F.coalesce(group.cast("long"), F.lit(-1).cast("long"))
    numbers = leading_numbers(place, rows.schema[position].dataType) or [F.lit(0).cast("long")]
    rest, last = limit, None

    def wanted(sizes: dict) -> set:
        nonlocal rest, last
        for g in sorted(sizes):
            if rest <= sizes[g]:
                last = g
                return {(g, rest)}
            rest -= sizes[g]
        return set()

    _, found = located(rows.select(level.alias("g"), numbers[0].alias("v")), wanted, **options)
    if not found:
        return rows
    (hit,) = found.values()
    same = rows.where((level == last) & (numbers[0] == hit.value))
    rest -= hit.below
    for number in numbers[1:]:
        if hit.equal <= counted:
            break
        _, found = located(same.select(F.lit(0).alias("g"), number.alias("v")), lambda _, r=rest: {(0, r)}, **options)
        (hit,) = found.values()
        same, rest = same.where(number == hit.value), rest - hit.below
    key = F.struct(level.alias("group"), place.alias("position"))
    final = same.select(key.alias("key")).orderBy("key").limit(rest).agg(F.max("key")).scalar()
    return rows.where((level <= last) & (key <= final))
