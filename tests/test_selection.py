import random
import statistics

import pytest
from pyspark.sql import functions as F

from ledgernet.operators.robust import median_and_mad, robust_stats
from ledgernet.operators.selection import first_rows, order_statistics
from ledgernet.sources.workspace import cut_lineage

RNG = random.Random(7)
SAMPLES = {
    "even": [RNG.uniform(-5, 5) for _ in range(40)],
    "odd": [RNG.uniform(0, 1) for _ in range(41)],
    "heavy": [RNG.paretovariate(0.4) * 1000 for _ in range(120)],
    "hot": [0.0] * 70 + [RNG.uniform(0, 9) for _ in range(35)],
    "close": [1e8 + i * 1e-7 for i in range(30)],
    "one": [3.25],
    "five": [1.0, 2.0, 4.0, 9.0, 20.0],
}


@pytest.fixture(scope="module")
def sample(spark):
    rows = [(g, float(v)) for g, vs in SAMPLES.items() for v in vs]
    RNG.shuffle(rows)
    return cut_lineage(spark.createDataFrame(rows, "g string, v double").repartition(5))


# Small sketches and brackets that reach less far miss ranks, small counts need more scans.
OPTIONS = [{}, {"sketch": 8, "margin": 0.0}, {"sketch": 8, "margin": -0.3}, {"sketch": 8, "margin": 0.01, "counted": 2}]


@pytest.mark.parametrize("options", OPTIONS)
def test_ranks_are_exact_for_any_bracket(spark, sample, options):
    ranks = {"first": lambda n: 1, "middle": lambda n: (n + 1) // 2, "last": lambda n: n, "beyond": lambda n: n + 1}
    got = {r["g"]: r for r in order_statistics(sample, "g", "v", ranks, **options).collect()}
    for group, values in SAMPLES.items():
        ordered = sorted(values)
        assert got[group]["n"] == len(values)
        assert got[group]["first"] == ordered[0]
        assert got[group]["middle"] == ordered[(len(values) + 1) // 2 - 1]
        assert got[group]["last"] == ordered[-1]
        assert got[group]["beyond"] is None


def test_statistics_match_the_definitions(spark, sample):
    got = {r["g"]: r for r in robust_stats(sample, "g", "v", sketch=16, counted=4).collect()}
    for group, values in SAMPLES.items():
        median = statistics.median(values)
        row = got[group]
        assert row["median"] == pytest.approx(median)
        assert row["mad"] == pytest.approx(statistics.median(abs(v - median) for v in values) or 1e-9)
        assert row["mean"] == pytest.approx(statistics.mean(values))
        assert row["stdev"] == pytest.approx(statistics.pstdev(values) or 1e-9, rel=1e-4, abs=1e-6)
        p80 = statistics.quantiles(values, n=5)[3] if len(values) >= 5 else max(values)
        assert row["p80"] == pytest.approx(p80)
    assert got["five"]["p80"] == pytest.approx(17.8)


def test_only_finite_values_count_and_an_empty_sample_is_zero(spark):
    rows = [("a", 1.0), ("a", float("nan")), ("a", 3.0), ("a", None), ("b", float("inf")), ("b", None)]
    df = cut_lineage(spark.createDataFrame(rows, "g string, v double"))
    got = {r["g"]: r for r in robust_stats(df, "g", "v").collect()}
    assert (got["a"]["n"], got["a"]["median"], got["a"]["mad"]) == (2, 2.0, 1.0)
    assert (got["b"]["median"], got["b"]["mad"], got["b"]["p80"]) == (0.0, 1e-9, 0.0)
    assert median_and_mad(df.where(F.lit(False)), "g", "v").count() == 0


@pytest.mark.parametrize("options", OPTIONS)
@pytest.mark.parametrize("position", ["p", "struct(p div 10 as a, p % 10 as b)", "struct(p div 100 as a, cast(p % 100 + 100 as string) as b)", "lpad(p, 4, 0)"])
def test_a_cap_keeps_the_first_rows_of_any_order(spark, position, options):
    rows = spark.range(400).selectExpr("pmod(hash(id), 3) as g", "pmod(id * 7, 400) as p").repartition(4)
    keyed = cut_lineage(rows.selectExpr("g", "p", f"{position} as position"))
    ordered = sorted((r["g"], r["p"]) for r in keyed.collect())
    for limit in (1, 130, 399, 1000):
        got = first_rows(keyed, limit, F.col("g"), "position", **options)
        assert sorted((r["g"], r["p"]) for r in got.collect()) == ordered[:limit]
    assert first_rows(keyed.where(F.lit(False)), 5, F.col("g"), "position", **options).count() == 0


def test_statistics_scan_their_values_twice(spark, sample):
    scans = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            scans.add(batch.num_rows)
            yield batch

    order_statistics(sample.mapInArrow(seen, sample.schema), "g", "v", {"middle": lambda n: (n + 1) // 2})
    assert scans.value == 2 * sample.count()
