import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from ledgernet.functions import amounts, dates, severity, text


def values(spark, cells, expression, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, x {kind}")
    rows = df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()
    return [r["y"] for r in rows]


def test_amounts(spark):
    cells = ["1.234,56", "10,5", "1.234", " ", None, "-3,5", "1.234.567,8", "abc", "1d", "1e3", ".5", "NaN"]
    want = [1234.56, 10.5, 1.234, 0.0, 0.0, -3.5, 1234567.8, None, None, 1000.0, 0.5, None]
    assert values(spark, cells, amounts.parse_amount) == want


def test_finite_and_lenient(spark):
    cells = [1.5, float("nan"), float("inf"), float("-inf"), None]
    assert values(spark, cells, amounts.finite, "double") == [1.5, None, None, None, None]
    assert values(spark, ["2", "x", None, "inf"], amounts.lenient_number) == [2.0, 0.0, 0.0, 0.0]


def test_first_given(spark):
    df = spark.createDataFrame([("0", "5"), ("", "6"), (None, "7"), ("8", "9"), (" ", "1")], "a string, b string")
    got = [r[0] for r in df.select(amounts.first_given(F.col("a"), F.col("b"))).collect()]
    assert got == ["0", "6", "7", "8", " "]


def test_fold_covers_every_plane(spark):
    assert values(spark, ["\U0001d400cme \U0001f130", "\U0001f600x"], text.slugify) == ["acme-a", "x"]


def test_masks_strip_all_marks(spark):
    cells = ["12345678909", "12345678000190", "12.345.678/0001-90", "123456", "12", "", None, "abc"]
    want = ["***.456.***-09", "**.345.***/*0001-90", "**.345.***/*0001-90", "**3456", "***", "", None, "***"]
    assert values(spark, cells, text.mask_document) == want


SLUGS = ["Secretaria de Inovação", "ﬁm ½ Ⅷ ⑴", "a中b", "  --x", "", "ÀÉÎõü ç", "㎏ nº 5ª №7", "áb", "Ωmega", "JURÍDICA", "½"]


def test_slugs_follow_the_compatibility_decomposition(spark):
    def plain(value):
        folded = unicodedata.normalize("NFKD", value).encode("ascii", "ignore").decode()
        return re.sub("[^a-z0-9]+", "-", folded.lower()).strip("-")

    assert values(spark, SLUGS, text.slugify) == [plain(s) for s in SLUGS]
    assert values(spark, [None], text.slugify) == [""]


@pytest.mark.parametrize(
    "prefix, parts, want",
    [
        ("orgao", ["Secretaria de Inovação"], "orgao-secretaria-de-inovacao-918bb88e3f"),
        ("fornecedor", ["12345678000199", "JURÍDICA"], "fornecedor-12345678000199-juridica-65a066d426"),
        (
            "empenho",
            ["2024", "5", "Secretaria de Inovação", "42", "12345678000199"],
            "empenho-2024-5-secretaria-de-inovacao-42-12345678000199-c7cef2595e",
        ),
        ("orgao", [""], "orgao-desconhecido"),
        ("orgao", [None], "orgao-desconhecido"),
        ("orgao", ["中"], "orgao-registro-" + hashlib.sha1("中".encode()).hexdigest()[:10]),
    ],
)
def test_stable_ids(spark, prefix, parts, want):
    row = spark.range(1).select(text.stable_id(prefix, *[F.lit(p).cast("string") for p in parts])).first()
    assert row[0] == want


def test_labels_take_the_first_nonempty(spark):
    df = spark.createDataFrame(
        [("n", "d", "1", "o", "i"), ("", "d", "1", "o", "i"), (None, None, "", "o", "i"), (None, "", None, None, "i")],
        "a string, b string, c string, d string, e string",
    )
    got = [r[0] for r in df.select(text.label(*[F.col(c) for c in "abcde"])).collect()]
    assert got == ["n", "d", "o", "i"]


def test_dates_give_null_on_bad_input(spark):
    iso = lambda c: dates.iso_text(dates.parse_timestamp(c))
    cells = ["2023-01-15", "2023-01-15 10:20:30", "2023-01-15T10:20:30", "amanhã", "2023-02-30", None]
    want = ["2023-01-15T00:00:00", "2023-01-15T10:20:30", "2023-01-15T10:20:30", None, None, None]
    assert values(spark, cells, iso) == want
    df = spark.createDataFrame([("2024", "5"), ("2024", "13"), ("x", "1"), ("2024", None), ("2024", " 7 ")], "y string, m string")
    got = [r[0] and str(r[0]) for r in df.select(dates.month_start(F.col("y"), F.col("m"))).collect()]
    assert got == ["2024-05-01", None, None, None, "2024-07-01"]


def test_severities_and_weights(spark):
    z = [3.5, 3.49, 2.5, 2.49, -1.0]
    assert values(spark, z, severity.severity_from_z, "double") == ["alta", "media", "media", "baixa", "baixa"]
    words = ["baixa", "MEDIA", "alta", "grave", None]
    assert values(spark, words, severity.severity_weight) == [0.3, 0.7, 1.2, 0.4, 0.7]
    assert values(spark, words, severity.severity_rank) == [1, 2, 3, 2, 2]
    isolation = [0.85, 0.84, 0.6, 0.59]
    assert values(spark, isolation, severity.severity_from_isolation, "double") == ["alta", "media", "media", "baixa"]


def test_signal_strength_of_missing_and_negative_scores(spark):
    df = spark.createDataFrame(
        [(2.0, "alta", "comunidades_isoladas"), (-1.0, "alta", "x"), (None, "baixa", "alta_entropia_fornecedores")],
        "s double, v string, d string",
    )
    got = [r[0] for r in df.select(severity.signal_strength(F.col("s"), F.col("v"), F.col("d"))).collect()]
    assert got == pytest.approx([2.0 * 1.2 * 0.8, 0.0, 1.0 * 0.3 * 0.9])


def test_sums_of_amounts_are_those_of_decimals(spark):
    from ledgernet.functions.amounts import money, money_sum

    amounts = [0.1, 0.2, 0.3, -0.3, 104949.5, -7.00005, 1.00015, 2.5e-5, 1e-9, 9999999999.9999, 1e10, -1e10, 123456789012.34567,
               4503599627370.4971, -0.0, 16777215.9999, -16777216.0001, None, 33.33333333]
    rows = [("all", v) for v in amounts] + [("none", None), ("plain", 0.07), ("plain", 0.01), ("other", 0.00001)]
    rows += [(f"one {i}", v) for i, v in enumerate(amounts)]
    summed = spark.createDataFrame(rows, "g string, v double").groupBy("g").agg(
        money_sum(F.col("v")).alias("fast"), F.sum(money(F.col("v"))).cast("double").alias("plain")
    )
    for row in summed.collect():
        assert row["fast"] == row["plain"], row
