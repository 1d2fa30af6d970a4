"""Synthetic payloads of any size: every value is a hash of the row id and the seed.

Rows do not depend on each other, so the data is the same however it is partitioned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgernet.operators.normalize import Collections

# Names the generator draws from; how many there are does not matter to it.
AGENCY_NAMES = [
    ("Departamento de Parques", "DEPAR"),
    ("Departamento de Estradas", "DEEST"),
    ("Instituto de Águas", "INAG"),
    ("Arquivo Público", "ARPUB"),
    ("Junta de Transportes", "JUTRA"),
    ("Fundação de Museus", "FUMUS"),
]
SUPPLIER_NAMES = [
    "Papelaria Horta", "Obras do Vale", "Pedreira Lima", "Gráfica Ponte", "Viveiro Sabiá",
    "Oficina Central", "Frota Azul", "Cerâmica Rubi", "Lavanderia Norte", "Madeiras Paiva",
]
DESCRIPTIONS = [
    "Compra de mudas e sementes",
    "Reparo de pontes e bueiros",
    "Estudo de solo e relevo",
    "Impressão de mapas",
    "Aluguel de caminhões",
    "Restauro de acervo",
    "Pintura de fachadas",
    "Poda de árvores",
]
CITIES = ["Curitiba", "Londrina", "Maringá", "Cascavel"]
STATE = "PR"

# Amounts, dates and shares of the generator and its patterns.
AMOUNTS = (5_000.0, 250_000.0)
DAYS_BACK = 540
CONTRACT_SHARE = 0.7
HUB_NAME = "Consórcio Grande Eixo"
HUB_DESCRIPTION = "Obra plurianual de grande porte"
HUB_AMOUNTS = (380_000.0, 520_000.0)
HUB_SPREAD = (0.9, 1.1)
HUB_AGENCIES = 6
HUB_DAYS_BACK = 180
ISOLATED_NAME = "Armazém da Ilha"
ISOLATED_CITY = "Paranaguá"
ISOLATED_AGENCY = "Posto Remoto {n}"
ISOLATED_SHORT = "PR{n}"
ISOLATED_AGENCY_CITY = "Antonina"
ISOLATED_DESCRIPTION = "Reforma de cais e trapiches"
ISOLATED_AMOUNTS = (45_000.0, 60_000.0)
ISOLATED_DAYS_BACK = 90
LINK_DESCRIPTION = "Serviço avulso"
LINK_AMOUNTS = (8_000.0, 12_000.0)
LINK_DAYS_BACK = 30


class _Draw:
    """Hash draws for a row: one independent value per purpose."""

    def __init__(self, seed: int, *key: Column):
        self.seed, self.key = seed, key

    def index(self, purpose: str, n) -> Column:
        n = n if isinstance(n, Column) else F.lit(n)
        return F.pmod(F.xxhash64(*self.key, F.lit(self.seed), F.lit(purpose)), n.cast("long"))

    def share(self, purpose: str) -> Column:
        return self.index(purpose, 1_000_000_000) / F.lit(1e9)

    def between(self, purpose: str, low: float, high: float) -> Column:
        return F.lit(low) + self.share(purpose) * (high - low)

    def cents(self, purpose: str, bounds: tuple[float, float]) -> Column:
        return F.round(self.between(purpose, *bounds), 2)

    def one_of(self, purpose: str, choices: list[str]) -> Column:
        options = F.array(*[F.lit(c) for c in choices])
        return F.element_at(options, (self.index(purpose, len(choices)) + 1).cast("int"))

    def day(self, purpose: str, today: Column, days_back: int) -> Column:
        offset = self.index(purpose, days_back + 1).cast("int")
        return F.date_sub(today, offset).cast("string")

    def company_number(self, purpose: str) -> Column:
        digits = F.lpad(self.index(purpose, 10**14).cast("string"), 14, "0")
        cuts = [(1, 2, "."), (3, 3, "."), (6, 3, "/"), (9, 4, "-"), (13, 2, "")]
        return F.concat(*[x for at, n, mark in cuts for x in (F.substring(digits, at, n), F.lit(mark))])


def _numbered(prefix: str, index: Column, width: int) -> Column:
    """``prefix`` and the number from 1, zero-padded to at least ``width`` digits."""
    return F.concat(F.lit(prefix), F.format_string(f"%0{width}d", index + 1))


def agencies(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    names = F.array(*[F.struct(F.lit(a).alias("nome"), F.lit(b).alias("sigla")) for a, b in AGENCY_NAMES])
    # The names follow each other from a drawn first one.
    start = _Draw(seed, F.lit("agencies")).index("first name", len(AGENCY_NAMES))
    chosen = F.element_at(names, (F.pmod(F.col("id") + start, F.lit(len(AGENCY_NAMES))) + 1).cast("int"))
    return spark.range(max(1, n)).select(
        _numbered("O", F.col("id"), 3).alias("id"),
        chosen["nome"].alias("nome"),
        chosen["sigla"].alias("sigla"),
        F.lit(CITIES[0]).alias("municipio"),
        F.lit(STATE).alias("uf"),
    )


def suppliers(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    draw = _Draw(seed, F.lit("supplier"), F.col("id"))
    return spark.range(max(1, n)).select(
        _numbered("F", F.col("id"), 4).alias("id"),
        F.concat(draw.one_of("name", SUPPLIER_NAMES), F.lit(" LTDA")).alias("nome"),
        draw.company_number("document").alias("documento"),
        F.lit("CNPJ").alias("tipo_documento"),
        draw.one_of("city", CITIES).alias("municipio"),
        F.lit(STATE).alias("uf"),
    )


def commitments(
    numbers: DataFrame,
    n_agencies: int,
    n_suppliers: int,
    include_contracts: bool = True,
    seed: int = 0,
    today: Column | None = None,
) -> DataFrame:
    """One raw commitment per row of ``numbers(id)``, a count from 0."""
    today = F.current_date() if today is None else today
    draw = _Draw(seed, F.lit("commitment"), F.col("id"))
    contract = F.when(draw.share("has contract") < CONTRACT_SHARE, _numbered("C", F.col("id"), 5))
    return numbers.select(
        _numbered("E", F.col("id"), 5).alias("id"),
        F.concat(F.year(today).cast("string"), _numbered("-", F.col("id"), 4)).alias("numero"),
        draw.one_of("description", DESCRIPTIONS).alias("descricao"),
        draw.cents("amount", AMOUNTS).cast("string").alias("valor_empenhado"),
        draw.day("date", today, DAYS_BACK).alias("data_empenho"),
        _numbered("F", draw.index("supplier", max(1, n_suppliers)), 4).alias("fornecedor_id"),
        _numbered("O", draw.index("agency", max(1, n_agencies)), 3).alias("unidade_gestora_id"),
        (contract if include_contracts else F.lit(None).cast("string")).alias("contrato_id"),
    )


def generate(
    spark: SparkSession,
    n_agencies: int = 6,
    n_suppliers: int = 10,
    n_commitments: int = 40,
    include_contracts: bool = True,
    seed: int = 0,
    today: Column | None = None,
) -> Collections:
    """A synthetic payload with the anomaly patterns."""
    base = Collections(
        commitments(spark.range(max(1, n_commitments)), n_agencies, n_suppliers, include_contracts, seed, today),
        suppliers(spark, n_suppliers, seed),
        agencies(spark, n_agencies, seed),
    )
    return inject_patterns(base, include_contracts, seed, today)


def inject_patterns(
    base: Collections, include_contracts: bool = True, seed: int = 0, today: Column | None = None
) -> Collections:
    """Add a hub supplier, an almost isolated trio and one weak link out of it.

    The hub gets a large commitment from each of six agencies of ``base``, those of
    smallest hash; the trio is two new agencies and a new supplier; its weak link goes
    to the agency of smallest hash that is not in the trio.
    """
    spark = base.agencies.sparkSession
    today = F.current_date() if today is None else today
    year = F.year(today).cast("string")
    hub, isolated = F.lit("F-HUB"), F.lit("F-ISO")
    number_of = F.col("n")

    def contract(prefix: str, pattern: str) -> Column:
        return F.concat(F.lit(prefix), F.format_string(pattern, number_of)) if include_contracts else F.lit(None).cast("string")

    one = spark.range(1)
    fixed = _Draw(seed, F.lit("pattern"))

    def new_supplier(id_: Column, name: str, city: str) -> DataFrame:
        return one.select(
            id_.alias("id"),
            F.lit(name).alias("nome"),
            fixed.company_number(name).alias("documento"),
            F.lit("CNPJ").alias("tipo_documento"),
            F.lit(city).alias("municipio"),
            F.lit(STATE).alias("uf"),
        )

    trio = spark.range(1, 3).select(
        F.concat(F.lit("O-ISO-"), F.col("id").cast("string")).alias("id"),
        F.format_string(ISOLATED_AGENCY.replace("{n}", "%d"), "id").alias("nome"),
        F.format_string(ISOLATED_SHORT.replace("{n}", "%d"), "id").alias("sigla"),
        F.lit(ISOLATED_AGENCY_CITY).alias("municipio"),
        F.lit(STATE).alias("uf"),
        F.col("id").alias("n"),
    )

    def nearest(purpose: str, table: DataFrame, n: int) -> DataFrame:
        """``n`` rows of smallest hash, numbered from 1: a top-k, then a count over its rows."""
        hashed = table.select("id", F.xxhash64("id", F.lit(seed), F.lit(purpose)).alias("h"))
        few = hashed.orderBy("h", "id").limit(n).agg(F.sort_array(F.collect_list(F.struct("h", "id"))).alias("r"))
        return few.select(F.posexplode("r").alias("n", "r")).select((F.col("n") + 1).cast("long").alias("n"), F.col("r.id").alias("id"))

    def rows(table: DataFrame, kind: str, supplier: Column, number: Column, text: str, amount: Column, days: int, contract_id: Column):
        draw = _Draw(seed, F.lit(kind), number_of)
        return table.select(
            F.concat(F.lit(f"E-{kind}-"), number_of.cast("string")).alias("id"),
            F.concat(year, number).alias("numero"),
            F.lit(text).alias("descricao"),
            amount.cast("string").alias("valor_empenhado"),
            draw.day("date", today, days).alias("data_empenho"),
            supplier.alias("fornecedor_id"),
            F.col("id").alias("unidade_gestora_id"),
            contract_id.alias("contrato_id"),
        )

    hub_amount = fixed.cents("hub", HUB_AMOUNTS) * _Draw(seed, F.lit("hub"), number_of).between("spread", *HUB_SPREAD)
    outside = base.agencies.select("id").join(trio.select("id"), "id", "left_anti")
    added = [
        rows(
            nearest("hub", base.agencies, HUB_AGENCIES), "HUB", hub, F.format_string("-S%03d", number_of),
            HUB_DESCRIPTION, F.round(hub_amount, 2), HUB_DAYS_BACK, contract("CSUP-", "%03d"),
        ),
        rows(
            trio, "ISO", isolated, F.format_string("-ISO-%02d", number_of),
            ISOLATED_DESCRIPTION, _Draw(seed, F.lit("iso"), number_of).cents("amount", ISOLATED_AMOUNTS),
            ISOLATED_DAYS_BACK, contract("CISO-", "%02d"),
        ),
        rows(
            nearest("link", outside, 1), "LINK", isolated, F.lit("-ISO-LINK"),
            LINK_DESCRIPTION, fixed.cents("link", LINK_AMOUNTS), LINK_DAYS_BACK, F.lit(None).cast("string"),
        ),
    ]
    return Collections(
        reduce(DataFrame.unionByName, added, base.commitments),
        base.suppliers.unionByName(new_supplier(hub, HUB_NAME, CITIES[0])).unionByName(
            new_supplier(isolated, ISOLATED_NAME, ISOLATED_CITY)
        ),
        base.agencies.unionByName(trio.drop("n")),
    )
