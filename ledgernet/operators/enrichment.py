"""Company-registry attributes for suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgernet.functions.text import digits, nonblank
from ledgernet.operators.membership import BROADCAST_BITS, marks, suspects

_ROOT_DIGITS = 8
#: Digits of a whole company number; a person's has fewer and no root.
_COMPANY_DIGITS = 14
_COMPANY = ["razao_social", "capital_social"]
_ESTABLISHMENT = ["nome_fantasia", "cnae_principal", "data_inicio_atividade"]


def registry_table(companies: DataFrame, establishments: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """One row per registry key with the attributes of both tables.

    Several rows of one table under a key are reduced to the one with the smallest
    name, so the later joins cannot multiply suppliers. With ``wanted(registry_key)`` both
    scans are filtered by a bitmap of these keys, 16 MB at most, before anything moves:
    all wanted keys stay and few others.
    """
    places = None if wanted is None else F.broadcast(marks(wanted, "registry_key", BROADCAST_BITS))

    def side(table: DataFrame, columns: list[str], others: list[str]) -> DataFrame:
        present = [F.col(c) if c in table.columns else F.lit(None).cast("string") for c in columns]
        nameless = nonblank(present[0]).isNull().alias("nameless")
        named = F.struct(nameless, *[v.alias(c) for v, c in zip(present, columns)])
        keyed = table.select(
            digits(F.col("cnpj").cast("string")).alias("registry_key"),
            named.alias(columns[0] + "_row"),
            F.lit(None)
            .cast("struct<nameless:boolean," + ",".join(f"{c}:string" for c in others) + ">")
            .alias(others[0] + "_row"),
        )
        return keyed if places is None else suspects(keyed, "registry_key", places, BROADCAST_BITS)

    both = side(companies, _COMPANY, _ESTABLISHMENT).unionByName(side(establishments, _ESTABLISHMENT, _COMPANY))
    reduced = both.where(F.col("registry_key") != "").groupBy("registry_key").agg(
        F.min("razao_social_row").alias("company"), F.min("nome_fantasia_row").alias("establishment")
    )
    return reduced.select(
        "registry_key",
        *[F.col(f"company.{c}") for c in _COMPANY],
        *[F.col(f"establishment.{c}") for c in _ESTABLISHMENT],
    )


def enrich_suppliers(suppliers: DataFrame, companies: DataFrame, establishments: DataFrame) -> DataFrame:
    """Left join the registry by document and fill a missing supplier name from it.

    The whole document is tried first, then, for a company number, its 8-digit root; the
    first digits of a person's number are no root. Of the registry only rows move whose key
    the suppliers can have. Suppliers without a document get keys
    that match nothing and spread over the cluster, so they do not pile up in one
    partition as nulls would.
    """
    attributes = _COMPANY + _ESTABLISHMENT
    number = digits(F.col("documento"))
    spread = F.concat(F.lit("~"), F.xxhash64("id").cast("string"))
    usable = F.coalesce(F.length(number) >= _ROOT_DIGITS, F.lit(False))
    keyed = suppliers.withColumns(
        {
            "_full": F.when(usable, number).otherwise(spread),
            "_root": F.when(F.length(number) == _COMPANY_DIGITS, F.substring(number, 1, _ROOT_DIGITS)).otherwise(spread),
        }
    )
    wanted = keyed.select(F.explode(F.array("_full", "_root")).alias("registry_key"))
    registry = registry_table(companies, establishments, wanted.where(~F.startswith("registry_key", F.lit("~"))))
    for key in ("_full", "_root"):
        matched = registry.select(F.col("registry_key").alias(key), *[F.col(c).alias(key + c) for c in attributes])
        keyed = keyed.join(matched, key, "left")
    found = {c: F.coalesce(nonblank(F.col("_full" + c)), nonblank(F.col("_root" + c))) for c in attributes}
    return keyed.select(
        *[
            F.coalesce(nonblank(F.col("nome")), found["razao_social"], found["nome_fantasia"]).alias("nome")
            if c == "nome"
            else F.col(c)
            for c in suppliers.columns
        ],
        *[found[c].alias(c) for c in attributes],
    )
