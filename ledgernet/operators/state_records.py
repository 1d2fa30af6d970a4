"""Flat state records, one per commitment, to the three payload collections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgernet import vocabulary as V
from ledgernet.functions.amounts import first_given
from ledgernet.functions.dates import month_start
from ledgernet.functions.text import id_of_key, joined_slugs, nonblank, slugify, stable_key
from ledgernet.operators.normalize import Collections
from ledgernet.operators.quality import dedup_first
from ledgernet.operators.selection import first_rows


def scan_years(records: DataFrame, years: Sequence[str], max_records: int | None = None) -> DataFrame:
    """Records of the given years in that order of years, at most ``max_records`` in all.

    ``position`` is a total order of the records of one year. The cap is a cut at the key
    of the last record that counts, which is found by counting.
    """
    if not years:
        wanted, year_order = records, F.lit(0)
    else:
        names = [str(y) for y in years]
        wanted = records.where(F.col("Ano").isin(names))
        year_order = F.array_position(F.lit(names), F.col("Ano"))
    if not max_records or max_records <= 0:
        return wanted
    return first_rows(wanted, max_records, year_order, "position")


def flatten(records: DataFrame, limit: int | None = None) -> Collections:
    """Commitments, and the first mention of every supplier and agency.

    ``records`` has the state-record fields as text and ``position``, a total order. Amounts
    stay text, so that the validation of a load sees those that are no number.
    """
    if limit and limit > 0:
        records = first_rows(records, limit, F.lit(0), "position")

    agency = F.coalesce(F.trim("Unidade"), F.lit(""))
    document = F.coalesce(F.trim("CPFCNPJ"), F.lit(""))
    written = [F.coalesce(F.col(c), F.lit(V.ABSENT_TEXT)) for c in ("Ano", "Mes", "NumeroEmpenho")]
    year, month, number = written
    keyed = records.select(
        "position",
        "TipoPessoa",
        "Funcao",
        agency.alias("agency"),
        document.alias("document"),
        number.alias("numero"),
        month_start(F.col("Ano"), F.col("Mes")).cast("string").alias("data_empenho"),
        first_given(F.col("Empenho"), F.col("Empenhado")).alias("valor_empenhado"),
        stable_key(document, F.col("TipoPessoa")).alias("fornecedor_id"),
        stable_key(agency).alias("unidade_gestora_id"),
        stable_key(year, month, agency, number, document).alias("id"),
        # Folding accents is what costs: once per part, not once per id that holds it.
        slugify(agency).alias("agency_slug"),
        slugify(document).alias("document_slug"),
        slugify(F.col("TipoPessoa")).alias("kind_slug"),
        joined_slugs(slugify(year), slugify(month)).alias("month_slug"),
        slugify(number).alias("number_slug"),
    )
    slugs = {
        "fornecedor_id": (V.FORNECEDOR, ["document_slug", "kind_slug"]),
        "unidade_gestora_id": (V.ORGAO, ["agency_slug"]),
        "id": (V.EMPENHO, ["month_slug", "agency_slug", "number_slug", "document_slug"]),
    }
    keyed = keyed.withColumns(
        {name: id_of_key(kind, F.col(name), joined_slugs(*map(F.col, parts))) for name, (kind, parts) in slugs.items()}
    )

    commitments = keyed.select(
        "id",
        "numero",
        F.concat(F.lit(V.FUNCTION_PREFIX), nonblank(F.col("Funcao"))).alias("descricao"),
        "valor_empenhado",
        "data_empenho",
        "fornecedor_id",
        "unidade_gestora_id",
        F.lit(None).cast("string").alias("contrato_id"),
        "position",
    )
    suppliers = dedup_first(
        keyed.select("fornecedor_id", "document", "TipoPessoa", "position"), ["fornecedor_id"], ["position"]
    ).select(
        F.col("fornecedor_id").alias("id"),
        F.coalesce(nonblank(F.col("document")), F.lit(V.UNKNOWN_SUPPLIER)).alias("nome"),
        nonblank(F.col("document")).alias("documento"),
        F.col("TipoPessoa").alias("tipo_documento"),
        F.lit(None).cast("string").alias("municipio"),
        F.lit(None).cast("string").alias("uf"),
    )
    agencies = dedup_first(
        keyed.select("unidade_gestora_id", "agency", "position"), ["unidade_gestora_id"], ["position"]
    ).select(
        F.col("unidade_gestora_id").alias("id"),
        F.coalesce(nonblank(F.col("agency")), F.lit(V.UNKNOWN_AGENCY)).alias("nome"),
        F.lit(None).cast("string").alias("sigla"),
        F.lit(None).cast("string").alias("municipio"),
        F.lit(None).cast("string").alias("uf"),
    )
    return Collections(commitments, suppliers, agencies)
