"""Raw payload collections to the normalised tables, and their lineage columns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgernet import schema as S
from ledgernet.functions.amounts import parse_amount
from ledgernet.functions.dates import parse_timestamp


class Collections(NamedTuple):
    """The three raw collections of a payload, or the three normalised tables."""

    commitments: DataFrame
    suppliers: DataFrame
    agencies: DataFrame


# Normalised column -> payload field, where the two differ.
_COMMITMENT_FIELDS = {
    "empenho_id": "id", "numero_empenho": "numero", "orgao_id": "unidade_gestora_id",
}
_SUPPLIER_FIELDS = {"fornecedor_id": "id", "nome_fornecedor": "nome"}
_AGENCY_FIELDS = {"orgao_id": "id", "nome_orgao": "nome"}


def _conform(raw: DataFrame, table: T.StructType, fields: dict[str, str]) -> DataFrame:
    """Columns of ``table`` in order: renamed, typed, null where the payload lacks them."""
    present = set(raw.columns)

    def column(field: T.StructField) -> Column:
        source = fields.get(field.name, field.name)
        if source not in present:
            value = F.lit(None)
        elif field.dataType == T.DoubleType() and raw.schema[source].dataType == T.StringType():
            value = parse_amount(F.col(source))
        elif field.dataType == T.TimestampNTZType() and raw.schema[source].dataType != field.dataType:
            value = parse_timestamp(F.col(source))
        else:
            value = F.col(source)
        return value.cast(field.dataType.simpleString()).alias(field.name)

    return raw.select(*[column(field) for field in table])


def normalize_commitments(raw: DataFrame) -> DataFrame:
    return _conform(raw, S.COMMITMENTS, _COMMITMENT_FIELDS)


def normalize_suppliers(raw: DataFrame) -> DataFrame:
    return _conform(raw, S.SUPPLIERS, _SUPPLIER_FIELDS)


def normalize_agencies(raw: DataFrame) -> DataFrame:
    return _conform(raw, S.AGENCIES, _AGENCY_FIELDS)


def normalize(raw: Collections) -> Collections:
    return Collections(
        normalize_commitments(raw.commitments),
        normalize_suppliers(raw.suppliers),
        normalize_agencies(raw.agencies),
    )


def fingerprint(*tables: DataFrame) -> DataFrame:
    """One-row ``payload_hash`` of a batch that does not depend on row order.

    Each table gives a row count, the xor and the sum of its row hashes, which are the
    first 60 bits of md5: the sum keeps repeated rows from cancelling out.
    """
    parts = []
    for position, table in enumerate(tables):
        # A field that is null leaves a mark that no text has.
        fields = [F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in sorted(table.columns)]
        row = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *fields).cast("binary")), 1, 15), 16, 10).cast("long")
        parts.append(
            table.select(row.alias("h")).agg(
                F.concat_ws(
                    ":",
                    F.lit(position),
                    F.count("*"),
                    F.coalesce(F.bit_xor("h"), F.lit(0)),
                    F.coalesce(F.sum(F.col("h").cast("decimal(20,0)")), F.lit(0)),
                ).alias("part")
            )
        )
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    joined = F.array_join(F.sort_array(F.collect_list("part")), "|")
    return united.agg(F.sha2(joined, 256).alias("payload_hash"))


def with_lineage(
    raw: Collections, source_label: str, ingested_at: Column | None = None, batch: DataFrame | None = None
) -> Collections:
    """Add source label, ingestion time (UTC) and batch fingerprint to every row.

    The fingerprint is a scalar subquery: plans that do not use the column skip it. It is
    that of ``raw`` unless ``batch`` gives another.
    """
    if ingested_at is None:
        now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
        ingested_at = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    batch = fingerprint(*raw) if batch is None else batch
    return Collections(
        *[
            table.withColumns(
                {
                    "fonte_origem": F.lit(source_label),
                    "data_ingestao": ingested_at,
                    "payload_hash": batch.scalar(),
                }
            )
            for table in raw
        ]
    )
