"""Table schemas: payload collections, normalised tables, graph and report tables.

Fixed values: names, order and types of all columns, which files and results share with others.
"""

from pyspark.sql import types as T


def _strings(*names):
    return [T.StructField(name, T.StringType()) for name in names]


RAW_COMMITMENT = T.StructType(
    _strings(
        "id", "numero", "descricao", "valor_empenhado", "data_empenho",
        "fornecedor_id", "unidade_gestora_id", "contrato_id",
    )
)
RAW_SUPPLIER = T.StructType(
    _strings("id", "nome", "documento", "tipo_documento", "municipio", "uf")
)
RAW_AGENCY = T.StructType(_strings("id", "nome", "sigla", "municipio", "uf"))

RAW_COLLECTIONS = {
    "empenhos": RAW_COMMITMENT,
    "fornecedores": RAW_SUPPLIER,
    "orgaos": RAW_AGENCY,
}

STATE_RECORD = T.StructType(
    _strings(
        "Unidade", "Ano", "Mes", "NumeroEmpenho", "TipoPessoa",
        "CPFCNPJ", "Funcao", "Empenho", "Empenhado",
    )
)



def as_written(record: T.StructType, *fields: str) -> T.StructType:
    """The record with some fields as JSON values whose kind is still known."""
    return T.StructType([T.StructField(f.name, T.VariantType() if f.name in fields else f.dataType) for f in record])


LINEAGE = ["fonte_origem", "data_ingestao", "payload_hash"]

COMMITMENTS = T.StructType(
    _strings("empenho_id", "numero_empenho", "descricao")
    + [T.StructField("valor_empenhado", T.DoubleType())]
    + [T.StructField("data_empenho", T.TimestampNTZType())]
    + _strings("fornecedor_id", "orgao_id", "contrato_id", *LINEAGE)
)
SUPPLIERS = T.StructType(
    _strings(
        "fornecedor_id", "nome_fornecedor", "documento", "tipo_documento",
        "municipio", "uf", *LINEAGE,
    )
)
AGENCIES = T.StructType(
    _strings("orgao_id", "nome_orgao", "sigla", "municipio", "uf", *LINEAGE)
)

VERTICES = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("node_type", T.StringType(), False),
    ]
    + _strings(
        "original_id", "nome", "sigla", "municipio", "uf", "documento",
        "tipo_documento", "numero", "descricao",
    )
    + [T.StructField("valor", T.DoubleType())]
    + _strings("data", *LINEAGE)
)
EDGES = T.StructType(
    [
        T.StructField("src", T.StringType(), False),
        T.StructField("dst", T.StringType(), False),
        T.StructField("edge_type", T.StringType(), False),
        T.StructField("valor", T.DoubleType()),
    ]
)

ANOMALIES = T.StructType(
    _strings("anomaly_id", "detector", "node_id", "node_label", "node_type")
    + [T.StructField("score", T.DoubleType())]
    + _strings("severity", "reason")
    + [
        T.StructField("metric_value", T.DoubleType()),
        T.StructField("zscore", T.DoubleType()),
        T.StructField("rank", T.LongType()),
        T.StructField("neighbor_count", T.LongType()),
        T.StructField("node_count", T.LongType()),
        T.StructField("node_types", T.ArrayType(T.StringType())),
        T.StructField("isolation_score", T.DoubleType()),
        T.StructField("internal_edges", T.LongType()),
        T.StructField("external_edges", T.LongType()),
        T.StructField("edge_density", T.DoubleType()),
        T.StructField("fallback_selected", T.BooleanType()),
    ]
)

# Exact sums of amounts: four decimals keep sub-cent values, and decimal addition
# gives the same total whatever the partitioning.
MONEY = T.DecimalType(20, 4)
