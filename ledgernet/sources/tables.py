"""The star-schema tables read as spending records.

A line item with its order is a commitment: the customer is the agency that commits,
the supplier is paid, the order is the contract.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgernet import schema as S
from ledgernet import vocabulary as V
from ledgernet.graph import NUMBERED, SpendGraph
from ledgernet.operators.graph_build import agency_vertices, build_graph, number_ends, supplier_vertices
from ledgernet.operators.normalize import Collections
from ledgernet.sources.workspace import stored


#: Columns of a commitment that name rows of other tables.
_KEYS = ["fornecedor_id", "orgao_id", "contrato_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _typed(df: DataFrame, schema, **columns) -> DataFrame:
    return df.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType.simpleString()).alias(f.name) for f in schema])


def _lines(spark: SparkSession, sf_dir: str, numbers: DataFrame | None = None) -> DataFrame:
    """What commitments are made of, as the tables hold it: line items with the customer of their order.

    With ``numbers`` of the ends they carry these; orders get theirs before they meet the lines.
    """
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    carried = []
    if numbers is not None:
        orders = _with_number(orders.select("o_orderkey", "o_custkey"), "o_custkey", numbers, V.ORGAO, "orgao_id")
        lines = _with_number(lines, "l_suppkey", numbers, V.FORNECEDOR, "fornecedor_id")
        carried = list(NUMBERED.values())
        # Sorting the lines for this join costs more than all else that is done to store them.
        orders = orders.hint("shuffle_hash")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_extendedprice",
        "l_shipdate", "o_custkey", *carried,
    )


def _with_number(rows: DataFrame, key: str, numbers: DataFrame, node_type: str, named: str) -> DataFrame:
    """The rows with the number of the vertex that ``key`` names, null if there is none."""
    of_key = numbers.where(F.col("node_type") == node_type).select(
        F.col("original_id").try_cast(rows.schema[key].dataType).alias(key), F.col("number").alias(NUMBERED[named])
    )
    return rows.join(of_key, key, "left")


def _commitment_columns() -> dict[str, Column]:
    return {
        "empenho_id": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        "numero_empenho": F.concat_ws("-", "l_orderkey", "l_linenumber"),
        "descricao": F.concat("l_returnflag", "l_linestatus"),
        "valor_empenhado": F.col("l_extendedprice"),
        "data_empenho": F.col("l_shipdate"),
        "fornecedor_id": F.col("l_suppkey"),
        "orgao_id": F.col("o_custkey"),
        "contrato_id": F.col("l_orderkey"),
    }


def commitments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _typed(_lines(spark, sf_dir), S.COMMITMENTS, **_commitment_columns())


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    joined = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return _typed(
        joined, S.SUPPLIERS, fornecedor_id=F.col("s_suppkey"), nome_fornecedor=F.col("s_name"), uf=F.col("n_name")
    )


def agencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    joined = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return _typed(
        joined,
        S.AGENCIES,
        orgao_id=F.col("c_custkey"),
        nome_orgao=F.col("c_name"),
        sigla=F.col("c_mktsegment"),
        uf=F.col("n_name"),
    )


def collections(spark: SparkSession, sf_dir: str) -> Collections:
    return Collections(commitments(spark, sf_dir), suppliers(spark, sf_dir), agencies(spark, sf_dir))


def graph(spark: SparkSession, sf_dir: str, include_contracts: bool = True, one_pass: bool = False) -> SpendGraph:
    """The spending graph of the tables; the four-part commitment key is unique."""
    return build_graph(
        *collections(spark, sf_dir), include_contracts=include_contracts, unique_commitments=True, one_pass=one_pass
    )


def stored_graph(spark: SparkSession, sf_dir: str, with_numbers: bool = False) -> SpendGraph:
    """The same graph over a stored commitment table, for plans that read it many times.

    Vertices and edges are projections of it, so the join of lines and orders runs once
    and nothing but its narrow result is written: numbers, of which a reader makes the texts
    that it needs. The keys of other tables stay numbers, so that grouping by them is cheap.
    ``with_numbers`` adds the places of agencies and suppliers in the order of their ids.
    """
    ends = suppliers(spark, sf_dir), agencies(spark, sf_dir)
    numbers = None
    if with_numbers:
        numbers = stored(number_ends(supplier_vertices(ends[0]).unionByName(agency_vertices(ends[1]))), "numbers")
    kept = [c for c in S.COMMITMENTS.names if c not in S.LINEAGE]
    columns = _commitment_columns()
    typed = {f.name: columns[f.name].cast(f.dataType.simpleString()) for f in S.COMMITMENTS if f.name in kept}
    typed.update({name: columns[name] for name in _KEYS})
    if with_numbers:
        typed.update({name: F.col(name) for name in NUMBERED.values()})
    narrow = stored(_lines(spark, sf_dir, numbers), "commitments").select(*[c.alias(n) for n, c in typed.items()])
    graph = build_graph(narrow, *ends, include_contracts=True, unique_commitments=True)
    return replace(graph, numbers=numbers)


def raw_collections(spark: SparkSession, sf_dir: str) -> Collections:
    """The same records in payload form: field names of the source, everything text."""
    c, s, a = collections(spark, sf_dir)

    def text(df: DataFrame, schema, **names) -> DataFrame:
        return df.select(*[F.col(names.get(f.name, f.name)).cast("string").alias(f.name) for f in schema])

    dated = c.withColumn("data_empenho", F.date_format("data_empenho", "yyyy-MM-dd"))
    return Collections(
        text(dated, S.RAW_COMMITMENT, id="empenho_id", numero="numero_empenho", unidade_gestora_id="orgao_id"),
        text(s, S.RAW_SUPPLIER, id="fornecedor_id", nome="nome_fornecedor"),
        text(a, S.RAW_AGENCY, id="orgao_id", nome="nome_orgao"),
    )
