"""Vertices and edges of the spending graph from the normalised tables."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgernet import schema as S
from ledgernet import vocabulary as V
from ledgernet.functions.amounts import finite, lenient_number
from ledgernet.functions.dates import iso_text
from ledgernet.functions.text import label, node_id, nonblank
from ledgernet.graph import NUMBERED, SpendGraph
from ledgernet.operators.numbering import numbered
from ledgernet.sources.workspace import stored


def _vertex_columns(table: DataFrame, node_type: str, key: str, **columns) -> list[Column]:
    values = {
        "id": node_id(node_type, F.col(key)),
        "node_type": F.lit(node_type),
        "original_id": F.col(key).cast("string"),
        **columns,
    }
    for name in S.LINEAGE:
        if name in table.columns:
            values[name] = F.col(name)
    return [values.get(f.name, F.lit(None)).cast(f.dataType.simpleString()).alias(f.name) for f in S.VERTICES]


def _vertices(table: DataFrame, node_type: str, key: str, **columns) -> DataFrame:
    return table.select(*_vertex_columns(table, node_type, key, **columns))


def _commitment_columns(commitments: DataFrame) -> list[Column]:
    return _vertex_columns(
        commitments,
        V.EMPENHO,
        "empenho_id",
        nome=F.col("descricao"),
        numero=F.col("numero_empenho"),
        descricao=F.col("descricao"),
        valor=lenient_number(F.col("valor_empenhado")),
        data=iso_text(F.col("data_empenho")),
    )


def commitment_vertices(commitments: DataFrame) -> DataFrame:
    return commitments.select(*_commitment_columns(commitments))


def with_vertex(commitments: DataFrame, *values: Column) -> DataFrame:
    """The commitments with values over the columns of their own vertices."""
    aside = [F.col(c).alias(f"commitment_{c}") for c in commitments.columns]
    back = [F.col(f"commitment_{c}").alias(c) for c in commitments.columns]
    return commitments.select(*aside, *_commitment_columns(commitments)).select(*back, *values)


def supplier_vertices(suppliers: DataFrame) -> DataFrame:
    same = {c: F.col(c) for c in ("municipio", "uf", "documento", "tipo_documento")}
    return _vertices(suppliers, V.FORNECEDOR, "fornecedor_id", nome=F.col("nome_fornecedor"), **same)


def agency_vertices(agencies: DataFrame) -> DataFrame:
    same = {c: F.col(c) for c in ("sigla", "municipio", "uf")}
    return _vertices(agencies, V.ORGAO, "orgao_id", nome=F.col("nome_orgao"), **same)


def contract_vertices(commitments: DataFrame) -> DataFrame:
    """One vertex per distinct contract; it carries no attributes of its own."""
    return _vertices(
        commitments.select("contrato_id").dropna().distinct(), V.CONTRATO, "contrato_id"
    )


def build_vertices(
    commitments: DataFrame,
    suppliers: DataFrame | None = None,
    agencies: DataFrame | None = None,
    include_contracts: bool = False,
) -> DataFrame:
    """All vertices. A filter on ``node_type`` later prunes the other branches away."""
    frames = [commitment_vertices(commitments)]
    if suppliers is not None:
        frames.append(supplier_vertices(suppliers))
    if agencies is not None:
        frames.append(agency_vertices(agencies))
    if include_contracts:
        frames.append(contract_vertices(commitments))
    return reduce(DataFrame.unionByName, frames)


def _edge(edge_type: str, other_key: str) -> list[Column]:
    """The edge of a commitment to the end named by ``other_key``."""
    source_type, target_type = V.END_TYPES[edge_type]
    keys = {V.EMPENHO: "empenho_id"}
    return [
        node_id(source_type, F.col(keys.get(source_type, other_key))).alias("src"),
        node_id(target_type, F.col(keys.get(target_type, other_key))).alias("dst"),
        F.lit(edge_type).alias("edge_type"),
        lenient_number(F.col("valor_empenhado")).alias("valor"),
    ]


def build_edges(commitments: DataFrame, include_contracts: bool = False, one_pass: bool = False) -> DataFrame:
    """All edges, one per end that a commitment has; parallel edges are kept.

    Filters on ``edge_type`` prune branches. With ``one_pass`` there are none: for readers of
    all edges the commitments are read once.
    """
    other = {V.ORGAO_EMPENHO: "orgao_id", V.EMPENHO_FORNECEDOR: "fornecedor_id"}
    if include_contracts:
        other[V.EMPENHO_CONTRATO] = "contrato_id"
    if one_pass:
        each = [F.when(F.col(key).isNotNull(), F.struct(*_edge(name, key))) for name, key in other.items()]
        return commitments.select(F.inline(F.array_compact(F.array(*each))))
    frames = [commitments.dropna(subset=[key]).select(*_edge(name, key)) for name, key in other.items()]
    return reduce(DataFrame.unionByName, frames)


def build_graph(
    commitments: DataFrame,
    suppliers: DataFrame | None = None,
    agencies: DataFrame | None = None,
    include_contracts: bool = False,
    unique_commitments: bool = False,
    one_pass: bool = False,
) -> SpendGraph:
    """The graph of the normalised tables.

    ``unique_commitments`` states that no commitment id repeats, which lets the
    two-hop projection group the commitments directly. ``one_pass`` is for readers of
    all edges, as in ``build_edges``.
    """
    return SpendGraph(
        build_vertices(commitments, suppliers, agencies, include_contracts),
        build_edges(commitments, include_contracts, one_pass),
        end_types=V.END_TYPES,
        commitments=commitments if unique_commitments else None,
        built_from=frozenset(
            ["empenhos", *(["fornecedores"] if suppliers is not None else []), *(["orgaos"] if agencies is not None else []),
             *(["contratos"] if include_contracts else [])]
        ),
    )


def filter_period(commitments: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Commitments dated between two instants, both included; a null date fails any bound.

    Bounds are literals of the column's type, so the filter reaches the Parquet scan.
    """
    for bound, keep in ((start, "__ge__"), (end, "__le__")):
        if bound is not None:
            date = F.col("data_empenho")
            commitments = commitments.where(getattr(date, keep)(F.lit(str(bound)).cast("timestamp_ntz")))
    return commitments


def node_label() -> Column:
    return label(*[F.col(c) for c in ("nome", "descricao", "numero", "original_id", "id")])


def node_summaries(vertices: DataFrame) -> DataFrame:
    return vertices.select(
        "id",
        node_label().alias("label"),
        F.col("node_type").alias("type"),
        F.coalesce(nonblank(F.col("original_id")), F.col("id")).alias("original_id"),
        finite(F.col("valor")).alias("valor"),
    )


def number_ends(vertices: DataFrame) -> DataFrame:
    """``(id, node_type, original_id, number)``: agencies and suppliers in the order of their ids, stored."""
    ends = vertices.where(F.col("node_type").isin(V.ORGAO, V.FORNECEDOR)).where("id is not null")
    once = ends.groupBy("id").agg(F.min("node_type").alias("node_type"), F.min("original_id").alias("original_id"))
    return numbered(once, "id")


def around(graph: SpendGraph, numbers: Collection[int]) -> SpendGraph:
    """The part of a numbered graph that the edges of some agencies and suppliers span, over a stored table.

    It has all edges of these nodes and all their neighbours. An edge has a commitment at one end, so
    all edges among these nodes and their neighbours are there, too.
    """
    asked = sorted(numbers)
    touched = reduce(Column.__or__, [F.col(c).isin(asked) for c in NUMBERED.values()])
    commitments = stored(graph.commitments.where(touched), "around")
    ends = graph.vertices.where(F.col("node_type").isin(V.ORGAO, V.FORNECEDOR))
    vertices = commitment_vertices(commitments).unionByName(ends)
    contracts = "contratos" in graph.built_from
    if contracts:
        vertices = vertices.unionByName(contract_vertices(commitments))
    return replace(graph, vertices=vertices, edges=build_edges(commitments, contracts), commitments=commitments)


def _built_summary(graph: SpendGraph, commitments: DataFrame, suppliers: DataFrame, agencies: DataFrame) -> DataFrame:
    """The counts of ``graph_summary`` from the tables a graph was built from."""
    ends = ["orgao_id", "fornecedor_id", *(["contrato_id"] if "contratos" in graph.built_from else [])]
    contracts = F.count_distinct("contrato_id") if "contratos" in graph.built_from else F.lit(0)
    one = commitments.agg(
        F.count("*").alias("empenhos"),
        reduce(Column.__add__, [F.count(c) for c in ends]).alias("edges"),
        contracts.alias("contratos"),
    ).withColumns(
        {
            "fornecedores": suppliers.agg(F.count("*")).scalar(),
            "orgaos": agencies.agg(F.count("*")).scalar(),
        }
    )
    parts = [F.col(c) for c in ("empenhos", "contratos", "fornecedores", "orgaos") if c in graph.built_from]
    counts = {
        "nodes": reduce(Column.__add__, parts),
        **{name: F.col(name) for name in ("edges", "empenhos", "fornecedores", "orgaos")},
    }
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("table_name"), c.cast("long").alias("row_count")) for n, c in counts.items()])))


def dangling_edges(graph: SpendGraph) -> DataFrame:
    """Distinct edge ends with no vertex, with how many edges name them."""
    ends = graph.edges.select(
        "edge_type",
        F.inline(
            F.array(
                F.struct(F.lit("src").alias("side"), F.col("src").alias("node_id")),
                F.struct(F.lit("dst").alias("side"), F.col("dst").alias("node_id")),
            )
        ),
    )
    counted = ends.groupBy("edge_type", "side", "node_id").agg(F.count("*").alias("edge_count"))
    return counted.join(graph.vertices.select(F.col("id").alias("node_id")), "node_id", "left_anti")


def graph_summary(graph: SpendGraph, commitments: DataFrame, suppliers: DataFrame, agencies: DataFrame) -> DataFrame:
    """Row counts ``(table_name, row_count)`` of the graph and of the normalised tables.

    A graph that was built from exactly these commitments is counted in one pass over them
    and one over each other table.
    """
    if graph.commitments is not None and graph.built_from is not None:
        return _built_summary(graph, commitments, suppliers, agencies)
    tables = {
        "nodes": graph.vertices,
        "edges": graph.edges,
        "empenhos": commitments,
        "fornecedores": suppliers,
        "orgaos": agencies,
    }
    counts = [t.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, t in tables.items()]
    return reduce(DataFrame.unionByName, counts)
