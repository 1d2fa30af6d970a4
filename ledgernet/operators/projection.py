"""Edges between two node types: direct, and over a node in between."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgernet import vocabulary as V
from ledgernet.functions.amounts import edge_weight, lenient_number, money, money_sum
from ledgernet.functions.text import node_id
from ledgernet.graph import NUMBERED, SpendGraph
from ledgernet.operators.metrics import both_ends, typed_ids
from ledgernet.sources.workspace import cut_lineage, stored

#: Ends without a vertex that are broadcast, some 30 bytes each.
FEW_STRANGERS = 20_000


def typed_pairs(graph: SpendGraph, focus_type: str, neighbor_type: str) -> DataFrame:
    """``(focus_id, neighbor_id, weight)`` per edge between the two types, either direction."""
    listed = both_ends(
        graph.edges_between({focus_type, neighbor_type}), edge_weight(F.col("valor")).alias("weight"), near="focus_id", far="neighbor_id"
    )
    return listed.join(typed_ids(graph.vertices, focus_type, "focus_id"), "focus_id", "left_semi").join(
        typed_ids(graph.vertices, neighbor_type, "neighbor_id"), "neighbor_id", "left_semi"
    ).select("focus_id", "neighbor_id", "weight")


def project_bipartite(graph: SpendGraph, source_type: str, target_type: str) -> DataFrame:
    """``(source_id, target_id, weight)`` per edge that runs from one type to the other."""
    directed = graph.edges_from(source_type, target_type).select(
        F.col("src").alias("source_id"), F.col("dst").alias("target_id"), edge_weight(F.col("valor")).alias("weight")
    )
    return directed.join(typed_ids(graph.vertices, source_type, "source_id"), "source_id", "left_semi").join(
        typed_ids(graph.vertices, target_type, "target_id"), "target_id", "left_semi"
    ).select("source_id", "target_id", "weight")


def _between(pairs: DataFrame, graph: SpendGraph, source_type: str, target_type: str) -> DataFrame:
    """Keep pairs whose two ends are vertices of the types.

    Ids begin alike, which makes sorting the pairs by them slow: the larger type is hashed.
    """
    sources = typed_ids(graph.vertices, source_type, "source_id").hint("shuffle_hash")
    return pairs.join(sources, "source_id", "left_semi").join(
        typed_ids(graph.vertices, target_type, "target_id"), "target_id", "left_semi"
    ).select("source_id", "target_id", "weight", "edge_count")


def project_via(graph: SpendGraph, source_type: str, via_type: str, target_type: str) -> DataFrame:
    """``(source_id, target_id, weight, edge_count)`` over paths source -> via -> target.

    The weight of a path is the amount of its second edge. Parallel edges are merged
    on both sides before the join, so a path is met once per pair of ends. In a graph that was
    built with commitments in between, of which each has few edges, both halves are dealt out once,
    by the commitment, and merged and joined where they lie; every commitment that they name is a vertex.
    The pairs are then stored, and ends without a vertex looked for among theirs. Other edges are dealt
    by pairs first, so that a node in between with many edges is not one task's.
    """
    first = graph.edges_from(source_type, via_type).select(F.col("dst").alias("via_id"), F.col("src").alias("source_id"))
    second = graph.edges_from(via_type, target_type).select(F.col("src").alias("via_id"), F.col("dst").alias("target_id"), "valor")
    built = via_type == V.EMPENHO and graph.made_with_edges(via_type)
    if built:
        first, second = first.repartition("via_id"), second.repartition("via_id")
    first = first.groupBy("via_id", "source_id").agg(F.count("*").alias("first_count"))
    second = second.groupBy("via_id", "target_id").agg(
        F.sum(money(edge_weight(F.col("valor")))).alias("second_weight"), F.count("*").alias("second_count")
    )
    paths = first.join(second, "via_id")
    if not built:
        paths = paths.join(typed_ids(graph.vertices, via_type, "via_id"), "via_id", "left_semi")
    pairs = paths.groupBy("source_id", "target_id").agg(
        F.sum(F.col("first_count") * F.col("second_weight")).cast("double").alias("weight"),
        F.sum(F.col("first_count") * F.col("second_count")).alias("edge_count"),
    )
    if not built:
        return _between(pairs, graph, source_type, target_type)
    pairs = stored(pairs, "pairs")
    for end, node_type in (("source_id", source_type), ("target_id", target_type)):
        pairs = _of_known(pairs, end, pairs.select(end).distinct(), typed_ids(graph.vertices, node_type, end))
    return pairs.select("source_id", "target_id", "weight", "edge_count")


def _of_known(pairs: DataFrame, end: str, named: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs whose ``end`` is one of ``known``; ``named`` are all ends that pairs have.

    Ends without a vertex are looked for among the ends first: there are few as a rule, and the
    pairs need not move to be rid of them.
    """
    strangers = cut_lineage(named.join(known, end, "left_anti"))
    count = strangers.limit(FEW_STRANGERS + 1).count()
    if not count:
        return pairs
    if count <= FEW_STRANGERS:
        return pairs.join(F.broadcast(strangers), end, "left_anti")
    return pairs.join(known, end, "left_semi")


def agency_supplier_links(graph: SpendGraph, reread: bool = False) -> DataFrame:
    """The agency -> supplier projection over commitments.

    With the de-duplicated commitments at hand each of them is one path, so one
    aggregation gives the pairs; otherwise the edge table is joined with itself. ``reread`` says
    that commitments are read cheaply: their keys are then checked before the pairs are made.
    """
    if graph.commitments is None:
        return project_via(graph, V.ORGAO, V.EMPENHO, V.FORNECEDOR)
    keys = {"source_id": (V.ORGAO, "orgao_id"), "target_id": (V.FORNECEDOR, "fornecedor_id")}
    paths = graph.commitments.dropna(subset=["orgao_id", "fornecedor_id"])
    ids = {end: node_id(node_type, F.col(key)).alias(end) for end, (node_type, key) in keys.items()}
    summed = paths.groupBy("orgao_id", "fornecedor_id").agg(
        money_sum(lenient_number(F.col("valor_empenhado"))).alias("weight"), F.count("*").alias("edge_count")
    )
    if not reread:
        return _between(summed.select(*ids.values(), "weight", "edge_count"), graph, V.ORGAO, V.FORNECEDOR)
    # Pairs of an agency lie together, which readers of what is stored and its size gain by.
    pairs = summed.sortWithinPartitions("orgao_id").select(*ids.values(), "weight", "edge_count")
    for end, (node_type, key) in keys.items():
        named = paths.select(key).distinct().select(ids[end])
        pairs = _of_known(pairs, end, named, typed_ids(graph.vertices, node_type, end))
    return pairs.select("source_id", "target_id", "weight", "edge_count")


def numbered_links(graph: SpendGraph) -> DataFrame:
    """``agency_supplier_links`` of a numbered graph, with numbers as ids; those without a vertex have none."""
    source, target = NUMBERED["orgao_id"], NUMBERED["fornecedor_id"]
    summed = graph.commitments.dropna(subset=[source, target]).groupBy(source, target).agg(
        money_sum(lenient_number(F.col("valor_empenhado"))).alias("weight"), F.count("*").alias("edge_count")
    )
    return summed.select(F.col(source).alias("source_id"), F.col(target).alias("target_id"), "weight", "edge_count")


def as_edges(pairs: DataFrame, edge_type: str) -> DataFrame:
    """Projected pairs in the shape of the edge table."""
    return pairs.select(
        F.col("source_id").alias("src"),
        F.col("target_id").alias("dst"),
        F.lit(edge_type).alias("edge_type"),
        F.col("weight").alias("valor"),
    )


def induced_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids(id)``."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(
        ids.select(F.col("id").alias("dst")), "dst", "left_semi"
    ).select(*edges.columns)
