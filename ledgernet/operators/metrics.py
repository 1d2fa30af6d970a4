"""Node metrics: weighted degree and neighbour entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgernet import vocabulary as V
from ledgernet.functions.amounts import edge_weight, lenient_number, money, money_sum, rounded_money
from ledgernet.functions.text import node_id
from ledgernet.graph import SpendGraph

#: The commitment column that names the one node of a type which a commitment has an edge with.
_KEYS = {V.ORGAO: "orgao_id", V.FORNECEDOR: "fornecedor_id"}


def both_ends(edges: DataFrame, *carry: Column | str, near: str = "node_id", far: str = "neighbor_id") -> DataFrame:
    """Every edge listed from each of its ends, reading the edges once."""
    ends = F.array(
        F.struct(F.col("src").alias(near), F.col("dst").alias(far)),
        F.struct(F.col("dst").alias(near), F.col("src").alias(far)),
    )
    return edges.select(F.inline(ends), *carry)


def typed_ids(vertices: DataFrame, node_type: str, name: str) -> DataFrame:
    return vertices.where(F.col("node_type") == node_type).select(F.col("id").alias(name))


def _incident(graph: SpendGraph, node_type: str) -> DataFrame:
    """``(node_id, weight)`` per edge end that may have the type."""
    weight = edge_weight(F.col("valor")).alias("weight")
    if graph.end_types is None:
        return both_ends(graph.edges, weight).select("node_id", "weight")
    # Known edge types: read only those that touch the node type, from the right side.
    parts = []
    for side, column in enumerate(("src", "dst")):
        types = [name for name, ends in graph.end_types.items() if ends[side] == node_type]
        touching = graph.edges.where(F.col("edge_type").isin(types))
        parts.append(touching.select(F.col(column).alias("node_id"), weight))
    return parts[0].unionByName(parts[1])


def weighted_degree(graph: SpendGraph, node_type: str) -> DataFrame:
    """``(node_id, centrality)``: total weight of incoming and outgoing edges.

    Edges are summed per node before they meet the vertices, so a hub costs one
    partial sum per map task. Nodes without edges are absent; a self-loop counts twice.
    Where the commitments are at hand, their keys are grouped and only the sums get ids.
    """
    if graph.commitments is not None and node_type in _KEYS:
        key = _KEYS[node_type]
        sums = graph.commitments.dropna(subset=[key]).groupBy(key).agg(
            money_sum(lenient_number(F.col("valor_empenhado"))).alias("centrality")
        )
        sums = sums.select(node_id(node_type, F.col(key)).alias("node_id"), "centrality")
        return sums.join(typed_ids(graph.vertices, node_type, "node_id"), "node_id", "left_semi")
    sums = _incident(graph, node_type).groupBy("node_id").agg(money_sum(F.col("weight")).alias("centrality"))
    return sums.join(typed_ids(graph.vertices, node_type, "node_id"), "node_id", "left_semi")


def _entropy(total: Column, positive: Column, weighted_log: Column) -> Column:
    """Base-2 entropy from three sums over a group: of w, of w where positive, of w*log2(w).

    Summing -(w/T)*log2(w/T) needs T per row, hence a window over the group; the same
    value follows from plain sums, which Spark combines before the shuffle.
    """
    bits = (F.log2(total) * positive - weighted_log) / total
    return F.when(total > 0, F.greatest(bits, F.lit(0.0))).otherwise(F.lit(0.0))


def _sums(weight: Column) -> list[Column]:
    positive = F.when(weight > 0, weight)
    return [
        money_sum(weight).alias("total"),
        F.coalesce(money_sum(positive), F.lit(0.0)).alias("positive"),
        F.coalesce(F.sum(positive * F.log2(positive)), F.lit(0.0)).alias("weighted_log"),
    ]


def entropy_of(values: DataFrame, group: str, value: str) -> DataFrame:
    """``(group, entropy)`` of the values of each group; a zero total gives 0.0."""
    sums = values.groupBy(group).agg(*_sums(F.col(value)))
    return sums.select(group, _entropy(F.col("total"), F.col("positive"), F.col("weighted_log")).alias("entropy"))


def neighbor_entropy(
    edges: DataFrame, vertices: DataFrame, focus_type: str, neighbor_type: str, per: str = "neighbor"
) -> DataFrame:
    """``(node_id, entropy)`` of a node's weight over its neighbours of one type.

    ``per="neighbor"`` merges parallel edges first; ``per="edge"`` gives every edge its
    own share. Both work on sums per pair of nodes, of which only those that start at a
    focus node are made. ``per="pair"`` is for projected edges, which are merged already and
    run from neighbours to focus nodes only: they are summed as they stand. Focus nodes
    without such neighbours get 0.0.
    """
    focus = typed_ids(vertices, focus_type, "node_id")
    if per == "pair":
        merged = edges.select(F.col("dst").alias("node_id"), rounded_money(edge_weight(F.col("valor"))).alias("total"))
        return focus.join(entropy_of(merged, "node_id", "total"), "node_id", "left").fillna(0.0, ["entropy"])
    listed = both_ends(edges, edge_weight(F.col("valor")).alias("weight")).join(focus, "node_id", "left_semi")
    pairs = listed.groupBy("node_id", "neighbor_id").agg(*_sums(F.col("weight")))
    pairs = pairs.join(typed_ids(vertices, neighbor_type, "neighbor_id"), "neighbor_id", "left_semi")
    if per == "edge":
        sums = pairs.groupBy("node_id").agg(
            F.sum(money(F.col("total"))).cast("double").alias("total"),
            F.sum(money(F.col("positive"))).cast("double").alias("positive"),
            F.sum("weighted_log").alias("weighted_log"),
        )
    elif per == "neighbor":
        sums = pairs.groupBy("node_id").agg(*_sums(F.col("total")))
    else:
        raise ValueError(f"unknown entropy mode {per!r}")
    scored = sums.select("node_id", _entropy(F.col("total"), F.col("positive"), F.col("weighted_log")).alias("entropy"))
    return focus.join(scored, "node_id", "left").fillna(0.0, ["entropy"])
