"""Evidence of anomalies: ego networks, their nodes and the links between them.

All anomalies are handled in one plan. ``centers(anomaly_id, center_id)`` drives it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgernet import vocabulary as V
from ledgernet.functions.amounts import finite
from ledgernet.graph import SpendGraph, without_loops
from ledgernet.operators.graph_build import node_label
from ledgernet.operators.projection import induced_edges


class Ego(NamedTuple):
    """``counts(anomaly_id, neighbor_count)`` and the top ``neighbors`` of every centre."""

    counts: DataFrame
    neighbors: DataFrame


def _incident(edges: DataFrame) -> DataFrame:
    """Every edge from each end; a self-loop once."""
    out = F.struct(F.col("src").alias("center_id"), F.col("dst").alias("neighbor_id"))
    back = F.struct(F.col("dst").alias("center_id"), F.col("src").alias("neighbor_id"))
    ends = F.when(F.col("src") == F.col("dst"), F.array(out)).otherwise(F.array(out, back))
    return edges.select(F.inline(ends), "edge_type", finite(F.col("valor")).alias("valor"))


def _incident_by_side(starting: DataFrame, ending: DataFrame) -> DataFrame:
    """Every edge from the ends that the sides name; of ``ending`` self-loops have to be left out."""

    def seen(edges: DataFrame, near: str, far: str) -> DataFrame:
        return edges.select(
            F.col(near).alias("center_id"), F.col(far).alias("neighbor_id"), "edge_type", finite(F.col("valor")).alias("valor")
        )

    return seen(starting, "src", "dst").unionByName(seen(ending, "dst", "src"))


def _incident_to(centers: DataFrame, starting: DataFrame, ending: DataFrame) -> DataFrame:
    """The edges of a few centres, from each end that is one; of ``ending`` self-loops have to be left out.

    Edges are looked up per end: that costs less than listing all of them from both.
    """

    def found(edges: DataFrame, near: str, far: str) -> DataFrame:
        return edges.join(F.broadcast(centers.withColumnRenamed("center_id", near)), near).select(
            "anomaly_id", F.col(near).alias("center_id"), F.col(far).alias("neighbor_id"), "edge_type",
            finite(F.col("valor")).alias("valor"),
        )

    return found(starting, "src", "dst").unionByName(found(ending, "dst", "src"))


def vertex_facts(vertices: DataFrame, ids: DataFrame) -> DataFrame:
    """``(node_id, label, type, node_valor)`` of ``ids(node_id)``; the id labels an unknown node."""
    known = vertices.join(ids.select(F.col("node_id").alias("id")).distinct(), "id", "left_semi").select(
        F.col("id").alias("node_id"),
        node_label().alias("label"),
        F.col("node_type").alias("type"),
        finite(F.col("valor")).alias("node_valor"),
    )
    return ids.join(known, "node_id", "left").withColumn("label", F.coalesce("label", "node_id"))


def ego_networks(
    centers: DataFrame,
    edges: DataFrame,
    neighbor_limit: int = 6,
    few: bool = False,
    sides: tuple[DataFrame, DataFrame] | None = None,
) -> Ego:
    """Incident-edge count and the ``neighbor_limit`` largest edges of every centre.

    Parallel edges are entries of their own. ``few`` says that the centres are a top-k
    list or were counted: they are broadcast and the edges are not shuffled. Otherwise edges are ranked and
    counted before they meet the centres, so that of a hub's edges each map task sends
    ``neighbor_limit`` and a count. ``sides`` are the edges that may start at a centre and those that
    may end at one, as far as that is known: no edge is then listed from an end that cannot be a centre.
    """
    columns = ["anomaly_id", "center_id", "rank", "neighbor_id", "edge_type", "valor"]
    if few:
        incident = _incident_to(centers, *(sides or (edges, without_loops(edges))))
    else:
        incident = _incident_by_side(*sides) if sides else _incident(edges)
    key = "anomaly_id" if few else "center_id"
    by_amount = Window.partitionBy(key).orderBy(F.col("valor").desc_nulls_last(), "neighbor_id", "edge_type")
    neighbors = incident.withColumn("rank", F.row_number().over(by_amount).cast("long")).where(
        F.col("rank") <= neighbor_limit
    )
    counts = incident.groupBy(key).agg(F.count("*").alias("neighbor_count"))
    if not few:
        neighbors = neighbors.join(centers, "center_id")
        counts = counts.join(centers, "center_id")
    return Ego(counts.select("anomaly_id", "neighbor_count"), neighbors.select(*columns))


def describe_neighbors(neighbors: DataFrame, vertices: DataFrame) -> DataFrame:
    """Neighbour rows with the label, type and amount of the neighbour."""
    named = neighbors.withColumnRenamed("neighbor_id", "node_id")
    return vertex_facts(vertices, named).select(
        "anomaly_id", "rank", F.col("node_id").alias("neighbor_id"), "label", "type", "edge_type", "valor", "node_valor"
    )


def evidence_nodes(
    centers: DataFrame, neighbors: DataFrame, extra: DataFrame | None = None, max_nodes: int = V.EVIDENCE_NODES
) -> DataFrame:
    """``(anomaly_id, node_id, position)``: centre, neighbours by rank, extra nodes in order.

    Each node counts once, at its first place; ``extra`` is ``(anomaly_id, node_id,
    member_rank)``. The first ``max_nodes`` are the evidence.
    """
    places = centers.select("anomaly_id", F.col("center_id").alias("node_id"), F.lit(0).cast("long").alias("place"))
    places = places.unionByName(
        neighbors.select("anomaly_id", F.col("neighbor_id").alias("node_id"), F.col("rank").alias("place"))
    )
    if extra is not None:
        after = F.lit(max_nodes) + F.col("member_rank")
        places = places.unionByName(extra.select("anomaly_id", "node_id", after.alias("place")))
    first = places.groupBy("anomaly_id", "node_id").agg(F.min("place").alias("place"))
    order = Window.partitionBy("anomaly_id").orderBy("place", "node_id")
    return (
        first.withColumn("position", (F.row_number().over(order) - 1).cast("long"))
        .where(F.col("position") < max_nodes)
        .select("anomaly_id", "node_id", "position")
    )


def first_members(labels: DataFrame, limit: int = V.EVIDENCE_NODES) -> DataFrame:
    """``(community, node_id, member_rank)``: the first members of every community by id."""
    order = Window.partitionBy("label").orderBy("node_id")
    return (
        labels.withColumn("member_rank", F.row_number().over(order).cast("long"))
        .where(F.col("member_rank") <= limit)
        .select(F.col("label").alias("community"), "node_id", "member_rank")
    )


def _link_columns() -> list:
    return [
        "anomaly_id",
        F.col("src").alias("source"),
        F.col("dst").alias("target"),
        F.col("edge_type").alias("type"),
        finite(F.col("valor")).alias("valor"),
    ]


def links_of_few(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Links inside the evidence of a top-k list of anomalies, whose nodes are broadcast."""
    start = F.broadcast(nodes.select("anomaly_id", F.col("node_id").alias("src")))
    end = F.broadcast(nodes.select("anomaly_id", F.col("node_id").alias("dst")))
    return edges.join(start, "src").join(end, ["anomaly_id", "dst"], "left_semi").select(*_link_columns())


def links_of_many(nodes: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """Links inside the evidence of any number of communities.

    ``members(anomaly_id, node_id)`` are the evidence nodes that belong to the
    community itself; a node belongs to one community only, so joining edges on a
    member end cannot multiply them, however many communities a hub is evidence of.
    Links between two outside nodes, at most a handful per community, are looked up
    by both ends.
    """
    keys = ["anomaly_id", "node_id"]
    numbered = edges.select("src", "dst", "edge_type", "valor")
    home = members.join(nodes, keys, "left_semi")

    def from_member(near: str, far: str) -> DataFrame:
        touched = numbered.join(home.select("anomaly_id", F.col("node_id").alias(near)), near)
        return touched.join(nodes.select("anomaly_id", F.col("node_id").alias(far)), ["anomaly_id", far], "left_semi")

    starts = from_member("src", "dst")
    # Edges that end at a member but start outside; those from a member are in ``starts``.
    ends = from_member("dst", "src").join(
        home.select("anomaly_id", F.col("node_id").alias("src")), ["anomaly_id", "src"], "left_anti"
    )
    outside = nodes.join(home, keys, "left_anti").select(*keys)
    ordered = outside.select("anomaly_id", F.col("node_id").alias("src")).join(
        outside.select("anomaly_id", F.col("node_id").alias("dst")), "anomaly_id"
    )
    between = numbered.join(ordered, ["src", "dst"])
    return starts.unionByName(ends).unionByName(between).select(*_link_columns())


def induced_subgraph(graph: SpendGraph, ids: DataFrame) -> SpendGraph:
    """The graph on ``ids(id)``: those vertices and the edges between them."""
    return SpendGraph(
        graph.vertices.join(ids.select("id"), "id", "left_semi").select(*graph.vertices.columns),
        induced_edges(graph.edges, ids),
        end_types=graph.end_types,
    )
