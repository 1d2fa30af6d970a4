"""The report of a run: anomalies with their evidence packed as one document each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgernet import vocabulary as V
from ledgernet.graph import SpendGraph
from ledgernet.operators.evidence import vertex_facts
from ledgernet.plans.suite import Suite, run_suite


#: Links of one document; an anomaly with more keeps them all in the suite's tables.
MAX_LINKS = 1000


def analyze_graph(graph: SpendGraph, **options) -> DataFrame:
    """Run the default suite and give its report documents."""
    return report(run_suite(graph, **options), graph.vertices)


def _packed(table: DataFrame, name: str, order: list[str], columns: list[str]) -> DataFrame:
    """Rows of one anomaly as an ordered array of structs; evidence is small per anomaly."""
    item = F.struct(*order, F.struct(*columns).alias("item"))
    return table.groupBy("anomaly_id").agg(
        F.transform(F.sort_array(F.collect_list(item)), lambda x: x["item"]).alias(name)
    )


def report(suite: Suite, vertices: DataFrame, min_size: int = 2, max_links: int = MAX_LINKS) -> DataFrame:
    """``(detector, anomaly_id, score, document)``: the anomaly and its evidence as JSON, best scores first.

    Null fields are left out of the document. A document is of a size to show: evidence
    is at most 30 nodes per anomaly and, as parallel links have no bound, the ``max_links``
    largest links; ``link_count`` tells how many there are. The suite's tables stay flat
    and whole for everything else. ``min_size`` is the limit the communities were found by.
    """
    largest = Window.partitionBy("anomaly_id").orderBy(F.desc_nulls_last("valor"), "source", "target", "type")
    links = suite.links.withColumn("_place", F.row_number().over(largest)).where(F.col("_place") <= max_links)
    link_count = suite.links.groupBy("anomaly_id").agg(F.count("*").alias("link_count"))
    nodes = vertex_facts(vertices, suite.nodes).select(
        "anomaly_id", "position", F.col("node_id").alias("id"), "type", "label", F.col("node_valor").alias("valor")
    )
    neighbors = suite.neighbors.withColumnRenamed("neighbor_id", "id")
    packed = [
        _packed(neighbors, "top_neighbors", ["rank"], ["id", "label", "type", "edge_type", "valor", "node_valor"]),
        _packed(nodes, "nodes", ["position"], ["id", "type", "label", "valor"]),
        _packed(links, "links", ["source", "target", "type", "valor"], ["source", "target", "type", "valor"]),
        _packed(suite.samples.withColumnRenamed("node_id", "id"), "sample_nodes", ["position"], ["id"]),
    ]
    central = F.col("detector").isin(V.CENTRAL_SUPPLIERS, V.CENTRAL_AGENCIES)
    spread = F.col("detector") == V.ENTROPY_SUPPLIERS
    grouped = F.col("detector") == V.ISOLATED_COMMUNITIES
    full = suite.anomalies.withColumns(
        {
            "centrality": F.when(central, F.col("metric_value")),
            "entropy": F.when(spread, F.col("metric_value")),
            "focus_type": F.when(spread, F.col("node_type")),
            "community_id": F.when(grouped, F.replace("anomaly_id", F.concat("detector", F.lit("::")), F.lit(""))),
            # Only a community that is below the limit has a reason for being chosen.
            "fallback_reason": F.when(F.col("fallback_selected"), F.regexp_extract("reason", r"\((.*)\)$", 1)),
            "min_size_threshold": F.when(F.col("fallback_selected"), F.lit(min_size)),
            "fallback_selected": F.when(F.col("fallback_selected"), F.lit(True)),
        }
    )
    for table in [*packed, link_count]:
        full = full.join(table, "anomaly_id", "left")
    plain = [
        "top_neighbors", "neighbor_count", "node_id", "node_label", "node_type", "centrality", "entropy", "focus_type",
        "zscore", "rank", "link_count",
    ]
    community = [
        "community_id", "fallback_reason", "min_size_threshold", "node_count", "node_types", "isolation_score", "internal_edges", "external_edges", "edge_density",
        "fallback_selected",
    ]
    context = F.struct(
        *plain,
        *community,
        F.col("sample_nodes.id").alias("sample_nodes"),
        F.struct("nodes", "links", F.coalesce("node_id", F.col("nodes")[0]["id"]).alias("focus")).alias("subgraph"),
    )
    document = F.to_json(F.struct("score", "severity", "reason", context.alias("context")))
    documents = full.select("detector", "anomaly_id", "score", document.alias("document"))
    return documents.orderBy("detector", F.desc_nulls_last("score"), "anomaly_id")


def limit_per_detector(anomalies: DataFrame, limit: int | None = None) -> DataFrame:
    """The first ``limit`` anomalies of every detector by score."""
    if limit is None:
        return anomalies
    order = Window.partitionBy("detector").orderBy(F.col("score").desc(), "anomaly_id")
    return anomalies.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= limit).drop("_place")
