"""Anomaly detectors: metric, robust score, selection and evidence in one plan each."""

from __future__ import annotations

from collections.abc import Collection
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgernet import schema as S
from ledgernet import vocabulary as V
from ledgernet.functions.severity import robust_z, severity_from_z
from ledgernet.graph import SpendGraph
from ledgernet.operators import evidence as E
from ledgernet.operators.communities import isolation
from ledgernet.operators.graph_build import around
from ledgernet.operators.metrics import neighbor_entropy, weighted_degree
from ledgernet.operators.numbering import named
from ledgernet.operators.robust import median_and_mad
from ledgernet.sources.workspace import cut_lineage, few_rows


#: Communities whose centres are broadcast, some 100 bytes each, and looked up where the edges lie.
FEW = 20_000


_LINKS = ["anomaly_id", "source", "target", "type", "valor"]


class Findings(NamedTuple):
    """Anomalies and their evidence, as flat tables keyed by ``anomaly_id``."""

    anomalies: DataFrame
    neighbors: DataFrame
    nodes: DataFrame
    links: DataFrame
    samples: DataFrame


def _top_by_value(metric: DataFrame, group: str, top_k: int) -> DataFrame:
    """The ``top_k`` largest values per group with their ``rank``; ids break ties."""
    order = Window.partitionBy(group).orderBy(F.col("value").desc(), "node_id")
    return metric.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top_k)


def _with_z(chosen: DataFrame, stats: DataFrame, group: str) -> DataFrame:
    """Add the robust z-score; ``stats`` has one row per group."""
    z = robust_z(F.col("value"), F.col("median"), F.col("mad"))
    return chosen.join(F.broadcast(stats), group).withColumn("zscore", z).drop("median", "mad")


def rank_centrality(graph: SpendGraph, node_type: str, top_k: int = 8, zscore_threshold: float = 2.0) -> DataFrame:
    """``(node_type, node_id, value, rank, zscore)`` of the central nodes of one type.

    A node is a candidate by score or by rank, and the ``top_k`` best scores are kept.
    The score grows with the value, so these are the ``top_k`` largest values: only
    they are ranked.
    """
    metric = cut_lineage(
        weighted_degree(graph, node_type).select(
            F.lit(node_type).alias("node_type"), "node_id", F.col("centrality").alias("value")
        )
    )
    scored = _with_z(_top_by_value(metric, "node_type", top_k), median_and_mad(metric, "node_type", "value"), "node_type")
    return scored.where((F.col("zscore") >= zscore_threshold) | (F.col("rank") <= top_k))


def rank_entropy(
    edges: DataFrame,
    vertices: DataFrame,
    focus_type: str,
    neighbor_type: str,
    threshold: float | None = None,
    top_k: int = 6,
    zscore_threshold: float = 1.5,
    per: str = "neighbor",
) -> DataFrame:
    """``(node_type, node_id, value, rank, zscore)`` of the nodes of high entropy.

    Candidates reach the minimum entropy and the score; without any, the ``top_k``
    largest values stand in, whatever the minimum. Both tests grow with the value, so
    there is a candidate exactly when the largest value is one, and only the ``top_k``
    largest need looking at. The sample of the statistics is the nodes at or above the
    minimum, or all nodes if there are none.
    """
    minimum = 0.0 if threshold is None else threshold
    metric = cut_lineage(
        neighbor_entropy(edges, vertices, focus_type, neighbor_type, per).select(
            F.lit(focus_type).alias("node_type"), "node_id", F.col("entropy").alias("value")
        )
    )
    reached = metric.groupBy("node_type").agg((F.max("value") >= minimum).alias("any_reached"))
    sample = metric.join(F.broadcast(reached), "node_type").where(
        (F.col("value") >= minimum) | ~F.col("any_reached")
    )
    scored = _with_z(_top_by_value(metric, "node_type", top_k), median_and_mad(sample, "node_type", "value"), "node_type")
    candidate = (F.col("value") >= minimum) & (F.col("zscore") >= zscore_threshold)
    whole = Window.partitionBy("node_type")
    return (
        scored.withColumn("candidate", candidate)
        .withColumn("any_candidate", F.max("candidate").over(whole))
        .where(F.col("candidate") | ~F.col("any_candidate"))
        .drop("candidate", "any_candidate")
    )


def _anomaly_id(detector: str, key: Column) -> Column:
    return F.concat(F.lit(f"{detector}::"), key)


def conform(anomalies: DataFrame) -> DataFrame:
    """The report columns, null where a detector does not set them."""
    present = set(anomalies.columns)
    return anomalies.select(
        *[(F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType.simpleString()).alias(f.name) for f in S.ANOMALIES]
    )


def _named(ranked: DataFrame, detector: str, severity: Column, reason: str) -> DataFrame:
    """Ranked nodes, at most ``top_k``, as the start of report rows."""
    return few_rows(
        ranked.select(
            _anomaly_id(detector, F.col("node_id")).alias("anomaly_id"),
            F.lit(detector).alias("detector"),
            "node_id",
            "node_type",
            F.col("zscore").alias("score"),
            severity.alias("severity"),
            F.lit(reason).alias("reason"),
            F.col("value").alias("metric_value"),
            "zscore",
            "rank",
        )
    )


def central_nodes(
    graph: SpendGraph, node_type: str, detector: str, top_k: int = 8, zscore_threshold: float = 2.0
) -> DataFrame:
    """Findings of ``rank_centrality`` without evidence."""
    ranked = rank_centrality(graph, node_type, top_k, zscore_threshold)
    return _named(ranked, detector, severity_from_z(F.col("zscore")), V.REASON_CENTRALITY)


def entropy_nodes(
    graph: SpendGraph,
    focus_type: str,
    neighbor_type: str,
    detector: str = V.ENTROPY_SUPPLIERS,
    links: DataFrame | None = None,
    numbers: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Findings of ``rank_entropy`` over ``links``, by default the graph's own edges, without evidence.

    With ``numbers``, those of the graph, the links name nodes by number.
    """
    vertices = graph.vertices if numbers is None else numbered_vertices(numbers)
    ranked = rank_entropy(graph.edges if links is None else links, vertices, focus_type, neighbor_type, **options)
    if numbers is not None:
        ranked = named(ranked, numbers, "node_id")
    severity = severity_from_z(F.col("zscore") + V.ENTROPY_SEVERITY_SHIFT)
    return _named(ranked, detector, severity, V.REASON_ENTROPY.format(neighbor_type=neighbor_type))


def numbered_vertices(numbers: DataFrame) -> DataFrame:
    """Agencies and suppliers with their numbers as ids."""
    return numbers.select(F.col("number").alias("id"), "node_type")


def with_evidence(found: DataFrame, graph: SpendGraph, node_types: Collection[str]) -> Findings:
    """Ego-network evidence from the graph for the findings of any number of top-k detectors.

    Each evidence table reads the edges once for all of them, and of those only the
    types that the ``node_types`` of the findings can have part in. Of a numbered graph
    the commitments that touch a finding are looked up once by number and stored.
    """
    if graph.numbers is not None:
        asked = graph.numbers.join(F.broadcast(found.select(F.col("node_id").alias("id")).distinct()), "id", "left_semi")
        graph = around(graph, [row["number"] for row in asked.select("number").collect()])
    centers = found.select("anomaly_id", F.col("node_id").alias("center_id"))
    starting, ending = graph.edges_by_side(node_types)
    # Literals are looked up before the other columns of an edge are made.
    ids = [row["node_id"] for row in found.select("node_id").distinct().collect()]
    sides = (starting.where(F.col("src").isin(ids)), ending.where(F.col("dst").isin(ids)))
    ego = E.ego_networks(centers, graph.edges_touching(node_types), few=True, sides=sides)
    neighbors = few_rows(ego.neighbors)
    nodes = few_rows(E.evidence_nodes(centers, neighbors))
    near = graph.neighbor_types(node_types)
    vertices, edges = graph.vertices, graph.edges
    if near is not None:
        vertices = vertices.where(F.col("node_type").isin(sorted(near)))
        edges = graph.edges_between(near)
    facts = E.vertex_facts(
        graph.vertices.where(F.col("node_type").isin(sorted(node_types))), found.select("node_id").distinct()
    )
    anomalies = (
        found.join(facts.select("node_id", F.col("label").alias("node_label")), "node_id")
        .join(ego.counts, "anomaly_id", "left")
        .withColumn("neighbor_count", F.coalesce("neighbor_count", F.lit(0)))
    )
    return Findings(
        conform(anomalies),
        E.describe_neighbors(neighbors, vertices),
        nodes,
        E.links_of_few(nodes, edges),
        nodes.where(F.lit(False)),
    )


def centrality_outliers(graph: SpendGraph, node_type: str, detector: str, **options) -> Findings:
    """The most central nodes of a type with their evidence."""
    return with_evidence(central_nodes(graph, node_type, detector, **options), graph, {node_type})


def entropy_outliers(graph: SpendGraph, focus_type: str, neighbor_type: str, **options) -> Findings:
    """The nodes of high neighbour entropy with their evidence, which comes from the graph."""
    return with_evidence(entropy_nodes(graph, focus_type, neighbor_type, **options), graph, {focus_type})


def score_communities(measures: DataFrame, min_size: int = 2) -> DataFrame:
    """Communities that count as isolated-community findings.

    All of at least ``min_size`` nodes; if none is, the largest community, the most
    isolated among equals, with ``fallback_selected``.
    """
    flag = F.lit(V.ISOLATED_COMMUNITIES).alias("detector")
    large = measures.where(F.col("size") >= min_size).select(
        "*", flag, F.lit(False).alias("fallback_selected"), F.lit(V.REASON_COMMUNITY).alias("reason")
    )
    note = V.REASON_COMMUNITY + V.REASON_BELOW_MIN_SIZE.format(min_size=min_size)
    best = (
        measures.orderBy(F.col("size").desc(), F.col("isolation_score").desc(), "community")
        .limit(1)
        .select("*", flag, F.lit(True).alias("fallback_selected"), F.lit(note).alias("reason"))
        # The largest community is below the limit only if all of them are.
        .where(F.col("size") < min_size)
    )
    return large.unionByName(best)


def isolated_communities(
    edges: DataFrame,
    vertices: DataFrame,
    labels: DataFrame,
    min_size: int = 2,
    detector: str = V.ISOLATED_COMMUNITIES,
    numbers: DataFrame | None = None,
) -> Findings:
    """Findings on the communities of ``labels(node_id, label)`` over one edge table.

    The number of communities is open: their centres are counted, and broadcast up to ``FEW``.
    With ``numbers`` edges and labels name nodes by number; what is found gets ids.
    """
    described = vertices
    if numbers is not None:
        vertices = numbered_vertices(numbers)

    def told(table: DataFrame, *columns: str) -> DataFrame:
        if numbers is None:
            return table
        key = F.substring_index("anomaly_id", "::", -1).cast("long")
        by_id = named(table.withColumn("anomaly_id", key), numbers, "anomaly_id", *columns)
        return by_id.withColumn("anomaly_id", _anomaly_id(detector, F.col("anomaly_id")))

    chosen = cut_lineage(
        score_communities(isolation(edges, vertices, labels), min_size).withColumn(
            "anomaly_id", _anomaly_id(detector, F.col("community"))
        )
    )
    own = labels.join(chosen.select(F.col("community").alias("label")), "label", "left_semi")
    members = cut_lineage(
        E.first_members(own).select(_anomaly_id(detector, F.col("community")).alias("anomaly_id"), "node_id", "member_rank")
    )
    centers = members.where("member_rank = 1").select("anomaly_id", F.col("node_id").alias("center_id"))
    few = centers.limit(FEW + 1).count() <= FEW
    ego = E.ego_networks(centers, edges, neighbor_limit=4, few=few)
    neighbors = cut_lineage(ego.neighbors)
    nodes = cut_lineage(E.evidence_nodes(centers, neighbors, members))
    # Which evidence nodes belong to their community: the first members and any
    # neighbour with the community's label.
    inside = nodes.join(
        own.select("node_id", _anomaly_id(detector, F.col("label")).alias("anomaly_id")),
        ["anomaly_id", "node_id"],
        "left_semi",
    )
    anomalies = chosen.join(ego.counts, "anomaly_id", "left").withColumns(
        {
            "detector": F.lit(detector),
            "score": F.col("isolation_score"),
            "node_count": F.col("size"),
            "neighbor_count": F.coalesce("neighbor_count", F.lit(0)),
        }
    )
    return Findings(
        conform(told(anomalies)),
        E.describe_neighbors(told(neighbors, "center_id", "neighbor_id"), described),
        told(nodes, "node_id").select(*nodes.columns),
        told(E.links_of_many(nodes, inside, edges), "source", "target").select(*_LINKS),
        told(members, "node_id").select("anomaly_id", "node_id", (F.col("member_rank") - 1).alias("position")),
    )
