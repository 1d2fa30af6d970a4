"""The default suite: four detectors and the risk of the nodes they name."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgernet import vocabulary as V
from ledgernet.graph import SpendGraph
from ledgernet.operators.communities import label_propagation
from ledgernet.operators.projection import agency_supplier_links, as_edges, numbered_links, project_bipartite
from ledgernet.operators.risk import anomaly_members, node_risk
from ledgernet.plans.detectors import (
    Findings,
    central_nodes,
    entropy_nodes,
    isolated_communities,
    numbered_vertices,
    with_evidence,
)
from ledgernet.sources.workspace import concurrently, stored

PROJECTED_EDGE = "orgao_fornecedor"


class Suite(NamedTuple):
    anomalies: DataFrame
    neighbors: DataFrame
    nodes: DataFrame
    links: DataFrame
    samples: DataFrame
    risk: DataFrame


def agency_supplier_edges(graph: SpendGraph, one_hop: bool = False, reread: bool = False) -> DataFrame:
    """Agency -> supplier edges: over commitments, or only those in the edge table."""
    pairs = project_bipartite(graph, V.ORGAO, V.FORNECEDOR) if one_hop else agency_supplier_links(graph, reread)
    return as_edges(pairs, PROJECTED_EDGE)


def run_suite(graph: SpendGraph, one_hop: bool = False, max_iter: int = 20, **propagation) -> Suite:
    """All detectors on one graph.

    Centrality reads the graph's edges. Entropy and communities read agency -> supplier
    edges projected over commitments. With ``one_hop`` they see only direct edges, of
    which a built graph has none: entropies are then 0.0 and no community is found.
    """
    ends = graph.vertices.where(F.col("node_type").isin(V.ORGAO, V.FORNECEDOR))

    # Projected pairs and what is made of them are cheaper to move and to compare as numbers.
    numbers = None if one_hop else graph.numbers

    def spread_suppliers() -> tuple[DataFrame, DataFrame]:
        if numbers is None:
            projected = stored(agency_supplier_edges(graph, one_hop, reread=True), "projected")
        else:
            projected = as_edges(stored(numbered_links(graph).drop("edge_count"), "projected"), PROJECTED_EDGE)
        # Projected pairs are merged already; direct edges count one by one.
        per = "edge" if one_hop else "pair"
        return projected, entropy_nodes(graph, V.FORNECEDOR, V.ORGAO, links=projected, numbers=numbers, per=per)

    suppliers, agencies, (projected, spread) = concurrently(
        lambda: central_nodes(graph, V.FORNECEDOR, V.CENTRAL_SUPPLIERS),
        lambda: central_nodes(graph, V.ORGAO, V.CENTRAL_AGENCIES),
        spread_suppliers,
    )

    def communities() -> list[Findings]:
        if projected.isEmpty():
            return []
        if numbers is not None:
            propagation["numbers_as_ids"] = True
        nodes = ends if numbers is None else numbered_vertices(numbers)
        labels = stored(label_propagation(projected, nodes.select("id"), max_iter=max_iter, **propagation), "labels")
        return [isolated_communities(projected, ends, labels, numbers=numbers)]

    nodes = suppliers.unionByName(agencies).unionByName(spread)
    found, grouped = concurrently(lambda: with_evidence(nodes, graph, {V.FORNECEDOR, V.ORGAO}), communities)
    return _combine([found, *grouped])


def _combine(findings: list[Findings]) -> Suite:
    merged = Findings(*[reduce(DataFrame.unionByName, tables) for tables in zip(*findings)])
    members = anomaly_members(merged.anomalies, merged.nodes, merged.samples)
    return Suite(*merged, node_risk(merged.anomalies, members))
