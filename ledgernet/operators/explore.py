"""Interactive questions about a graph: search, filters, neighbourhoods, totals."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgernet import vocabulary as V
from ledgernet.functions.amounts import finite
from ledgernet.functions.text import contains_text
from ledgernet.graph import SpendGraph
from ledgernet.operators.graph_build import build_edges, node_label, with_vertex
from ledgernet.operators.metrics import both_ends, typed_ids
from ledgernet.sources.workspace import cut_lineage

#: Hashes of ids that are broadcast, 8 bytes each.
FEW_MIXED = 100_000


def bound(text: str | float | None) -> Column | None:
    """A typed-in amount bound; empty or unreadable text means no bound."""
    if text is None or str(text).strip() == "":
        return None
    return finite(F.lit(str(text)).try_cast("double"))


def text_match(needle: str | None) -> Column:
    """Case-folded substring over everything that names a node."""
    if not needle:
        return F.lit(True)
    columns = [F.col(c) for c in ("nome", "descricao", "numero", "documento", "original_id")]
    return contains_text(needle, node_label(), *columns)


def passes(
    types: Sequence[str] = (),
    min_value: str | float | None = None,
    max_value: str | float | None = None,
    anomalies_only: bool = False,
    needle: str | None = None,
) -> Column:
    """The explorer filter over annotated vertices; a node without amount fails a bound."""
    valor = finite(F.col("valor"))
    test = F.lit(True)
    if types:
        test = test & F.col("node_type").isin(*types)
    low, high = bound(min_value), bound(max_value)
    if low is not None:
        test = test & (low.isNull() | F.coalesce(valor >= low, F.lit(False)))
    if high is not None:
        test = test & (high.isNull() | F.coalesce(valor <= high, F.lit(False)))
    if anomalies_only:
        test = test & F.col("is_anomalous")
    return test & text_match(needle)


def search_nodes(vertices: DataFrame, needle: str) -> DataFrame:
    return vertices.where(text_match(needle))


def catalog_filter(summaries: DataFrame, node_type: str = "all", needle: str = "") -> DataFrame:
    """Node list filter: type, and a substring of id and label."""
    wanted = needle.strip().lower()
    if node_type != "all":
        summaries = summaries.where(F.col("type") == node_type)
    if wanted:
        summaries = summaries.where(F.contains(F.lower(F.concat_ws(" ", "id", "label")), F.lit(wanted)))
    return summaries


def annotate_nodes(vertices: DataFrame, severities: DataFrame) -> DataFrame:
    """Vertices with ``is_anomalous`` and the worst severity of the anomalies naming them."""
    flags = severities.select(F.col("node_id").alias("id"), F.col("severity").alias("anomaly_severity"))
    return vertices.join(flags, "id", "left").withColumn("is_anomalous", F.col("anomaly_severity").isNotNull())


def nodes_with_risk(summaries: DataFrame, risk: DataFrame) -> DataFrame:
    scores = risk.select(F.col("node_id").alias("id"), F.col("score").alias("risk_score"), "signals")
    return summaries.join(scores, "id", "left")


def visible_links(edges: DataFrame, visible: DataFrame) -> DataFrame:
    """Edges whose two ends are visible: ``visible(id)``."""
    return edges.join(visible.select(F.col("id").alias("src")), "src", "left_semi").join(
        visible.select(F.col("id").alias("dst")), "dst", "left_semi"
    ).select(*edges.columns)


def _visible_commitments(commitments: DataFrame, test: Column) -> DataFrame:
    """The commitments whose id is that of a vertex that passes ``test``.

    A commitment that passes is one by itself. Others count if one of the same id passes: hashes of ids
    tell which may, and these few are looked up by id.
    """
    marked = with_vertex(commitments, F.coalesce(test, F.lit(False)).alias("passes")).where("empenho_id is not null")
    marked = marked.withColumn("hash", F.xxhash64("empenho_id"))
    groups = marked.groupBy("hash").agg(F.bool_or("passes").alias("some"), F.bool_and("passes").alias("all"))
    mixed = cut_lineage(groups.where("some and not all").select("hash"))
    kept = marked.where("passes")
    count = mixed.limit(FEW_MIXED + 1).count()
    if count:
        alike = marked.join(F.broadcast(mixed) if count <= FEW_MIXED else mixed, "hash", "left_semi")
        passing = alike.where("passes").select("empenho_id")
        kept = kept.unionByName(alike.where("not passes").join(passing, "empenho_id", "left_semi"))
    return kept.select(*commitments.columns)


def links_of_visible(graph: SpendGraph, test: Column, node_types: Collection[str]) -> DataFrame:
    """``visible_links`` of a graph whose visible vertices are those of ``node_types`` that pass ``test``.

    An edge of a built graph has a commitment at one end, whose vertex is made of the same row: this end
    is tested where the row lies, and only the other one is looked up among the vertices.
    """
    shown = graph.vertices.where(F.col("node_type").isin(*node_types) & test)
    if graph.commitments is None or not graph.made_with_edges(V.EMPENHO) or V.EMPENHO not in node_types:
        return visible_links(graph.edges_between(node_types), shown.select("id"))
    edges = build_edges(_visible_commitments(graph.commitments, test), "contratos" in graph.built_from)
    parts = [edges.where(F.lit(False))]
    for edge_type, (start, end) in graph.end_types.items():
        if {start, end} <= set(node_types):
            side, other = ("src", start) if end == V.EMPENHO else ("dst", end)
            parts.append(edges.where(F.col("edge_type") == edge_type).join(typed_ids(shown, other, side), side, "left_semi"))
    return reduce(DataFrame.unionByName, parts).select(*graph.edges.columns)


def adjacency(edges: DataFrame) -> DataFrame:
    """Distinct undirected neighbour pairs ``(node_id, neighbor_id)``, each listed both ways.

    Pairs are made distinct with the smaller end first, nulls before all, and listed from both
    ends after that: half the rows move.
    """
    src, dst = F.col("src"), F.col("dst")
    ordered = F.coalesce(src <= dst, src.isNull())
    pairs = edges.select(
        F.when(ordered, src).otherwise(dst).alias("node_id"), F.when(ordered, dst).otherwise(src).alias("neighbor_id")
    ).distinct()
    there = F.struct("node_id", "neighbor_id")
    back = F.struct(F.col("neighbor_id").alias("node_id"), F.col("node_id").alias("neighbor_id"))
    loop = F.col("node_id").eqNullSafe(F.col("neighbor_id"))
    return pairs.select(F.inline(F.when(loop, F.array(there)).otherwise(F.array(there, back))))


def neighbors_of(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct ``(target_id, node_id)``: the neighbours to highlight for ``targets(id)``; never itself."""
    wanted = targets.select(F.col("id").alias("target_id"))
    listed = both_ends(edges, near="target_id", far="node_id").where("target_id <> node_id")
    return listed.join(wanted, "target_id", "left_semi").distinct()


def value_extent(vertices: DataFrame) -> DataFrame:
    valor = finite(F.col("valor"))
    return vertices.agg(F.min(valor).alias("min_value"), F.max(valor).alias("max_value"))


def node_types(vertices: DataFrame) -> DataFrame:
    return vertices.select("node_type").where("node_type <> ''").distinct().orderBy("node_type")


def filter_summary(annotated: DataFrame, test: Column) -> DataFrame:
    """``(total, visible, visible_anomalous)`` in one pass."""
    return annotated.agg(
        F.count("*").alias("total"),
        F.count_if(test).alias("visible"),
        F.count_if(test & F.col("is_anomalous")).alias("visible_anomalous"),
    )
