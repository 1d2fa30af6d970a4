"""Queries on detectors, evidence, risk and exploration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgernet import vocabulary as V
from ledgernet.catalog.graph import nation_labels
from ledgernet.catalog.registered import query
from ledgernet.catalog.sql import COMMUNITY_ROW, statement
from ledgernet.operators import communities as C
from ledgernet.operators import evidence as E
from ledgernet.operators import explore as X
from ledgernet.operators import graph_build as G
from ledgernet.operators import risk as K
from ledgernet.plans import detectors as D
from ledgernet.plans.report import limit_per_detector as first_per_detector
from ledgernet.plans.report import report
from ledgernet.plans.suite import Suite, agency_supplier_edges, run_suite
from ledgernet.sources import tables as T
from ledgernet.sources.workspace import stored


def _rounded(anomalies: DataFrame, *columns: str) -> DataFrame:
    digits = {"score": 6, "zscore": 6, "metric_value": 2, "isolation_score": 6, "edge_density": 6}
    return anomalies.select(
        *[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in columns]
    )


def _supplier_outliers(graph):
    return D.centrality_outliers(graph, V.FORNECEDOR, V.CENTRAL_SUPPLIERS)


def _suite(spark, sf_dir) -> Suite:
    """All four detectors on the stored graph."""
    return run_suite(T.stored_graph(spark, sf_dir, with_numbers=True))


def _members(found: Suite) -> DataFrame:
    return K.anomaly_members(found.anomalies, found.nodes, found.samples)


_OUTLIER = """select node_id, o.node_type, round(score, 6) as score, round(zscore, 6) as zscore, rank, severity, reason,
    round(metric_value, 2) as metric_value, neighbor_count, label as node_label
  from outliers_{name} o join labelled v on id = node_id
  join (select center_id, count(*) as neighbor_count from incident group by 1) on center_id = node_id"""


def _outlier_sql(name: str) -> str:
    return statement(_OUTLIER.format(name=name), f"outliers_{name}", "labelled", "incident")


_OUTLIER_COLUMNS = [
    "node_id", "node_type", "score", "zscore", "rank", "severity", "reason", "metric_value", "neighbor_count", "node_label",
]


@query("outliers_suppliers", _outlier_sql("suppliers"))
def outliers_suppliers(spark, sf_dir):
    return _rounded(_supplier_outliers(T.stored_graph(spark, sf_dir)).anomalies, *_OUTLIER_COLUMNS)


@query("outliers_agencies", _outlier_sql("agencies"))
def outliers_agencies(spark, sf_dir):
    found = D.centrality_outliers(T.stored_graph(spark, sf_dir), V.ORGAO, V.CENTRAL_AGENCIES)
    return _rounded(found.anomalies, *_OUTLIER_COLUMNS)


@query("outliers_entropy", _outlier_sql("entropy"))
def outliers_entropy(spark, sf_dir):
    graph = T.stored_graph(spark, sf_dir)
    links = stored(agency_supplier_edges(graph), "projected")
    found = D.entropy_outliers(graph, V.FORNECEDOR, V.ORGAO, links=links, per="pair")
    return _rounded(found.anomalies, *_OUTLIER_COLUMNS)


@query(
    "centrality_rank",
    statement(
        """select node_type, node_id, round(value, 2) as value, rank, round(zscore, 6) as zscore from top_suppliers
        union all select node_type, node_id, round(value, 2), rank, round(zscore, 6) from top_agencies""",
        "top_suppliers", "top_agencies",
    ),
)
def centrality_rank(spark, sf_dir):
    graph = T.graph(spark, sf_dir)
    ranked = D.rank_centrality(graph, V.FORNECEDOR).unionByName(D.rank_centrality(graph, V.ORGAO))
    return ranked.select("node_type", "node_id", F.round("value", 2).alias("value"), "rank", F.round("zscore", 6).alias("zscore"))


_COMMUNITY_COLUMNS = [
    "score", "severity", "reason", "node_count", "node_types", "isolation_score", "internal_edges", "external_edges",
    "edge_density", "fallback_selected",
]
_COMMUNITY = f"select {COMMUNITY_ROW} from nation_communities"


def _community_rows(found: D.Findings) -> DataFrame:
    community = F.replace("anomaly_id", F.lit(f"{V.ISOLATED_COMMUNITIES}::"), F.lit(""))
    rows = found.anomalies.withColumn("node_types", F.array_join("node_types", ","))
    return _rounded(rows.withColumn("community", community), "community", *_COMMUNITY_COLUMNS)


def _nation_findings(spark, sf_dir, min_size=2) -> D.Findings:
    graph = T.graph(spark, sf_dir)
    links = stored(agency_supplier_edges(graph), "projected")
    return D.isolated_communities(links, graph.vertices, nation_labels(graph), min_size)


@query("isolated_communities", statement(_COMMUNITY, "nation_communities"))
def isolated_communities(spark, sf_dir):
    return _community_rows(_nation_findings(spark, sf_dir))


@query(
    "community_fallback",
    statement(
        _COMMUNITY.replace(
            "externas' as", "externas (componente abaixo do limiar mínimo considerado: 1000000000)' as"
        ).replace("false as", "true as")
        + " qualify row_number() over (order by size desc, nation_communities.isolation_score desc, community) = 1",
        "nation_communities",
    ),
)
def community_fallback(spark, sf_dir):
    """No community is large enough, so the best small one is reported."""
    return _community_rows(_nation_findings(spark, sf_dir, min_size=1_000_000_000))


@query(
    "isolated_communities_lpa",
    statement(f"select {COMMUNITY_ROW} from voted_communities where size >= 2", "voted_communities"),
)
def isolated_communities_lpa(spark, sf_dir):
    """The communities that twenty rounds of label propagation find."""
    graph = T.graph(spark, sf_dir)
    links = stored(agency_supplier_edges(graph), "projected")
    ends = graph.vertices.where(F.col("node_type").isin(V.ORGAO, V.FORNECEDOR))
    labels = stored(C.label_propagation(links, ends.select("id")), "labels")
    return _community_rows(D.isolated_communities(links, ends, labels))


@query(
    "ego_network",
    statement(
        """select e.center_id, e.rank, e.neighbor_id, label, v.node_type as type, e.edge_type, e.valor, v.valor as node_valor,
          neighbor_count
        from ego e join labelled v on v.id = e.neighbor_id
        where rank <= 6 and anomaly_id like 'centralidade_fornecedores%'""",
        "ego", "labelled",
    ),
)
def ego_network(spark, sf_dir):
    """The neighbourhoods of the central suppliers."""
    graph = T.stored_graph(spark, sf_dir)
    found = _supplier_outliers(graph)
    centers = found.anomalies.select("anomaly_id", F.col("node_id").alias("center_id"), "neighbor_count")
    return found.neighbors.join(centers, "anomaly_id").drop("anomaly_id")


@query("evidence_nodes", statement("select anomaly_id, node_id, position from evidence", "evidence"))
def evidence_nodes(spark, sf_dir):
    return _suite(spark, sf_dir).nodes


@query(
    "evidence_links",
    statement(
        """select a.anomaly_id, src as source, dst as target, edge_type as type, round(valor, 2) as valor from edges
        join node_evidence a on a.node_id = src join node_evidence b on b.node_id = dst and b.anomaly_id = a.anomaly_id
        union all
        select 'comunidades_isoladas::' || a.label, source_id, target_id, 'orgao_fornecedor', round(weight, 2) from projected
        join voted_shown a on a.node_id = source_id join voted_shown b on b.node_id = target_id and b.label = a.label
        join community_anomalies c on c.community = a.label""",
        "node_evidence", "edges", "projected", "voted_shown", "community_anomalies",
    ),
)
def evidence_links(spark, sf_dir):
    return _suite(spark, sf_dir).links.withColumn("valor", F.round("valor", 2))


@query(
    "community_evidence_nodes",
    statement("select label as community, node_id, position from nation_shown", "nation_shown"),
)
def community_evidence_nodes(spark, sf_dir):
    return _of_community(_nation_findings(spark, sf_dir).nodes)


@query(
    "community_evidence_links",
    statement(
        """select a.label as community, source_id as source, target_id as target, round(weight, 2) as valor
        from projected join nation_shown a on a.node_id = source_id
        join nation_shown b on b.node_id = target_id and b.label = a.label""",
        "projected", "nation_shown",
    ),
)
def community_evidence_links(spark, sf_dir):
    links = _of_community(_nation_findings(spark, sf_dir).links)
    return links.select("community", "source", "target", F.round("valor", 2).alias("valor"))


def _of_community(table: DataFrame) -> DataFrame:
    return table.withColumn("community", F.substring_index("anomaly_id", "::", -1)).drop("anomaly_id")


@query("anomaly_members", statement("select anomaly_id, node_id from members", "members"))
def anomaly_members(spark, sf_dir):
    return _members(_suite(spark, sf_dir))


@query("node_risk", statement("select node_id, round(score, 6) as score, signals from risk", "risk"))
def node_risk(spark, sf_dir):
    found = _suite(spark, sf_dir)
    return _rounded(K.node_risk(found.anomalies, _members(found)), "node_id", "score", "signals")


_WORD = "case worst when 3 then 'alta' when 2 then 'media' else 'baixa' end"


@query("node_severity", statement(f"select node_id, {_WORD} as severity, signals from severities", "severities"))
def node_severity(spark, sf_dir):
    found = _suite(spark, sf_dir)
    return K.node_severity(K.node_signals(found.anomalies, _members(found)))


@query(
    "node_signals",
    statement(
        """select anomaly_id, m.node_id, detector, reason, severity, round(score, 6) as score
        from members m join anomalies using (anomaly_id)""",
        "members", "anomalies",
    ),
)
def node_signals(spark, sf_dir):
    found = _suite(spark, sf_dir)
    signals = K.node_signals(found.anomalies, _members(found))
    return _rounded(signals, "anomaly_id", "node_id", "detector", "reason", "severity", "score")


@query(
    "anomaly_severity_counts",
    statement(
        """select severity, count(*) as anomalies from anomalies group by 1
        union all select 'total', count(*) from anomalies""",
        "anomalies",
    ),
)
def anomaly_severity_counts(spark, sf_dir):
    return K.count_by_severity(_suite(spark, sf_dir).anomalies)


@query(
    "anomaly_counter",
    statement("select detector, severity, count(*) as anomalies from anomalies group by 1, 2", "anomalies"),
)
def anomaly_counter(spark, sf_dir):
    return K.count_by_detector(_suite(spark, sf_dir).anomalies)


@query(
    "limit_per_detector",
    statement(
        """select anomaly_id, detector, round(score, 6) as score from anomalies
        qualify row_number() over (partition by detector order by anomalies.score desc, anomaly_id) <= 3""",
        "anomalies",
    ),
)
def limit_per_detector(spark, sf_dir):
    return _rounded(first_per_detector(_suite(spark, sf_dir).anomalies, 3), "anomaly_id", "detector", "score")


def _annotated(spark, sf_dir) -> DataFrame:
    graph = T.stored_graph(spark, sf_dir, with_numbers=True)
    found = run_suite(graph)
    severities = K.node_severity(K.node_signals(found.anomalies, _members(found)))
    # Stored, so that Spark knows how few they are and the vertices need not move.
    return X.annotate_nodes(graph.vertices, stored(severities, "severities"))


@query(
    "annotate_nodes",
    statement(
        f"""select id, {_WORD.replace("else 'baixa'", "when 1 then 'baixa'")} as anomaly_severity, worst is not null as is_anomalous
        from vertices left join severities on node_id = id""",
        "vertices", "severities",
    ),
)
def annotate_nodes(spark, sf_dir):
    return _annotated(spark, sf_dir).select("id", "anomaly_severity", "is_anomalous")


@query(
    "nodes_with_risk",
    statement(
        """select id, label, node_type as type, v.valor, round(score, 6) as risk_score, signals
        from labelled v left join risk on node_id = id""",
        "labelled", "risk",
    ),
)
def nodes_with_risk(spark, sf_dir):
    graph = T.stored_graph(spark, sf_dir, with_numbers=True)
    found = run_suite(graph)
    risk = stored(K.node_risk(found.anomalies, _members(found)), "risk")
    summaries = G.node_summaries(graph.vertices)
    rows = X.nodes_with_risk(summaries, risk)
    return rows.select("id", "label", "type", "valor", F.round("risk_score", 6).alias("risk_score"), "signals")


_FLAGGED = "labelled left join severities on node_id = id"
_PASSES = """node_type in ('empenho', 'fornecedor') and valor >= 1000 and valor <= 104500.5
    and (lower(label) like '%r%' or lower(numero) like '%r%' or lower(original_id) like '%r%')"""


def _explorer_test(**changes):
    options = {"types": [V.EMPENHO, V.FORNECEDOR], "min_value": "1000", "max_value": "104500.5", "needle": "R"}
    return X.passes(**{**options, **changes})


@query(
    "explore_filter",
    statement(f"select id, label from {_FLAGGED} where {_PASSES} and worst is not null", "labelled", "severities"),
)
def explore_filter(spark, sf_dir):
    kept = _annotated(spark, sf_dir).where(_explorer_test(anomalies_only=True))
    return kept.select("id", G.node_label().alias("label"))


@query(
    "filter_summary",
    statement(
        f"""select count(*) as total, count(*) filter ({_PASSES}) as visible,
          count(*) filter ({_PASSES} and worst is not null) as visible_anomalous from {_FLAGGED}""",
        "labelled", "severities",
    ),
)
def filter_summary(spark, sf_dir):
    return X.filter_summary(_annotated(spark, sf_dir), _explorer_test())


@query(
    "search_nodes",
    statement(
        """select id, label from labelled where lower(label) like '%er#00000001%' or lower(numero) like '%er#00000001%'
          or lower(original_id) like '%er#00000001%'""",
        "labelled",
    ),
)
def search_nodes(spark, sf_dir):
    return X.search_nodes(T.graph(spark, sf_dir).vertices, "ER#00000001").select("id", G.node_label().alias("label"))


@query(
    "catalog_filter",
    statement(
        "select id, label, valor from labelled where node_type = 'empenho' and lower(id || ' ' || label) like '%-7-%'",
        "labelled",
    ),
)
def catalog_filter(spark, sf_dir):
    summaries = G.node_summaries(T.graph(spark, sf_dir).vertices)
    return X.catalog_filter(summaries, V.EMPENHO, " -7-").select("id", "label", "valor")


@query(
    "visible_links",
    statement(
        """select * from edges where edge_type = 'orgao_empenho'
          and dst in (select id from vertices where node_type = 'empenho' and valor >= 20000)""",
        "edges", "vertices",
    ),
)
def visible_links(spark, sf_dir):
    """Links between agencies and commitments of at least 20,000, the other nodes being hidden."""
    test = X.passes(types=[V.EMPENHO], min_value="20000") | X.passes(types=[V.ORGAO], min_value="")
    return X.links_of_visible(T.graph(spark, sf_dir), test, {V.EMPENHO, V.ORGAO})


@query(
    "highlight_neighbors",
    statement(
        "select distinct center_id as target_id, neighbor_id as node_id from ego where anomaly_id like 'centralidade_fornecedores%'",
        "ego",
    ),
)
def highlight_neighbors(spark, sf_dir):
    graph = T.graph(spark, sf_dir)
    targets = D.rank_centrality(graph, V.FORNECEDOR).select(F.col("node_id").alias("id"))
    return X.neighbors_of(graph.edges, targets)


@query("value_extent", statement("select min(valor) as min_value, max(valor) as max_value from vertices", "vertices"))
def value_extent(spark, sf_dir):
    return X.value_extent(T.graph(spark, sf_dir).vertices)


@query("node_types", statement("select distinct node_type from vertices", "vertices"))
def node_types(spark, sf_dir):
    return X.node_types(T.graph(spark, sf_dir).vertices)


@query(
    "anomaly_suite",
    statement("select anomaly_id, detector, node_id, round(score, 6) as score, severity, reason from anomalies", "anomalies"),
)
def anomaly_suite(spark, sf_dir):
    """The default suite on the stored graph."""
    return _rounded(_suite(spark, sf_dir).anomalies, "anomaly_id", "detector", "node_id", "score", "severity", "reason")


@query("suite_risk", statement("select node_id, round(score, 6) as score, signals from risk", "risk"))
def suite_risk(spark, sf_dir):
    return _rounded(_suite(spark, sf_dir).risk, "node_id", "score", "signals")


_CONTEXT = """centrality double, entropy double, focus_type string, community_id string, neighbor_count bigint,
    node_count bigint, link_count bigint, subgraph struct<focus: string, nodes: array<struct<id: string>>, links: array<struct<source: string>>>"""


@query(
    "report_documents",
    statement(
        """, linked as (
          select anomaly_id, count(*) as n from (
            select a.anomaly_id from edges join node_evidence a on a.node_id = src
              join node_evidence b on b.node_id = dst and b.anomaly_id = a.anomaly_id
            union all
            select 'comunidades_isoladas::' || a.label from projected join voted_shown a on a.node_id = source_id
              join voted_shown b on b.node_id = target_id and b.label = a.label) group by 1),
        places as (
          select anomaly_id, count(*) as nodes, max(node_id) filter (position = 0) as center from evidence group by 1)
        select a.detector, a.anomaly_id, round(a.score, 6) as score, a.severity,
          row_number() over (partition by a.detector order by a.score desc, a.anomaly_id) as place,
          coalesce(a.node_id, center) as focus,
          case when a.detector like 'centralidade%' then round(n.metric_value, 2) end as centrality,
          case when a.detector like 'alta_entropia%' then round(n.metric_value, 6) end as entropy,
          case when a.detector like 'alta_entropia%' then n.node_type end as focus_type,
          case when a.detector = 'comunidades_isoladas' then substr(a.anomaly_id, 23) end as community_id,
          nodes, coalesce(linked.n, 0) as links, coalesce(linked.n, 0) as link_count
        from anomalies a left join node_anomalies n using (anomaly_id) join places using (anomaly_id)
        left join linked on linked.anomaly_id = a.anomaly_id""",
        "anomalies", "evidence", "edges", "projected", "voted_shown", "node_evidence",
    ).replace("\n, linked", ",\nlinked"),
)
def report_documents(spark, sf_dir):
    """The documents of a report, read back from their JSON, in the order in which they stand."""
    graph = T.stored_graph(spark, sf_dir, with_numbers=True)
    documents = report(run_suite(graph), graph.vertices, max_links=1_000_000)
    standing = Window.partitionBy("detector").orderBy("order")
    parsed = documents.withColumn("order", F.monotonically_increasing_id()).withColumn(
        "d", F.from_json("document", f"score double, severity string, context struct<{_CONTEXT}>")
    )
    return parsed.select(
        "detector",
        "anomaly_id",
        F.round("d.score", 6).alias("score"),
        "d.severity",
        F.row_number().over(standing).cast("long").alias("place"),
        "d.context.subgraph.focus",
        F.round("d.context.centrality", 2).alias("centrality"),
        F.round("d.context.entropy", 6).alias("entropy"),
        "d.context.focus_type",
        "d.context.community_id",
        F.size("d.context.subgraph.nodes").cast("long").alias("nodes"),
        F.coalesce(F.size("d.context.subgraph.links"), F.lit(0)).cast("long").alias("links"),
        F.coalesce("d.context.link_count", F.lit(0)).alias("link_count"),
    )
