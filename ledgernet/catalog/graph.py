"""Queries on building, projecting and measuring the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgernet import vocabulary as V
from ledgernet.catalog.registered import query
from ledgernet.catalog.sql import ROUNDS, labels_after, statement
from ledgernet.functions.severity import robust_z
from ledgernet.operators import communities as C
from ledgernet.operators import evidence as E
from ledgernet.operators import explore as X
from ledgernet.operators import graph_build as G
from ledgernet.operators import metrics as M
from ledgernet.operators import projection as P
from ledgernet.operators.robust import median_and_mad
from ledgernet.operators.robust import robust_stats as stats_of
from ledgernet.sources import export
from ledgernet.sources import tables as T
from ledgernet.sources.workspace import cut_lineage, scratch_path, stored


@query(
    "vertices_by_type",
    statement(
        """select id, node_type, original_id, nome, sigla, uf, documento, numero, descricao, valor, data
        from vertices""",
        "vertices",
    ),
)
def vertices_by_type(spark, sf_dir):
    return T.graph(spark, sf_dir).vertices.select(
        "id", "node_type", "original_id", "nome", "sigla", "uf", "documento", "numero", "descricao", "valor", "data"
    )


@query("edges_by_type", statement("select * from edges", "edges"))
def edges_by_type(spark, sf_dir):
    return T.graph(spark, sf_dir).edges


@query(
    "contract_vertices",
    statement("select id, node_type, original_id from vertices where node_type = 'contrato'", "vertices"),
)
def contract_vertices(spark, sf_dir):
    return G.contract_vertices(T.commitments(spark, sf_dir)).select("id", "node_type", "original_id")


@query(
    "graph_summary",
    statement(
        """select 'nodes' as table_name, count(*) as row_count from vertices
        union all select 'edges', count(*) from edges union all select 'empenhos', count(*) from commitments
        union all select 'fornecedores', count(*) from suppliers union all select 'orgaos', count(*) from agencies""",
        "vertices", "edges", "commitments", "suppliers", "agencies",
    ),
)
def graph_summary(spark, sf_dir):
    return G.graph_summary(T.graph(spark, sf_dir), *T.collections(spark, sf_dir))


@query(
    "node_summaries",
    statement("select id, label, node_type as type, original_id, valor from labelled", "labelled"),
)
def node_summaries(spark, sf_dir):
    return G.node_summaries(T.graph(spark, sf_dir).vertices)


@query(
    "dangling_edges",
    statement(
        """select 'orgao_empenho' as edge_type, 'src' as side, src as node_id, count(*) as edge_count
        from edges where edge_type = 'orgao_empenho' group by src""",
        "edges",
    ),
)
def dangling_edges(spark, sf_dir):
    """A graph without the agency table: every agency end dangles."""
    commitments, suppliers, _ = T.collections(spark, sf_dir)
    return G.dangling_edges(G.build_graph(commitments, suppliers, include_contracts=True))


@query("snapshot_nodes", statement("select id, node_type as type, original_id, nome, numero, valor, data from vertices", "vertices"))
def snapshot_nodes(spark, sf_dir):
    """The node file of the node-link form, written and read back."""
    path = scratch_path(spark, "node-link")
    export.write_node_link(T.graph(spark, sf_dir, one_pass=True), path)
    schema = "id string, type string, original_id string, nome string, numero string, valor double, data string"
    return spark.read.schema(schema).json(f"{path}/nodes")


@query("snapshot_links", statement("select src as source, dst as target, edge_type as type, valor from edges", "edges"))
def snapshot_links(spark, sf_dir):
    """The link file of the node-link form, written and read back."""
    path = scratch_path(spark, "links")
    export.write_node_link(T.graph(spark, sf_dir, one_pass=True), path)
    return spark.read.schema("source string, target string, type string, valor double").json(f"{path}/links")


@query(
    "snapshot_xml",
    statement(
        """select 'node' as element, id, node_type as type, nome, uf, numero, valor, data,
          2 + (nome is not null)::bigint + (sigla is not null)::bigint + (uf is not null)::bigint + (numero is not null)::bigint
          + (descricao is not null)::bigint + (valor is not null)::bigint + (data is not null)::bigint as attributes from vertices
        union all select 'edge', src || ' ' || dst, edge_type, null, null, null, valor, null, 2 from edges""",
        "vertices", "edges",
    ),
)
def snapshot_xml(spark, sf_dir):
    """The graph as GraphML, written and read back: the values of each element, and how many it has."""
    path = scratch_path(spark, "graph-xml")
    export.write_graph_xml(T.graph(spark, sf_dir, one_pass=True), path)

    texts = ["type", "nome", "uf", "numero", "valor", "data"]

    def elements(tag, names, id_):
        return export.read_graph_xml(spark, f"{path}/{tag}s", tag, names, texts).select(
            F.lit(tag).alias("element"),
            id_.alias("id"),
            *[F.col(c).cast("double") if c == "valor" else F.col(c) for c in texts],
            F.col("children").alias("attributes"),
        )

    return elements("node", ["id"], F.col("id")).unionByName(
        elements("edge", ["source", "target"], F.concat_ws(" ", "source", "target"))
    )


@query(
    "weighted_degree_suppliers",
    statement("select node_id, round(value, 2) as centrality from degree_suppliers", "degree_suppliers"),
)
def weighted_degree_suppliers(spark, sf_dir):
    return _rounded_degree(T.graph(spark, sf_dir), V.FORNECEDOR)


@query(
    "weighted_degree_agencies",
    statement("select node_id, round(value, 2) as centrality from degree_agencies", "degree_agencies"),
)
def weighted_degree_agencies(spark, sf_dir):
    return _rounded_degree(T.graph(spark, sf_dir), V.ORGAO)


def _rounded_degree(graph, node_type):
    return M.weighted_degree(graph, node_type).select("node_id", F.round("centrality", 2).alias("centrality"))


@query(
    "typed_pair_edges",
    statement(
        """select 'fornecedor::' || fornecedor_id as focus_id, 'empenho::' || empenho_id as neighbor_id,
          valor_empenhado as weight from commitments""",
        "commitments",
    ),
)
def typed_pair_edges(spark, sf_dir):
    return P.typed_pairs(T.graph(spark, sf_dir), V.FORNECEDOR, V.EMPENHO)


@query(
    "project_bipartite",
    statement(
        """select 'orgao::' || orgao_id as source_id, 'empenho::' || empenho_id as target_id,
          valor_empenhado as weight from commitments""",
        "commitments",
    ),
)
def project_bipartite(spark, sf_dir):
    return P.project_bipartite(T.graph(spark, sf_dir), V.ORGAO, V.EMPENHO)




def _rounded_pairs(pairs):
    return pairs.withColumn("weight", F.round("weight", 2))


@query(
    "project_via",
    statement(
        """select a.src as source_id, b.dst as target_id,
          round(cast(sum(cast(b.valor as decimal(20, 4))) as double), 2) as weight, count(*) as edge_count
        from edges a join edges b on a.dst = b.src
        where a.edge_type = 'orgao_empenho' and b.edge_type = 'empenho_fornecedor' group by 1, 2""",
        "edges",
    ),
)
def project_via(spark, sf_dir):
    """The two-hop projection from the edge table alone."""
    return _rounded_pairs(P.project_via(T.graph(spark, sf_dir), V.ORGAO, V.EMPENHO, V.FORNECEDOR))


@query(
    "agency_supplier_links",
    statement("select source_id, target_id, round(weight, 2) as weight, edge_count from projected", "projected"),
)
def agency_supplier_links(spark, sf_dir):
    """The same projection from the commitments."""
    return _rounded_pairs(P.agency_supplier_links(T.graph(spark, sf_dir)))


@query(
    "induced_edges",
    statement(
        """select e.* from edges e where edge_type = 'empenho_fornecedor'
          and src in (select id from vertices where node_type = 'empenho' and valor >= 50000)""",
        "edges", "vertices",
    ),
)
def induced_edges(spark, sf_dir):
    """Edges among the suppliers and the commitments of at least 50,000."""
    graph = T.graph(spark, sf_dir)
    large = (F.col("node_type") == V.EMPENHO) & (F.col("valor") >= 50000)
    return P.induced_edges(graph.edges, graph.vertices.where(large | (F.col("node_type") == V.FORNECEDOR)).select("id"))


@query(
    "entropy_per_edge",
    statement(
        """select node_id, round(greatest(0.0, -sum(p * log2(p))) + 0.0, 6) as entropy
        from (select 'fornecedor::' || fornecedor_id as node_id,
                valor_empenhado / sum(valor_empenhado) over (partition by fornecedor_id) as p from commitments)
        group by 1""",
        "commitments",
    ),
)
def entropy_per_edge(spark, sf_dir):
    graph = T.graph(spark, sf_dir)
    between = graph.edges_between({V.FORNECEDOR, V.EMPENHO})
    return _rounded_entropy(M.neighbor_entropy(between, graph.vertices, V.FORNECEDOR, V.EMPENHO, per="edge"))


@query(
    "entropy_per_neighbor",
    statement("select node_id, round(value, 6) as entropy from entropy_projected", "entropy_projected"),
)
def entropy_per_neighbor(spark, sf_dir):
    graph = T.graph(spark, sf_dir)
    links = P.as_edges(P.agency_supplier_links(graph), "orgao_fornecedor")
    return _rounded_entropy(M.neighbor_entropy(links, graph.vertices, V.FORNECEDOR, V.ORGAO))


def _rounded_entropy(scores):
    return scores.select("node_id", F.round("entropy", 6).alias("entropy"))


@query(
    "entropy_values",
    """select l_shipmode as month, round(greatest(0.0, -sum(p * log2(p))) + 0.0, 6) as entropy
    from (select strftime(l_shipdate, '%Y-%m') as l_shipmode,
            l_extendedprice / sum(l_extendedprice) over (partition by strftime(l_shipdate, '%Y-%m')) as p from lineitem)
    group by 1""",
)
def entropy_values(spark, sf_dir):
    lines = T.table(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_extendedprice")
    return M.entropy_of(lines, "month", "l_extendedprice").select("month", F.round("entropy", 6).alias("entropy"))


def _degrees(spark, sf_dir):
    """Weighted degree of suppliers and agencies, stored for repeated passes."""
    graph = T.graph(spark, sf_dir)
    parts = [
        M.weighted_degree(graph, t).select(F.lit(t).alias("node_type"), "node_id", F.col("centrality").alias("value"))
        for t in (V.FORNECEDOR, V.ORGAO)
    ]
    return cut_lineage(parts[0].unionByName(parts[1]))


def _stats_sql(name: str) -> str:
    return f"""select node_type, count(*) as n, round(median(value), 4) as median, round(any_value(mad), 4) as mad,
        round(avg(value), 4) as mean, round(stddev_pop(value), 2) as stdev,
        round(any_value(p80), 4) as p80
      from degree_{name}, mad_{name}, (
        select (x[j] * (5 - d) + x[j + 1] * d) / 5 as p80 from (
          select list(value order by value) as x, greatest(1, least(4 * (count(*) + 1) // 5, count(*) - 1)) as j,
            4 * (count(*) + 1) - 5 * greatest(1, least(4 * (count(*) + 1) // 5, count(*) - 1)) as d from degree_{name}))
      group by node_type"""


@query(
    "robust_stats",
    statement(
        _stats_sql("suppliers") + " union all " + _stats_sql("agencies"),
        "degree_suppliers", "degree_agencies", "mad_suppliers", "mad_agencies",
    ),
)
def robust_stats(spark, sf_dir):
    stats = stats_of(_degrees(spark, sf_dir), "node_type", "value")
    digits = {"median": 4, "mad": 4, "mean": 4, "stdev": 2, "p80": 4}
    return stats.select("node_type", "n", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query(
    "robust_zscore",
    statement(
        """select node_id, round(0.6745 * (value - m) / mad, 6) as zscore from degree_suppliers, median_suppliers, mad_suppliers
        union all
        select node_id, round(0.6745 * (value - m) / mad, 6) from degree_agencies, median_agencies, mad_agencies""",
        "median_suppliers", "mad_suppliers", "median_agencies", "mad_agencies",
    ),
)
def robust_zscore(spark, sf_dir):
    degrees = _degrees(spark, sf_dir)
    stats = median_and_mad(degrees, "node_type", "value")
    z = robust_z(F.col("value"), F.col("median"), F.col("mad"))
    # One row per node type.
    return degrees.join(F.broadcast(stats), "node_type").select("node_id", F.round(z, 6).alias("zscore"))


def _labels_sql(rounds: str) -> str:
    return statement(f"select node_id, label from ({labels_after(rounds)})", "vertices", rounds)


@query("label_propagation", _labels_sql("voted_3"))
def label_propagation(spark, sf_dir):
    """Three rounds over the agency-supplier projection."""
    return _propagated(spark, sf_dir, 3)


@query("label_propagation_full", _labels_sql(f"voted_{ROUNDS}"))
def label_propagation_full(spark, sf_dir):
    return _propagated(spark, sf_dir, ROUNDS)


@query("label_propagation_plain", _labels_sql(f"plain_{ROUNDS}"))
def label_propagation_plain(spark, sf_dir):
    """The rule without a node's own vote, which may alternate between two labellings."""
    return _propagated(spark, sf_dir, ROUNDS, self_vote=False)


def _propagated(spark, sf_dir, rounds, **options):
    graph = T.graph(spark, sf_dir)
    links = stored(P.as_edges(P.agency_supplier_links(graph), "orgao_fornecedor"), "projected")
    ends = graph.vertices.where(F.col("node_type").isin(V.ORGAO, V.FORNECEDOR)).select("id")
    return C.label_propagation(links, ends, max_iter=rounds, **options)


def nation_labels(graph):
    """Every agency and supplier with its nation as community label."""
    ends = graph.vertices.where(F.col("node_type").isin(V.ORGAO, V.FORNECEDOR))
    return ends.select(F.col("id").alias("node_id"), F.col("uf").alias("label"))


@query("community_profile", statement("select community, size, node_types from nation_communities", "nation_communities"))
def community_profile(spark, sf_dir):
    graph = T.graph(spark, sf_dir)
    profile = C.community_profile(nation_labels(graph), graph.vertices)
    return profile.withColumn("node_types", F.array_join("node_types", ","))


@query(
    "top_neighbors",
    statement(
        """select 'fornecedor::' || fornecedor_id as center_id, 'empenho::' || empenho_id as neighbor_id, valor_empenhado as valor,
          row_number() over (partition by fornecedor_id order by valor_empenhado desc, 'empenho::' || empenho_id) as rank
        from commitments qualify rank <= 6""",
        "commitments",
    ),
)
def top_neighbors(spark, sf_dir):
    """The six largest edges of every supplier."""
    graph = T.graph(spark, sf_dir)
    suppliers = graph.vertices.where(F.col("node_type") == V.FORNECEDOR)
    centers = suppliers.select(F.col("id").alias("anomaly_id"), F.col("id").alias("center_id"))
    ego = E.ego_networks(centers, graph.edges, sides=graph.edges_by_side({V.FORNECEDOR}))
    return ego.neighbors.select("center_id", "neighbor_id", "valor", "rank")


@query(
    "adjacency",
    statement("select src as node_id, dst as neighbor_id from edges union select dst, src from edges", "edges"),
)
def adjacency(spark, sf_dir):
    return X.adjacency(T.graph(spark, sf_dir, one_pass=True).edges)
