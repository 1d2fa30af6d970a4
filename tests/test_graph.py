import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import as_dict
from ledgernet import schema as S
from ledgernet import vocabulary as V
from ledgernet.graph import SpendGraph
from ledgernet.operators import communities as C
from ledgernet.operators import evidence as E
from ledgernet.operators import explore as X
from ledgernet.operators import graph_build as G
from ledgernet.operators import metrics as M
from ledgernet.operators import projection as P
from ledgernet.operators import votes as B

EDGE = "src string, dst string, edge_type string, valor double"


def test_counts_by_type(basic_graph):
    assert as_dict(basic_graph.vertices.groupBy("node_type").count(), "node_type", "count") == {
        "orgao": 2, "fornecedor": 2, "empenho": 3, "contrato": 3,
    }
    assert as_dict(basic_graph.edges.groupBy("edge_type").count(), "edge_type", "count") == dict.fromkeys(V.END_TYPES, 3)
    assert basic_graph.vertices.columns == S.VERTICES.names
    assert (basic_graph.num_vertices(), basic_graph.num_edges()) == (10, 9)
    assert len(list(basic_graph.edges_iter())) == 9


def test_type_filters_prune_the_other_branches(basic_graph):
    plan = basic_graph.edges.where("edge_type = 'empenho_contrato'")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_missing_keys_make_no_edges(spark, basic_tables):
    holes = basic_tables.commitments.withColumn("fornecedor_id", F.lit(None).cast("string"))
    assert G.build_edges(holes, include_contracts=False).count() == 3
    assert G.build_graph(holes).vertices.count() == 3


def test_vertices_carry_dates_as_text(basic_graph):
    row = basic_graph.vertices.where("id = 'empenho::E1'").first()
    assert (row["data"], row["valor"], row["nome"]) == ("2023-01-15T00:00:00", 150000.0, "Compra de mudas")


DEGREES = {
    "fornecedor": {"fornecedor::F1": 400000.0, "fornecedor::F2": 90000.0},
    "orgao": {"orgao::O1": 240000.0, "orgao::O2": 250000.0},
    "empenho": {"empenho::E1": 450000.0, "empenho::E2": 270000.0, "empenho::E3": 750000.0},
}


@pytest.mark.parametrize("node_type", DEGREES)
def test_weighted_degree_with_and_without_known_types(basic_graph, node_type):
    untyped = SpendGraph(basic_graph.vertices, basic_graph.edges)
    for graph in (basic_graph, untyped):
        assert as_dict(M.weighted_degree(graph, node_type), "node_id", "centrality") == DEGREES[node_type]
    assert M.weighted_degree(basic_graph, "outro").count() == 0


def test_weights_default_to_one_and_self_loops_count_twice(spark):
    vertices = spark.createDataFrame([("a", "t"), ("b", "t")], "id string, node_type string")
    edges = spark.createDataFrame([("a", "a", "x", 2.0), ("a", "b", "x", None), ("a", "gone", "x", 1.5)], EDGE)
    degrees = as_dict(M.weighted_degree(SpendGraph(vertices, edges), "t"), "node_id", "centrality")
    assert degrees == {"a": 6.5, "b": 1.0}


def test_entropy_of_values(spark):
    df = spark.createDataFrame([("z", 0.0), ("z", 0.0), ("h", 1.0), ("h", 1.0), ("s", 5.0), ("n", None)], "g string, v double")
    got = as_dict(M.entropy_of(df, "g", "v"), "g", "entropy")
    assert got == {"z": 0.0, "h": 1.0, "s": 0.0, "n": 0.0}
    assert M.entropy_of(df.where("false"), "g", "v").count() == 0


def links(graph):
    return P.as_edges(P.agency_supplier_links(graph), "orgao_fornecedor")


def test_entropy_sees_nothing_one_hop_and_the_agencies_two_hops(basic_graph):
    direct = M.neighbor_entropy(basic_graph.edges, basic_graph.vertices, V.FORNECEDOR, V.ORGAO, per="edge")
    assert as_dict(direct, "node_id", "entropy") == {"fornecedor::F1": 0.0, "fornecedor::F2": 0.0}
    far = M.neighbor_entropy(links(basic_graph), basic_graph.vertices, V.FORNECEDOR, V.ORGAO)
    assert as_dict(far, "node_id", "entropy") == pytest.approx({"fornecedor::F1": 0.954434002924965, "fornecedor::F2": 0.0})
    back = M.neighbor_entropy(links(basic_graph), basic_graph.vertices, V.ORGAO, V.FORNECEDOR)
    assert as_dict(back, "node_id", "entropy") == pytest.approx({"orgao::O1": 0.954434002924965, "orgao::O2": 0.0})


def test_entropy_merges_parallel_edges_per_neighbor_only(spark):
    vertices = spark.createDataFrame([("f", "fornecedor"), ("o", "orgao"), ("p", "orgao")], "id string, node_type string")
    edges = spark.createDataFrame([("o", "f", "x", 1.0), ("o", "f", "x", 1.0), ("p", "f", "x", 2.0), ("p", "f", "x", 0.0)], EDGE)
    entropy = lambda per: M.neighbor_entropy(edges, vertices, V.FORNECEDOR, V.ORGAO, per).first()["entropy"]
    assert entropy("neighbor") == pytest.approx(1.0)
    assert entropy("edge") == pytest.approx(1.5)
    with pytest.raises(ValueError):
        entropy("other")


def test_entropy_of_merged_pairs_groups_them_once(basic_graph):
    merged = links(basic_graph)
    entropy = lambda per: M.neighbor_entropy(merged, basic_graph.vertices, V.FORNECEDOR, V.ORGAO, per)
    assert as_dict(entropy("pair"), "node_id", "entropy") == as_dict(entropy("neighbor"), "node_id", "entropy")
    groups = lambda per: entropy(per)._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [")
    assert groups("pair") < groups("neighbor")


def test_projection_over_edges_equals_projection_of_commitments(basic_graph, basic_tables):
    direct = G.build_graph(*basic_tables, unique_commitments=True)
    want = {("orgao::O1", "fornecedor::F1", 150000.0, 1), ("orgao::O1", "fornecedor::F2", 90000.0, 1), ("orgao::O2", "fornecedor::F1", 250000.0, 1)}
    assert {tuple(r) for r in P.agency_supplier_links(basic_graph).collect()} == want
    assert {tuple(r) for r in P.agency_supplier_links(direct).collect()} == want
    assert P.project_bipartite(basic_graph, V.ORGAO, V.FORNECEDOR).count() == 0


def test_projection_counts_parallel_paths(spark):
    vertices = spark.createDataFrame([("o", "orgao"), ("e", "empenho"), ("f", "fornecedor")], "id string, node_type string")
    edges = spark.createDataFrame([("o", "e", "x", 1.0), ("o", "e", "x", 1.0), ("e", "f", "y", 3.0), ("e", "f", "y", 4.0), ("e", "gone", "y", 1.0)], EDGE)
    row = P.project_via(SpendGraph(vertices, edges), V.ORGAO, V.EMPENHO, V.FORNECEDOR).collect()
    assert [tuple(r) for r in row] == [("o", "f", 14.0, 4)]


def test_projection_deals_out_the_halves_of_a_built_graph_once(spark, basic_tables, monkeypatch):
    c, suppliers, agencies = basic_tables
    # A repeated commitment gives parallel edges; O2 and F2 have no vertex.
    repeated = c.unionByName(c.where("empenho_id = 'E1'").withColumn("orgao_id", F.lit("O3")).withColumn("valor_empenhado", F.lit(1.0)))
    ends = suppliers.where("fornecedor_id <> 'F2'"), agencies.where("orgao_id <> 'O2'").unionByName(agencies.where("orgao_id = 'O2'").withColumn("orgao_id", F.lit("O3")))
    built = G.build_graph(repeated, *ends, include_contracts=True)
    written, store = [], P.stored
    monkeypatch.setattr(P, "stored", lambda df, name: written.append(df._jdf.queryExecution().executedPlan().toString()) or store(df, name))
    got = sorted(tuple(r) for r in P.project_via(built, V.ORGAO, V.EMPENHO, V.FORNECEDOR).collect())
    assert got == [("orgao::O1", "fornecedor::F1", 150001.0, 2), ("orgao::O3", "fornecedor::F1", 150001.0, 2)]
    plain = P.project_via(SpendGraph(built.vertices, built.edges, built.end_types), V.ORGAO, V.EMPENHO, V.FORNECEDOR)
    assert sorted(tuple(r) for r in plain.collect()) == got
    assert len(written) == 1 and written[0].count("Exchange hashpartitioning(via_id") == 2
    assert "Exchange hashpartitioning(source_id" in written[0] and written[0].count("Exchange hashpartitioning(source_id") == 1


@pytest.mark.parametrize("rows_per_split", [1, 1_000_000])
def test_label_propagation(basic_graph, rows_per_split):
    nodes = basic_graph.vertices.where(F.col("node_type").isin("orgao", "fornecedor")).select("id")
    edges = links(basic_graph)
    alone = nodes.sparkSession.createDataFrame([("orgao::sem",)], "id string")
    one = C.label_propagation(edges, nodes.unionByName(alone), rows_per_split=rows_per_split)
    got = as_dict(one, "node_id", "label")
    assert got.pop("orgao::sem") == "orgao::sem"
    assert set(got.values()) == {"fornecedor::F1"} and len(got) == 4
    two = as_dict(C.label_propagation(edges, nodes, self_vote=False, rows_per_split=rows_per_split), "node_id", "label")
    assert two["fornecedor::F1"] == two["fornecedor::F2"] != two["orgao::O1"] == two["orgao::O2"]


def test_label_propagation_can_weigh_votes(spark):
    # b and c each pull at a; c pays more.
    edges = spark.createDataFrame([("a", "b", "x", 1.0), ("a", "c", "x", 5.0)], EDGE)
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert as_dict(C.label_propagation(edges, nodes, max_iter=1, weighted=True), "node_id", "label")["a"] == "c"
    assert as_dict(C.label_propagation(edges, nodes, max_iter=1), "node_id", "label")["a"] == "a"


def test_isolation_counts_edges_on_both_sides(spark):
    vertices = spark.createDataFrame([(i, "t") for i in "abcd"], "id string, node_type string")
    labels = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "3")], "node_id string, label string")
    edges = spark.createDataFrame([("a", "b", "x", 1.0), ("b", "a", "x", 1.0), ("b", "c", "x", 1.0)], EDGE)
    rows = {r["community"]: r for r in C.isolation(edges, vertices, labels).collect()}
    assert (rows["1"]["internal_edges"], rows["1"]["external_edges"], rows["1"]["edge_density"]) == (2, 1, 2.0)
    assert rows["1"]["isolation_score"] == pytest.approx(2 / 3)
    assert (rows["2"]["isolation_score"], rows["2"]["edge_density"]) == (0.0, 0.0)
    assert rows["3"]["isolation_score"] == 1.0


def test_ego_networks_keep_parallel_edges_and_rank_nulls_last(spark):
    edges = spark.createDataFrame(
        [("c", "x", "t", 5.0), ("y", "c", "t", 9.0), ("c", "x", "t", None), ("c", "c", "t", 1.0), ("x", "y", "t", 3.0)], EDGE
    )
    centers = spark.createDataFrame([("A", "c"), ("B", "y")], "anomaly_id string, center_id string")
    for few in (True, False):
        ego = E.ego_networks(centers, edges, neighbor_limit=3, few=few)
        assert as_dict(ego.counts, "anomaly_id", "neighbor_count") == {"A": 4, "B": 2}
        top = ego.neighbors.where("anomaly_id = 'A'").orderBy("rank").collect()
        assert [(r["neighbor_id"], r["valor"]) for r in top] == [("y", 9.0), ("x", 5.0), ("c", 1.0)]


def test_edges_of_few_centers_are_read_from_the_sides_that_can_hold_them(basic_graph):
    types = {V.FORNECEDOR, V.ORGAO}
    centers = basic_graph.vertices.where(F.col("node_type").isin(*types)).select(F.col("id").alias("anomaly_id"), F.col("id").alias("center_id"))
    starting, ending = basic_graph.edges_by_side(types)
    assert {r[0] for r in starting.select("edge_type").distinct().collect()} == {V.ORGAO_EMPENHO}
    assert {r[0] for r in ending.select("edge_type").distinct().collect()} == {V.EMPENHO_FORNECEDOR}
    known = E.ego_networks(centers, basic_graph.edges, few=True, sides=(starting, ending))
    plain = E.ego_networks(centers, basic_graph.edges)
    for a, b in zip(known, plain):
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_edges_of_many_centers_are_listed_from_the_sides_that_can_hold_them(basic_graph):
    centers = basic_graph.vertices.where(F.col("node_type") == V.FORNECEDOR).select(F.col("id").alias("anomaly_id"), F.col("id").alias("center_id"))
    known = E.ego_networks(centers, basic_graph.edges, sides=basic_graph.edges_by_side({V.FORNECEDOR}))
    plain = E.ego_networks(centers, basic_graph.edges)
    for a, b in zip(known, plain):
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
        plan = a._jdf.queryExecution().optimizedPlan().toString()
        assert V.ORGAO_EMPENHO not in plan and V.EMPENHO_CONTRATO not in plan


def test_evidence_is_capped_in_order_and_distinct(spark):
    centers = spark.createDataFrame([("A", "c")], "anomaly_id string, center_id string")
    neighbors = spark.createDataFrame([("A", "x", 1), ("A", "y", 2), ("A", "x", 3)], "anomaly_id string, neighbor_id string, rank long")
    extra = spark.createDataFrame([("A", f"m{i:02d}", i) for i in range(1, 41)] + [("A", "c", 41)], "anomaly_id string, node_id string, member_rank long")
    rows = E.evidence_nodes(centers, neighbors, extra).orderBy("position").collect()
    assert [r["node_id"] for r in rows][:4] == ["c", "x", "y", "m01"]
    assert len(rows) == 30 and rows[-1]["position"] == 29


def test_both_link_plans_agree(spark):
    nodes = spark.createDataFrame([("A", "a"), ("A", "b"), ("A", "h"), ("A", "g"), ("B", "c"), ("B", "h")], "anomaly_id string, node_id string")
    home = spark.createDataFrame([("A", "a"), ("A", "b"), ("B", "c")], "anomaly_id string, node_id string")
    edges = spark.createDataFrame(
        [("a", "b", "t", 1.0), ("h", "a", "t", 2.0), ("b", "h", "t", 3.0), ("h", "g", "t", 4.0), ("h", "h", "t", 5.0), ("c", "a", "t", 6.0), ("h", "c", "t", 7.0), ("a", "a", "t", 8.0)],
        EDGE,
    )
    few = {tuple(r) for r in E.links_of_few(nodes, edges).collect()}
    many = [tuple(r) for r in E.links_of_many(nodes, home, edges).collect()]
    assert len(many) == len(set(many)) and set(many) == few


def test_explorer(spark, basic_graph):
    v = basic_graph.vertices.withColumn("is_anomalous", F.col("id") == "empenho::E1")
    shown = lambda **o: {r["id"] for r in v.where(X.passes(**o)).select("id").collect()}
    assert shown(types=["empenho"], min_value="90000", max_value="150000") == {"empenho::E1", "empenho::E2"}
    assert shown(types=["empenho"], min_value="abc") == {"empenho::E1", "empenho::E2", "empenho::E3"}
    assert shown(anomalies_only=True) == {"empenho::E1"}
    assert shown(needle="44.555") == {"fornecedor::F2"}
    assert shown(needle="DE PONTES") == {"empenho::E2"}
    summary = X.filter_summary(v, X.passes(types=["empenho"])).first()
    assert tuple(summary) == (10, 3, 1)
    summaries = G.node_summaries(basic_graph.vertices)
    assert X.catalog_filter(summaries, "contrato", "c2").count() == 1
    assert X.catalog_filter(summaries).count() == 10
    assert tuple(X.value_extent(v).first()) == (90000.0, 250000.0)
    assert [r[0] for r in X.node_types(v).collect()] == ["contrato", "empenho", "fornecedor", "orgao"]
    seen = X.visible_links(basic_graph.edges, v.where("node_type in ('empenho', 'contrato')").select("id"))
    assert seen.count() == 3


@pytest.mark.parametrize("few", [0, 100])
def test_visible_ends_are_tested_where_the_commitments_lie(spark, basic_tables, monkeypatch, few):
    c, suppliers, agencies = basic_tables
    # E2 is below the bound, but a commitment of the same id is not; E3 and its copy are below; O2 and a null id have no vertex.
    odd = (
        c.unionByName(c.where("empenho_id = 'E2'").withColumn("valor_empenhado", F.lit(200000.0)))
        .unionByName(c.where("empenho_id = 'E1'").withColumn("empenho_id", F.lit(None).cast("string")))
        .withColumn("valor_empenhado", F.expr("if(empenho_id = 'E3', 10.0, valor_empenhado)"))
    )
    odd = odd.unionByName(odd.where("empenho_id = 'E1'").withColumn("orgao_id", F.lit("O2")))
    graph = G.build_graph(odd, suppliers, agencies.where("orgao_id <> 'O2'"), include_contracts=True, unique_commitments=True)
    monkeypatch.setattr(X, "FEW_MIXED", few)
    for types, wanted in (({V.EMPENHO, V.ORGAO}, 3), ({V.EMPENHO, V.FORNECEDOR, V.CONTRATO, V.ORGAO}, 11), ({V.ORGAO}, 0)):
        test = X.passes(types=[V.EMPENHO], min_value="100000") | (F.col("node_type") != V.EMPENHO)
        shown = graph.vertices.where(F.col("node_type").isin(*types) & test).select("id")
        got = X.links_of_visible(graph, test, types)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, X.visible_links(graph.edges, shown).collect()))
        assert got.count() == wanted


def test_visible_links_look_up_no_commitment(basic_tables):
    graph = G.build_graph(*basic_tables, include_contracts=True, unique_commitments=True)
    test = X.passes(types=[V.EMPENHO], min_value="100000") | X.passes(types=[V.ORGAO])
    plan = X.links_of_visible(graph, test, {V.EMPENHO, V.ORGAO})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") == 1 and "empenho_contrato" not in plan


def test_neighbours(spark):
    edges = spark.createDataFrame([("a", "b", "t", 1.0), ("b", "a", "t", 1.0), ("a", "a", "t", 1.0)], EDGE)
    assert {tuple(r) for r in X.adjacency(edges).collect()} == {("a", "b"), ("b", "a"), ("a", "a")}
    targets = spark.createDataFrame([("a",)], "id string")
    assert [tuple(r) for r in X.neighbors_of(edges, targets).collect()] == [("a", "b")]


def test_dangling_and_induced(spark, basic_graph):
    vertices = basic_graph.vertices.where("id <> 'fornecedor::F1'")
    rows = G.dangling_edges(SpendGraph(vertices, basic_graph.edges)).collect()
    assert [(r["node_id"], r["side"], r["edge_count"]) for r in rows] == [("fornecedor::F1", "dst", 2)]
    few = basic_graph.vertices.where("node_type <> 'contrato'")
    sub = E.induced_subgraph(basic_graph, few)
    assert (sub.num_vertices(), sub.num_edges()) == (7, 6)


def test_adjacency_moves_each_pair_once(spark):
    from ledgernet.operators.explore import adjacency

    pairs = [("a", "b"), ("b", "a"), ("c", "c"), ("a", None), (None, "a"), (None, None), ("a", "b")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    both = {p for a, b in pairs for p in ((a, b), (b, a))}
    found = [tuple(r) for r in adjacency(edges).collect()]
    assert len(found) == len(both) and set(found) == both
    plan = adjacency(edges)._jdf.queryExecution().optimizedPlan().toString()
    # Rows are listed from both ends above the aggregate, not below it.
    assert plan.index("Generate") < plan.index("Aggregate")


def test_rounds_of_labels_add_up_numbers_without_sorting(spark):
    from ledgernet.operators.communities import _numbered, _round

    ids = spark.createDataFrame([("n10", 1), ("n2", 1), ("n1", 1), ("é", 1)], "node_id string, pieces int")
    numbers = _numbered(ids, "node_id")
    assert {tuple(r) for r in numbers.select("node_id", "number").collect()} == {("n1", 0), ("n10", 1), ("n2", 2), ("é", 3)}
    labels = numbers.select(F.col("number").alias("node_id"), F.col("number").alias("label"), "pieces")
    ends = [(0, 0, 3), (1, 0, 3), (2, 0, 3), (3, 0, 1), (3, 0, 2)]
    placed = spark.createDataFrame(ends, "neighbor_id long, split int, node_id long")
    packed, plain = (_round(placed, labels, True, bits) for bits in (3, 0))
    expected = {(0, 0), (1, 1), (2, 2), (3, 0)}
    assert {(r["node_id"], r["label"]) for r in packed.collect()} == expected
    assert {(r["node_id"], r["label"]) for r in plain.collect()} == expected
    assert "SortAggregate" not in packed._jdf.queryExecution().executedPlan().toString()


def test_votes_counted_in_blocks_are_those_counted_row_by_row(spark, monkeypatch):
    from ledgernet.operators import votes as B

    ends = [(f"o{i}", f"f{(i * k) % 7}") for i in range(40) for k in (1, 2, 3)] + [("o1", "f0"), ("o2", "o2"), ("o3", None)]
    edges = spark.createDataFrame([(a, b, "x", 1.0) for a, b in ends], EDGE)
    nodes = spark.createDataFrame([(n,) for n in sorted({e for pair in ends for e in pair if e} | {"alone"})], "id string")
    plans, plain = [], B.best_labels
    monkeypatch.setattr(B, "best_labels", lambda *a: plans.append(a[3]) or plain(*a))

    def labels(blocks, **options):
        ballot = B.Ballot
        monkeypatch.setattr(B, "Ballot", lambda count, total: ballot(count, total, blocks) if blocks else ballot(1 << 40, total))
        got = as_dict(C.label_propagation(edges, nodes, **options), "node_id", "label")
        monkeypatch.setattr(B, "Ballot", ballot)
        return got

    for options in ({"max_iter": 3, "rows_per_split": 9}, {"max_iter": 2, "self_vote": False}):
        rows = labels(None, **options)
        assert not plans
        assert len(set(rows.values())) > 1 and labels(30, **options) == rows
        assert any(plans) == ("rows_per_split" in options)
        plans.clear()

def test_degrees_are_summed_by_the_keys_of_commitments(basic_tables):
    built = G.build_graph(*basic_tables, unique_commitments=True)
    bare = SpendGraph(built.vertices, built.edges, end_types=built.end_types)
    for kind in (V.ORGAO, V.FORNECEDOR, V.EMPENHO):
        got, plain = M.weighted_degree(built, kind), M.weighted_degree(bare, kind)
        assert as_dict(got, "node_id", "centrality") == as_dict(plain, "node_id", "centrality") != {}
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert bool(re.search(r"Aggregate \[(orgao|fornecedor)_id#", plan)) == (kind != V.EMPENHO)


@pytest.mark.parametrize("unknown,few", [("", 9), ("O1", 9), ("O1", 0)])
def test_projection_leaves_out_ends_without_vertex_when_keys_are_checked_first(spark, basic_tables, monkeypatch, unknown, few):
    monkeypatch.setattr(P, "FEW_STRANGERS", few)
    tables = basic_tables._replace(agencies=basic_tables.agencies.where(F.col("orgao_id") != unknown))
    built = G.build_graph(*tables, unique_commitments=True)
    checked = P.agency_supplier_links(built, reread=True)
    assert sorted(map(tuple, checked.collect())) == sorted(map(tuple, P.agency_supplier_links(built).collect())) != []
    assert ("Join" in checked._jdf.queryExecution().optimizedPlan().toString()) == bool(unknown)


def test_blocks_hold_every_edge_once(spark):
    """A block reaches Python as one array of numbers and holds the edges of its nodes, parallel ones too."""
    ballot = B.Ballot(50, 400, edges_per_block=100)
    edges = [(i % 50, (i * i) % 50) for i in range(400)]
    listed = spark.createDataFrame(edges, "neighbor_id long, node_id long").withColumn("split", F.lit(0))
    blocks = B.blocks_of(listed.withColumn("block", ballot.block_of("neighbor_id", "split")), ballot, 3)
    assert "collect_list" in blocks._jdf.queryExecution().toString()
    got, seen = [], []
    for row in blocks.collect():
        sources, degrees, targets = (np.frombuffer(row[c], np.int64) for c in ("sources", "degrees", "targets"))
        got += zip(np.repeat(sources, degrees).tolist(), ballot.node(targets).tolist())
        seen.append(row["block"])
    assert sorted(got) == sorted(edges)
    assert len(seen) == len(set(seen)) and len(seen) > 1
