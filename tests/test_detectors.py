import json

import pytest
from pyspark.sql import functions as F

from conftest import as_dict
from ledgernet import vocabulary as V
from ledgernet.graph import SpendGraph
from ledgernet.operators import risk as K
from ledgernet.operators.graph_build import build_graph
from ledgernet.operators.normalize import normalize
from ledgernet.plans import detectors as D
from ledgernet.plans import suite as plans
from ledgernet.plans.load import load_graph
from ledgernet.plans.report import limit_per_detector, report
from ledgernet.plans.suite import run_suite
from ledgernet.sources import synthetic
from ledgernet.sources import tables as T
from ledgernet.sources.payload import collections_of
from ledgernet.sources.sample import SAMPLE

EDGE = "src string, dst string, edge_type string, valor double"


@pytest.fixture(scope="module")
def suite(basic_graph):
    return run_suite(basic_graph)


def test_communities_found_alike_with_few_and_many_centers(spark, basic_graph, monkeypatch):
    edges = spark.createDataFrame(
        [("a", "x", "t", 5.0), ("a", "x", "t", 4.0), ("b", "x", "t", 1.0), ("b", "y", "t", 2.0), ("c", "z", "t", 3.0), ("c", "c", "t", 7.0)], EDGE
    )
    vertices = spark.createDataFrame([(i, "orgao", i) for i in "abcxyz"], "id string, node_type string, nome string").select(
        *[F.col(c) if c in ("id", "node_type", "nome") else F.lit(None).cast(t).alias(c) for c, t in basic_graph.vertices.dtypes]
    )
    labels = spark.createDataFrame([("a", "1"), ("b", "1"), ("x", "1"), ("y", "1"), ("c", "2"), ("z", "2")], "node_id string, label string")
    seen, plain = [], D.E.ego_networks
    monkeypatch.setattr(D.E, "ego_networks", lambda *a, **o: seen.append(o["few"]) or plain(*a, **o))
    found = []
    for most in (2, 1):
        monkeypatch.setattr(D, "FEW", most)
        found.append([sorted(map(repr, t.collect())) for t in D.isolated_communities(edges, vertices, labels)])
    assert seen == [True, False] and found[0] == found[1]


def scores(risk):
    return {r["node_id"]: (round(r["score"], 6), r["signals"]) for r in risk.collect() if not r["node_id"].startswith("contrato")}


def test_risk_of_the_default_suite(suite):
    assert scores(suite.risk) == {
        "orgao::O2": (0.581175, 2), "orgao::O1": (0.48, 2), "fornecedor::F1": (0.448155, 3),
        "fornecedor::F2": (0.32, 3), "empenho::E3": (0.195605, 3), "empenho::E1": (0.128155, 3), "empenho::E2": (0.0, 3),
    }


def test_risk_of_the_direct_suite(basic_graph):
    one_hop = run_suite(basic_graph, one_hop=True)
    assert scores(one_hop.risk) == {
        "orgao::O2": (0.20235, 1), "empenho::E3": (0.1349, 3), "fornecedor::F1": (0.101175, 2),
        "empenho::E1": (0.06745, 3), "orgao::O1": (0.0, 1), "fornecedor::F2": (0.0, 2), "empenho::E2": (0.0, 3),
    }
    assert one_hop.anomalies.where(F.col("detector") == V.ISOLATED_COMMUNITIES).count() == 0


def test_suite_findings(suite):
    rows = {r["anomaly_id"]: r for r in suite.anomalies.collect()}
    assert {r["detector"] for r in rows.values()} == set(V.DETECTOR_WEIGHTS)
    assert {r["severity"] for r in rows.values()} <= set(V.SEVERITY_RANKS)
    top = rows["centralidade_fornecedores::fornecedor::F1"]
    assert (top["rank"], top["metric_value"], top["neighbor_count"], top["node_label"]) == (1, 400000.0, 2, "Papelaria Horta")
    assert top["zscore"] == pytest.approx(0.6745)
    group = next(r for r in rows.values() if r["detector"] == V.ISOLATED_COMMUNITIES)
    assert (group["node_count"], group["internal_edges"], group["external_edges"], group["edge_density"]) == (4, 3, 0, 0.5)
    assert (group["severity"], group["isolation_score"], group["node_types"]) == ("alta", 1.0, ["fornecedor", "orgao"])
    assert suite.samples.count() == 4
    first = suite.neighbors.where("anomaly_id = 'centralidade_fornecedores::fornecedor::F1' and rank = 1").first()
    assert (first["neighbor_id"], first["label"], first["node_valor"]) == ("empenho::E3", "Estudo de solo", 250000.0)


def test_risk_signals_count_the_anomalies_naming_a_node(suite):
    members = K.anomaly_members(suite.anomalies, suite.nodes, suite.samples)
    counts = as_dict(members.groupBy("node_id").count(), "node_id", "count")
    assert as_dict(suite.risk, "node_id", "signals") == counts


def test_report_documents(suite, basic_graph):
    documents = {r["anomaly_id"]: json.loads(r["document"]) for r in report(suite, basic_graph.vertices).collect()}
    assert len(documents) == suite.anomalies.count()
    central = documents["centralidade_fornecedores::fornecedor::F1"]
    context = central["context"]
    assert central["severity"] == "baixa" and context["node_id"] == "fornecedor::F1"
    assert [n["id"] for n in context["top_neighbors"]] == ["empenho::E3", "empenho::E1"]
    assert context["subgraph"]["focus"] == "fornecedor::F1"
    assert [n["id"] for n in context["subgraph"]["nodes"]] == ["fornecedor::F1", "empenho::E3", "empenho::E1"]
    assert {(x["source"], x["target"]) for x in context["subgraph"]["links"]} == {("empenho::E1", "fornecedor::F1"), ("empenho::E3", "fornecedor::F1")}
    group = next(d for k, d in documents.items() if k.startswith(V.ISOLATED_COMMUNITIES))
    assert len(group["context"]["sample_nodes"]) == 4 and "rank" not in group["context"]


def test_limit_per_detector(suite):
    assert limit_per_detector(suite.anomalies, None).count() == suite.anomalies.count()
    kept = limit_per_detector(suite.anomalies, 1)
    assert kept.count() == 4
    assert kept.where(F.col("detector") == V.CENTRAL_AGENCIES).first()["node_id"] == "orgao::O2"


def star(spark, weights):
    """Suppliers with one agency each, except those with a list of several."""
    rows, ids = [], set()
    for supplier, amounts in weights.items():
        ids.add((supplier, "fornecedor", supplier))
        for n, amount in enumerate(amounts):
            rows.append((f"o{n}", supplier, "x", float(amount)))
            ids.add((f"o{n}", "orgao", f"o{n}"))
    vertices = spark.createDataFrame(sorted(ids), "id string, node_type string, nome string")
    return vertices, spark.createDataFrame(rows, EDGE)


def test_entropy_candidates_and_fallback(spark):
    weights = {f"f{n:02d}": [1, 1, 0.01 * n + 0.01] for n in range(9)} | {"wide": [1] * 40}
    vertices, edges = star(spark, weights)
    chosen = D.rank_entropy(edges, vertices, V.FORNECEDOR, V.ORGAO).collect()
    assert [r["node_id"] for r in chosen] == ["wide"] and chosen[0]["zscore"] >= 1.5
    # Nothing reaches the score: the largest values stand in, whatever the minimum.
    fallback = D.rank_entropy(edges, vertices, V.FORNECEDOR, V.ORGAO, threshold=100.0, zscore_threshold=99.0)
    assert [r["node_id"] for r in fallback.orderBy("rank").collect()] == ["wide", "f08", "f07", "f06", "f05", "f04"]


def test_entropy_statistics_use_the_nodes_at_or_above_the_minimum(spark):
    vertices, edges = star(spark, {"a": [1], "b": [1, 1], "c": [1, 1, 1], "d": [1, 1, 1, 1]})
    rows = D.rank_entropy(edges, vertices, V.FORNECEDOR, V.ORGAO, threshold=0.5, zscore_threshold=0.0).collect()
    # Sample 1, log2(3), 2: the median is log2(3) and the MAD 2 - log2(3).
    assert {r["node_id"]: round(r["zscore"], 4) for r in rows} == {"d": 0.6745, "c": 0.0}


def test_centrality_ties_go_by_id(spark):
    vertices, edges = star(spark, {f"f{n}": [5] for n in range(12)})
    ranked = D.rank_centrality(SpendGraph(vertices, edges), V.FORNECEDOR, top_k=3).orderBy("rank").collect()
    assert [(r["rank"], r["node_id"]) for r in ranked] == [(1, "f0"), (2, "f1"), (3, "f10")]


def test_community_fallback_is_the_largest_then_most_isolated(spark):
    measures = spark.createDataFrame(
        [("a", 1, 0.5), ("b", 1, 0.9), ("c", 1, 0.9)], "community string, size long, isolation_score double"
    )
    rows = D.score_communities(measures, min_size=2).collect()
    assert [(r["community"], r["fallback_selected"]) for r in rows] == [("b", True)]
    assert rows[0]["reason"].endswith("mínimo considerado: 2)")
    assert D.score_communities(measures, min_size=1).count() == 3
    assert D.score_communities(measures.where("false")).count() == 0


def test_empty_graph_has_no_findings(spark, basic):
    empty = build_graph(*normalize(type(basic)(*[t.where("false") for t in basic])))
    found = run_suite(empty)
    assert found.anomalies.count() == 0 and found.risk.count() == 0


def test_results_do_not_depend_on_order_or_partitions(spark, basic_graph, suite):
    shuffled = SpendGraph(
        basic_graph.vertices.repartition(7), basic_graph.edges.orderBy(F.desc("src")).repartition(3), basic_graph.end_types
    )
    assert scores(run_suite(shuffled).risk) == scores(suite.risk)


def test_sample_and_synthetic_payloads(spark):
    graph = load_graph(collections_of(spark, SAMPLE)).graph
    assert (graph.num_vertices(), graph.num_edges()) == (8, 6)
    made = synthetic.generate(spark, seed=11, today=F.lit("2024-06-30").cast("date"))
    found = run_suite(load_graph(made)[0])
    leader = found.anomalies.where((F.col("detector") == V.CENTRAL_SUPPLIERS) & (F.col("rank") == 1)).first()
    assert leader["node_id"] == "fornecedor::F-HUB" and leader["severity"] == "alta"
    named = K.anomaly_members(found.anomalies.where(F.col("detector") == V.ISOLATED_COMMUNITIES), found.nodes, found.samples)
    assert named.where("node_id = 'fornecedor::F-ISO'").count() >= 1


def test_severity_of_nodes(spark):
    anomalies = spark.createDataFrame(
        [("1", "d", "n", 1.0, "baixa", None), ("2", "d", "n", 2.0, "estranha", "r"), ("3", "e", "m", None, "alta", "r")],
        "anomaly_id string, detector string, node_id string, score double, severity string, reason string",
    )
    signals = K.node_signals(anomalies, K.anomaly_members(anomalies))
    assert {(r["node_id"], r["severity"], r["signals"]) for r in K.node_severity(signals).collect()} == {("n", "media", 2), ("m", "alta", 1)}
    assert as_dict(signals, "anomaly_id", "reason")["1"] == "d"
    assert as_dict(K.count_by_severity(anomalies), "severity", "anomalies") == {"baixa": 1, "estranha": 1, "alta": 1, "total": 3}


def test_suite_on_numbers(spark, tmp_path, monkeypatch):
    """Numbers in place of ids change no table of the suite, and no pair is stored as text."""
    lines = [(o, n, 10 * o + n, (7 * o + n) % 12, 100.25 * o + n) for o in range(1, 25) for n in range(1, 4)]
    tables = {
        "lineitem": spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double")
        .withColumns({"l_returnflag": F.lit("R"), "l_linestatus": F.lit("F"), "l_shipdate": F.lit("1995-03-01").cast("timestamp_ntz")}),
        # Some orders name no customer, or one that is not there; supplier 11 is not there either.
        "orders": spark.range(1, 25).select(F.col("id").alias("o_orderkey"), F.expr("if(id % 9 = 0, null, id % 13)").alias("o_custkey")),
        "customer": spark.range(12).selectExpr("id as c_custkey", "'c' || id as c_name", "0 as c_nationkey", "'m' as c_mktsegment"),
        "supplier": spark.range(11).selectExpr("id as s_suppkey", "'s' || id as s_name", "0 as s_nationkey"),
        "nation": spark.sql("select 0 as n_nationkey, 'N' as n_name"),
    }
    for name, table in tables.items():
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    kept, plain = [], plans.stored
    monkeypatch.setattr(plans, "stored", lambda df, name: kept.append((name, df.dtypes)) or plain(df, name))

    def rows(with_numbers):
        found = run_suite(T.stored_graph(spark, str(tmp_path), with_numbers=with_numbers))
        # Sums of logarithms depend on the order of the rows in their last bits.
        return {name: sorted(map(repr, rounded(table).collect())) for name, table in found._asdict().items()}

    def rounded(table):
        return table.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in table.dtypes])

    numbered = rows(True)
    pairs = dict(kept)["projected"]
    assert pairs == [("source_id", "bigint"), ("target_id", "bigint"), ("weight", "double")]
    assert numbered["links"] and any("comunidades" in row for row in numbered["samples"])
    assert rows(False) == numbered
