import json

import pytest
from pyspark.sql import functions as F

from conftest import as_dict
from ledgernet import schema as S
from ledgernet import vocabulary as V
from ledgernet.graph import SpendGraph
from ledgernet.operators.graph_build import dangling_edges, graph_summary
from ledgernet.operators import membership as H
from ledgernet.operators.metrics import weighted_degree
from ledgernet.operators.projection import agency_supplier_links
from ledgernet.sources import export, workspace
from ledgernet.streaming import ingest as I


def test_node_link_leaves_nulls_out(spark, basic_graph, tmp_path):
    export.write_node_link(basic_graph, str(tmp_path))
    nodes = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "nodes")).collect()]
    links = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "links")).collect()]
    assert len(nodes) == 10 and len(links) == 9
    contract = next(n for n in nodes if n["id"] == "contrato::C1")
    assert contract == {"id": "contrato::C1", "type": "contrato", "original_id": "C1"}
    assert {"source", "target", "type", "valor"} == set(links[0])


def test_graph_xml(spark, basic_graph, tmp_path):
    export.write_graph_xml(basic_graph, str(tmp_path))
    nodes = spark.read.format("xml").option("rowTag", "node").load(str(tmp_path / "nodes"))
    contract = nodes.where("_id = 'contrato::C1'").first()
    assert {(d["_key"], d["_VALUE"]) for d in contract["data"]} == {("type", "contrato"), ("original_id", "C1")}
    edges = spark.read.format("xml").option("rowTag", "edge").load(str(tmp_path / "edges"))
    assert edges.count() == 9 and {"_source", "_target"} <= set(edges.columns)


def test_graph_xml_is_read_as_it_was_written(spark, tmp_path):
    texts = ["plain", "", " a ", 'say "<b>" & more', "line\nbreak\tx", "ção", '"><data key="', "&amp;", None]
    rows = [(f"n{i}::{t}", "t", t, t, float(i)) for i, t in enumerate(texts)]
    node = spark.createDataFrame(rows, "id string, node_type string, nome string, numero string, valor double")
    vertices = node.select(*[F.col(c) if c in node.columns else F.lit(None).cast(S.VERTICES[c].dataType).alias(c) for c in S.VERTICES.names])
    edges = node.selectExpr("id as src", "concat('to ', id) as dst", "nome as edge_type", "valor")
    export.write_graph_xml(SpendGraph(vertices.where("id is not null"), edges.where("src is not null")), str(tmp_path))
    nodes = export.read_graph_xml(spark, str(tmp_path / "nodes"), "node", ["id"], ["type", "nome", "numero", "valor", "uf"])
    got = sorted(tuple(r) for r in nodes.collect())
    # A parser reads a tab between quotation marks as a blank.
    want = [(i.replace("\t", " "), "t", t, t, str(v), None, 2 if t is None else 4) for i, _, t, _, v in rows]
    assert got == sorted(want)
    links = export.read_graph_xml(spark, str(tmp_path / "edges"), "edge", ["source", "target"], ["type"]).collect()
    assert sorted(tuple(r) for r in links) == sorted((i, f"to {i}", t, 1 if t is None else 2) for i, _, t, *_ in want)


def test_plain_elements_are_cut_apart_and_others_parsed(spark, tmp_path):
    lines = ["<?xml version='1.0'?>", "<graphml>", '<node id="a"></node>', "<node id='b'/>", '<node id="c"><data key="x">1</data></node>',
             '<node id="x"><data key="z">x</data><data key="x"> é </data><data key="y"></data></node>',
             '<node id="e&amp;"><data key="x"/><data key="y">&#10;2</data></node>', "</graphml>"]
    (tmp_path / "part.xml").write_text("\n".join(lines))
    got = sorted(tuple(r) for r in export.read_graph_xml(spark, str(tmp_path), "node", ["id"], ["x", "y"]).collect())
    assert got == [("a", None, None, 0), ("b", None, None, 0), ("c", "1", None, 1), ("e&", "", "\n2", 2), ("x", " é ", "", 3)]


def test_stored_graph_gives_the_same_answers(spark, basic_graph, basic_tables, tmp_path):
    from ledgernet.operators.graph_build import build_graph

    graph = build_graph(*basic_tables, include_contracts=True, unique_commitments=True)
    export.write_graph(graph, str(tmp_path))
    back = export.read_graph(spark, str(tmp_path))
    assert back.vertices.exceptAll(graph.vertices).count() == 0 and back.num_vertices() == 10
    assert back.edges.exceptAll(graph.edges).count() == 0 and back.num_edges() == 9
    assert as_dict(weighted_degree(back, V.ORGAO), "node_id", "centrality") == {"orgao::O1": 240000.0, "orgao::O2": 250000.0}
    assert agency_supplier_links(back).count() == 3
    scan = back.edges.where("edge_type = 'orgao_empenho'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(edge_type" in scan


def test_report_files(spark, basic_graph, basic_tables, tmp_path):
    summary = graph_summary(basic_graph, *basic_tables)
    documents = spark.createDataFrame([("d", "a", 1.0, "{}")], "detector string, anomaly_id string, score double, document string")
    export.write_report(summary, documents, str(tmp_path))
    got = as_dict(spark.read.json(str(tmp_path / "summary")), "table_name", "row_count")
    assert got == {"nodes": 10, "edges": 9, "empenhos": 3, "fornecedores": 2, "orgaos": 2}
    assert spark.read.json(str(tmp_path / "anomalies")).first()["detector"] == "d"


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert workspace.shared_dir(spark) == configured
    assert workspace.scratch_path(spark, "x").startswith(configured)
    df = workspace.cut_lineage(spark.range(10).withColumn("x", F.rand(1)))
    assert "ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()


def test_independent_steps_run_together_and_raise(spark):
    assert workspace.concurrently(lambda: 1, lambda: 2) == [1, 2]
    with pytest.raises(ZeroDivisionError):
        workspace.concurrently(lambda: 1, lambda: 1 / 0)


RECORD = (
    "id string, numero string, descricao string, valor_empenhado string, data_empenho string, "
    "fornecedor_id string, unidade_gestora_id string, contrato_id string, arrived timestamp"
)


def record(id_, amount, minute):
    return (id_, None, None, amount, "2024-01-01", "F1", "O1", None, f"2024-01-01 00:{minute:02d}:00")


def land(spark, path, rows):
    df = spark.createDataFrame(rows, RECORD.replace("arrived timestamp", "arrived string"))
    df.coalesce(1).write.mode("append").json(path)


def test_stream_grows_the_tables_and_drops_copies_and_bad_rows(spark, tmp_path):
    landed, out, state = (str(tmp_path / n) for n in ("landed", "out", "state"))
    run = lambda: I.ingest_commitments(I.read_landed(spark, landed, RECORD), out, state).awaitTermination()
    land(spark, landed, [record("E1", "10,5", 1), record("E1", "99", 2), record(None, "1", 3), record("E2", "x", 4)])
    run()
    assert as_dict(spark.read.parquet(f"{out}/commitments"), "empenho_id", "valor_empenhado") == {"E1": 10.5}
    land(spark, landed, [record("E1", "10,5", 5), record("E3", "2", 6)])
    run()
    edges = spark.read.parquet(f"{out}/edges")
    assert edges.count() == 4 and edges.agg(F.sum("valor")).first()[0] == 25.0
    suppliers = spark.createDataFrame([("F1", "Um"), ("F9", "Nove")], "fornecedor_id string, nome_fornecedor string")
    for name in ("municipio", "uf", "documento", "tipo_documento"):
        suppliers = suppliers.withColumn(name, F.lit(None).cast("string"))
    graph = I.ingested_graph(spark, out, suppliers)
    names = as_dict(graph.vertices, "id", "nome")
    assert names == {"empenho::E1": None, "empenho::E3": None, "fornecedor::F1": "Um", "fornecedor::F9": "Nove", "orgao::O1": None}
    assert dangling_edges(graph).count() == 0
    I.quarantine_rejected(I.read_landed(spark, landed, RECORD), out, state + "-rejected").awaitTermination()
    assert spark.read.parquet(f"{out}/rejected").count() == 2


def test_an_id_that_returns_years_later_is_dropped(spark, tmp_path):
    """Also with bitmaps of 32,768 bits for 3,000 ids, where some new ids share a bit with old ones."""
    landed, out, state = (str(tmp_path / n) for n in ("landed", "out", "state"))
    run = lambda: I.ingest_commitments(I.read_landed(spark, landed, RECORD), out, state, bits=15).awaitTermination()
    land(spark, landed, [record(f"E{i}", "1", 1) for i in range(3000)])
    run()
    late = [(*record(f"E{i}", "2", 1)[:-1], "2031-05-05 00:00:00") for i in range(2990, 6000)]
    land(spark, landed, [*late, late[-1]])
    run()
    land(spark, landed, [record("E5", "3", 1), record("E6001", "3", 1), record("E5999", "3", 2)])
    run()
    amounts = as_dict(spark.read.parquet(f"{out}/commitments"), "empenho_id", "valor_empenhado")
    assert amounts == {**{f"E{i}": 1.0 if i < 3000 else 2.0 for i in range(6000)}, "E6001": 3.0}
    again = spark.read.parquet(f"{out}/repeated").groupBy("batch").count().collect()
    assert {r["batch"]: r["count"] for r in again} == {1: 10, 2: 2}
    assert sorted(p.name for p in (tmp_path / "out" / "seen").iterdir() if p.name.startswith("batch=")) == ["batch=1", "batch=2"]


def test_bitmaps_hold_every_id_and_merge(spark):
    ids = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k"))
    first, second = H.marks(ids.where("k < 'k3'"), "k", 20), H.marks(ids.where("k >= 'k3'"), "k", 20)
    assert H.suspects(ids, "k", H.merged(first, second), 20).count() == 5000
    others = spark.range(5000).select(F.concat(F.lit("z"), "id").alias("k"))
    assert H.suspects(others, "k", H.merged(first, second), 20).count() < 100
    assert H.suspects(ids, "k", H.marks(ids.limit(0), "k", 20), 20).count() == 0


def test_running_degree_equals_the_degree_of_all_rows(spark, tmp_path):
    landed, out, state = (str(tmp_path / n) for n in ("landed", "out", "state"))
    schema = "node_id string, weight double"
    for rows in ([("a", 1.0), ("b", 2.0)], [("a", 3.5)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(landed)
        I.accumulate_degree(I.read_landed(spark, landed, schema), out, state).awaitTermination()
    now = as_dict(I.latest(spark, out, ["node_id"], "centrality"), "node_id", "centrality")
    assert {k: float(v) for k, v in now.items()} == {"a": 4.5, "b": 2.0}
    for weight, total in ((1.0, 5.5), (0.5, 6.0)):
        I.compact(spark, out, ["node_id"], "centrality")
        assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("batch=")]) == 1
        spark.createDataFrame([("a", weight)], schema).coalesce(1).write.mode("append").json(landed)
        I.accumulate_degree(I.read_landed(spark, landed, schema), out, state).awaitTermination()
        now = as_dict(I.latest(spark, out, ["node_id"], "centrality"), "node_id", "centrality")
        assert {k: float(v) for k, v in now.items()} == {"a": total, "b": 2.0}


def test_daily_counts_over_batches(spark, tmp_path):
    landed, out, state = (str(tmp_path / n) for n in ("landed", "out", "state"))
    schema = "ts timestamp, kind string"
    for rows in ([("2024-01-01T10:00:00Z", "a"), ("2024-01-02T10:00:00Z", "a")], [("2024-01-01T12:00:00Z", "a")]):
        spark.createDataFrame(rows, "ts string, kind string").coalesce(1).write.mode("append").json(landed)
        I.count_daily(I.read_landed(spark, landed, schema), "ts", "kind", out, state).awaitTermination()
    now = I.latest(spark, out, ["day", "kind"], "n").collect()
    assert sorted((r["day"].day, r["n"]) for r in now) == [(1, 2), (2, 1)]


def test_graph_files_are_compressed(basic_graph, tmp_path):
    export.write_node_link(basic_graph, str(tmp_path / "json"))
    export.write_graph_xml(basic_graph, str(tmp_path / "xml"))
    parts = [p.name for p in tmp_path.rglob("part-*")]
    assert parts and all(name.endswith(".gz") for name in parts)


def test_edges_in_one_pass(basic_tables):
    from ledgernet.operators.graph_build import build_edges

    gaps = basic_tables.commitments.withColumn("contrato_id", F.expr("if(empenho_id = 'E2', null, contrato_id)"))
    one, many = build_edges(gaps, True, one_pass=True), build_edges(gaps, True)
    assert one.count() == 8 and one.exceptAll(many).count() == 0 and one.columns == many.columns
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan
