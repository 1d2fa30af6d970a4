import json
import os
import shutil
import subprocess
import sys
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from conftest import BASIC, SF, as_dict
from ledgernet import schema as S
from ledgernet.operators import normalize as N
from ledgernet.operators import quality as Q
from ledgernet.operators.enrichment import enrich_suppliers, registry_table
from ledgernet.operators.graph_build import filter_period
from ledgernet.operators.state_records import flatten, scan_years
from ledgernet.plans.load import clean, load_graph
from ledgernet.sources import pages, registry, synthetic
from ledgernet.sources.payload import collections_of, scan_payloads


def payload(**changes):
    return {**BASIC, **changes}


def test_normalised_tables_have_all_columns(spark, basic_tables):
    assert basic_tables.commitments.columns == S.COMMITMENTS.names
    assert basic_tables.commitments.orderBy("empenho_id").first()["orgao_id"] == "O1"
    bare = spark.createDataFrame([("E10", "x")], "id string, outra string")
    row = N.normalize_commitments(bare).first()
    assert row["empenho_id"] == "E10" and row["numero_empenho"] is None and row["valor_empenhado"] is None
    assert "outra" not in row
    assert N.normalize_suppliers(bare.where("false")).count() == 0


def test_strict_validation_fails_and_quarantine_splits(spark):
    bad = collections_of(spark, payload(empenhos=[{"numero": "123"}, BASIC["empenhos"][0]]))
    with pytest.raises(Exception, match="missing_id"):
        load_graph(bad)[0].edges.count()
    graph, tables, rejected, counters = load_graph(bad, mode="quarantine")
    assert rejected.commitments.count() > 0 and {r["kind"] for r in counters.collect()} == {"empenhos", "fornecedores", "orgaos"}
    assert tables.commitments.count() == 1
    _, rejected = Q.split_valid(bad.commitments, Q.commitment_checks())
    assert [r["errors"] for r in rejected.collect()] == [["missing_id"]]
    with pytest.raises(ValueError):
        clean(bad, mode="lax")


def test_a_load_reads_each_collection_once(spark, tmp_path):
    """After the pass over them the raw files can go: graph, tables, rejects and counters are there."""
    raw = collections_of(spark, payload(empenhos=[{"numero": "1"}, BASIC["empenhos"][0], BASIC["empenhos"][0], BASIC["empenhos"][1]]))
    for name, table in raw._asdict().items():
        table.write.parquet(str(tmp_path / name))
    raw = raw._replace(**{name: spark.read.parquet(str(tmp_path / name)) for name in raw._fields})
    judged = Q.judge(raw.commitments, Q.commitment_checks(), "empenhos", "quarantine")
    assert judged._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    graph, tables, rejected, counters = load_graph(raw, mode="quarantine")
    shutil.rmtree(tmp_path)
    assert graph.edges.count() == 6 and tables.commitments.where("payload_hash is null").count() == 0
    assert as_dict(tables.commitments, "empenho_id", "valor_empenhado") == {"E1": 150000.0, "E2": 90000.0}
    assert [(r["numero"], r["errors"]) for r in rejected.commitments.collect()] == [("1", ["missing_id"])]
    told = {r["kind"]: (r["row_count"], r["duplicates"], r["negatives"]) for r in counters.collect()}
    assert told == {"empenhos": (3, 1, 0), "fornecedores": (2, 0, 0), "orgaos": (2, 0, 0)}


def test_repeats_of_known_keys_are_dropped(spark):
    """Null keys are one key; a key with most of the rows is limited before the shuffle."""
    rows = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k"), "id"
    )
    repeated = Q.repeated_keys(rows, ["k"])
    assert sorted((r["k"] or "", r["copies"]) for r in repeated.collect()) == [("", 1333), ("hot", 1334)]
    once = Q.without_repeats(rows, repeated, ["k"], ["id"])
    assert once._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2
    assert sorted(r["id"] for r in once.collect()) == sorted([0, 2, *range(1, 4000, 3)])
    assert Q.without_repeats(rows.limit(0), repeated, ["k"], ["id"]).count() == 0


def test_repeated_commitments_are_loaded_once(spark):
    first = BASIC["empenhos"][0]
    twice = collections_of(spark, payload(empenhos=[first, {**first, "valor_empenhado": 1.0}]))
    tables = load_graph(twice).tables
    assert [r["valor_empenhado"] for r in tables.commitments.collect()] == [150000.0]


def test_dedup_of_a_hot_key_limits_before_the_shuffle(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), "id")
    kept = Q.dedup_first(df, ["k"], ["id"])
    assert kept.count() == 2001
    assert kept.where("k = -1").first()["id"] == 0
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_negative_amounts_are_dropped_and_counted(spark):
    df = spark.createDataFrame([(1, 5.0), (2, -1.0), (3, None)], "id int, valor_empenhado double")
    seen = Observation("negatives")
    assert Q.drop_negative(df, seen=seen).count() == 2
    assert seen.get == {"dropped_negative": 1}


def test_quality_report(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, -2.0), ("b", 2, -3.0)], "id string, position int, v double")
    row = Q.quality_report(df, "empenhos", ["id"], ["position"], "v").first()
    assert tuple(row) == ("empenhos", 3, 1, 1)


def test_lineage_and_fingerprint(spark, basic):
    stamped = N.with_lineage(basic, "manual")
    row = stamped.commitments.select(*S.LINEAGE).distinct().collect()
    assert len(row) == 1 and row[0]["fonte_origem"] == "manual" and len(row[0]["payload_hash"]) == 64
    one = basic.commitments
    same = N.fingerprint(one.repartition(3)).first()[0]
    assert same == N.fingerprint(one.repartition(1).orderBy(F.desc("id"))).first()[0]
    assert same != N.fingerprint(one.unionByName(one).unionByName(one)).first()[0]
    assert same != N.fingerprint(one.withColumn("numero", F.lit("x"))).first()[0]


def test_unused_fingerprint_is_not_computed(spark, basic):
    plan = N.with_lineage(basic, "manual").commitments.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "xxhash64" not in plan


def test_period_filter_includes_bounds_and_keeps_undated_without_bounds(spark, basic_tables):
    kept = filter_period(basic_tables.commitments, "2023-02-01", "2023-02-28")
    assert [r["numero_empenho"] for r in kept.collect()] == ["2023-0002"]
    undated = basic_tables.commitments.withColumn("data_empenho", F.lit(None).cast("timestamp_ntz"))
    assert filter_period(undated).count() == 3
    assert filter_period(undated, start="2000-01-01").count() == 0
    assert filter_period(basic_tables.commitments, end="2023-01-15").count() == 1


def test_payload_file(spark, tmp_path):
    file = tmp_path / "payload.json"
    file.write_text(json.dumps(BASIC, ensure_ascii=False, indent=1), encoding="utf-8")
    raw = scan_payloads(spark, str(file))
    assert as_dict(raw.suppliers, "id", "nome") == {"F1": "Papelaria Horta", "F2": "Obras do Vale"}
    tables = load_graph(raw).tables
    assert as_dict(tables.commitments, "empenho_id", "valor_empenhado") == {"E1": 150000.0, "E2": 90000.0, "E3": 250000.0}
    (tmp_path / "bad.json").write_text("not json")
    with pytest.raises(Exception):
        scan_payloads(spark, str(tmp_path / "bad.json")).suppliers.collect()


def land(folder, pages_):
    for number, envelope in pages_.items():
        (folder / f"page={number}").mkdir(parents=True)
        (folder / f"page={number}" / "part.json").write_text(json.dumps(envelope))
    return str(folder)


def ids(rows):
    return [r["id"] for r in rows.orderBy("position").collect()]


def test_pages_stop_at_the_first_empty_one(spark, tmp_path):
    one, two = {"data": [{"id": "1"}, {"id": "2"}]}, {"data": [{"id": "3"}]}
    path = land(tmp_path / "a", {1: one, 2: two, 3: {"data": []}, 4: {"data": [{"id": "9"}]}})
    assert ids(pages.scan_suppliers(spark, path)) == ["1", "2", "3"]
    assert ids(pages.scan_suppliers(spark, path, max_pages=1)) == ["1", "2"]
    assert ids(pages.scan_offset_pages(spark, path, S.RAW_SUPPLIER, 2, "data")) == ["1", "2", "3"]


def test_a_page_without_the_key_fails_unless_it_comes_after_the_end(spark, tmp_path):
    path = land(tmp_path / "a", {1: {"unexpected": []}})
    with pytest.raises(Exception, match="without 'data'"):
        pages.scan_agencies(spark, path).collect()
    path = land(tmp_path / "b", {1: {"data": []}, 2: {"unexpected": []}})
    assert pages.scan_agencies(spark, path).count() == 0


STATE = [
    ("Secretaria de Inovação", "2024", "5", "42", "JURÍDICA", "12345678000199", "TECNOLOGIA", "150000.50", None, 0),
    ("Secretaria de Educação", "2024", "6", "77", "JURÍDICA", "99887766000111", "EDUCAÇÃO", "999.0", None, 1),
    ("Secretaria de Inovação", "2023", "13", "43", "FÍSICA", "12345678000199", None, None, "1.000,5", 2),
    (None, None, "1", None, None, None, "", None, None, 3),
]
STATE_DDL = ", ".join(f"{f.name} string" for f in S.STATE_RECORD) + ", position long"


def test_state_records_flatten_to_a_payload(spark):
    records = spark.createDataFrame(STATE, STATE_DDL)
    flat = flatten(records)
    rows = {r["numero"]: r for r in flat.commitments.collect()}
    assert rows["42"]["id"] == "empenho-2024-5-secretaria-de-inovacao-42-12345678000199-c7cef2595e"
    assert (rows["42"]["descricao"], rows["42"]["data_empenho"]) == ("Função: TECNOLOGIA", "2024-05-01")
    assert (rows["43"]["valor_empenhado"], rows["43"]["data_empenho"], rows["43"]["descricao"]) == ("1.000,5", None, None)
    assert rows["None"]["fornecedor_id"] == "fornecedor-desconhecido"
    assert rows["None"]["id"].startswith("empenho-none-1-none-")
    names = as_dict(flat.agencies, "id", "nome")
    assert names["orgao-secretaria-de-inovacao-918bb88e3f"] == "Secretaria de Inovação"
    assert names["orgao-desconhecido"] == "Unidade não informada"
    assert flat.suppliers.count() == 4 and len(names) == 3
    assert as_dict(flat.suppliers, "id", "documento")["fornecedor-desconhecido"] is None


def test_a_state_amount_that_is_no_number_stops_the_load(spark):
    bad = spark.createDataFrame([(*STATE[0][:7], "n/d", None, 0)], STATE_DDL)
    with pytest.raises(Exception, match="bad_amount"):
        load_graph(flatten(bad))[0].edges.collect()


def test_pages_keep_json_kinds_and_fail_on_damage(spark, tmp_path):
    good = tmp_path / "good"
    good.mkdir()
    (good / "1.json").write_text(
        '{"page": 1, "Empenhos": [{"Unidade": "a", "Empenho": 0, "Empenhado": "5"}, {"Empenho": "0", "Empenhado": 1.5},'
        ' {"Empenho": 2.50, "Empenhado": false}, {"Empenho": " ", "Empenhado": null}, {"Empenhado": ""}]}\n'
    )
    rows = pages.scan_state_records(spark, str(good)).select("Empenho", "Empenhado").collect()
    assert [tuple(r) for r in rows] == [(None, "5"), ("0", "1.5"), ("2.5", None), (" ", None), (None, None)]
    for number, line in enumerate(['{"page": "x", "data": []}', '{"data": [{"id": "1"}]}', '{"page": 2, "data": ']):
        path = tmp_path / f"bad{number}"
        path.mkdir()
        (path / "p.json").write_text('{"page": 1, "data": [{"id": "7"}]}\n' + line + '\n{"page": 3, "data": []}\n')
        with pytest.raises(Exception):
            pages.scan_commitments(spark, str(path)).collect()


def test_an_id_has_to_be_text(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"empenhos": [{"id": {"a": 1}}, {"id": 7}, {"id": null}, {}, {"id": "ok"}], "fornecedores": [], "orgaos": []}')
    ids = [r["id"] for r in scan_payloads(spark, str(tmp_path / "p.json")).commitments.collect()]
    assert ids == [None, None, None, None, "ok"]


def test_registry_text_is_unquoted(spark, tmp_path):
    (tmp_path / "e.csv").write_bytes('CNPJ;RazaoSocial;Capital_Social\n1;"A ""B""; C";5\n2;"D\nE";6\n3;F\\;7\n'.encode("latin-1"))
    rows = registry.scan_registry(spark, str(tmp_path / "e.csv"), registry.COMPANIES, line_breaks=True)
    got = [(r["cnpj"], r["razao_social"], r["capital_social"]) for r in rows.orderBy("cnpj").collect()]
    assert got == [("1", 'A "B"; C', "5"), ("2", "D\nE", "6"), ("3", "F\\", "7")]


def test_caps(spark):
    records = spark.createDataFrame(STATE, STATE_DDL)
    capped = flatten(records, limit=1)
    assert [r["numero"] for r in capped.commitments.collect()] == ["42"]
    assert capped.suppliers.count() == 1 and capped.agencies.count() == 1
    ordered = scan_years(records, ["2023", "2024"], max_records=2).collect()
    assert sorted(r["NumeroEmpenho"] for r in ordered) == ["42", "43"]
    assert scan_years(records, [], max_records=None).count() == 4


CSV = "CNPJ_BASICO;Nome_Fantasia;CNAE_FISCAL;extra\n00000001;Padaria Açaí;0111;x\n00000001;;0222;x\n00000002;Zé;;x\n"


def test_registry_from_text_and_archives(spark, tmp_path):
    (tmp_path / "e.csv").write_bytes(CSV.encode("latin-1"))
    with zipfile.ZipFile(tmp_path / "Estabelecimentos0.zip", "w") as archive:
        archive.writestr("first.csv", CSV.encode("latin-1"))
        archive.writestr("second.csv", b"ignored")
    zipfile.ZipFile(tmp_path / "Estabelecimentos1.zip", "w").close()
    plain = registry.scan_registry(spark, str(tmp_path / "e.csv"), registry.ESTABLISHMENTS)
    zipped = registry.scan_zipped_registry(spark, str(tmp_path / "Estabelecimentos*.zip"), registry.ESTABLISHMENTS)
    assert plain.columns == list(registry.ESTABLISHMENTS) == zipped.columns
    want = [("00000001", None, "0222"), ("00000001", "Padaria Açaí", "0111"), ("00000002", "Zé", None)]
    for table in (plain, zipped):
        rows = table.select("cnpj", "nome_fantasia", "cnae_principal").orderBy("cnpj", "nome_fantasia").collect()
        assert [tuple(r) for r in rows] == want

    out = str(tmp_path / "parquet")
    registry.convert_registry(spark, str(tmp_path), out)
    assert spark.read.parquet(f"{out}/estabelecimentos.parquet").count() == 3
    assert registry.scan_zipped_registry(spark, str(tmp_path / "Socios*.zip"), registry.PARTNERS).count() == 0
    # The companies are missing, so there is nothing to enrich with.
    assert [t.count() for t in registry.read_registry(spark, out)] == [0, 0]


def test_archives_are_partitions_written_and_read_by_tasks(spark, tmp_path):
    rows = spark.range(900).selectExpr("cast(id as string) as CNPJ", "concat('Ação ', id, '; \"x\"') as RazaoSocial", "null as pais")
    registry.write_zipped(rows.repartition(4).select("CNPJ", "RazaoSocial"), str(tmp_path / "zip"), "Empresas")
    files = sorted(f.name for f in (tmp_path / "zip").iterdir())
    assert files == [f"Empresas{i}.zip" for i in range(4)]
    back = registry.scan_zipped_registry(spark, f"{tmp_path}/zip/Empresas*.zip", registry.COMPANIES)
    assert back.rdd.getNumPartitions() == 4
    assert as_dict(back, "cnpj", "razao_social") == {str(i): f'Ação {i}; "x"' for i in range(900)}
    (tmp_path / "zip" / "Empresas9.zip").write_bytes(b"no archive, but long enough to look for an end record in it")
    with pytest.raises(Exception, match="not a zip file"):
        registry.scan_zipped_registry(spark, f"{tmp_path}/zip/Empresas*.zip", registry.COMPANIES).count()


BARE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from __spark_entry__ import queries
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
for name in {names!r}:
    print(name, queries()[name](spark, {sf!r}).count(), flush=True)
"""


def test_workers_need_not_have_the_package(tmp_path):
    """Only the driver's script finds the library, workers do not."""
    names = ["scan_registry_zip", "convert_registry", "snapshot_xml"]
    script = tmp_path / "bare.py"
    script.write_text(BARE.format(repo=str(Path(__file__).resolve().parent.parent), names=names, sf=SF))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert [line.split()[0] for line in done.stdout.splitlines()] == names, done.stderr[-3000:]


def test_enrichment_by_root_and_full_number_never_multiplies(spark):
    suppliers = spark.createDataFrame(
        [("1", "", "12.345.678/0001-90"), ("2", "Nome", "12345678000190"), ("3", None, None), ("4", None, "99.999.999/0001-99"), ("5", None, ""), ("6", None, "123.456.789-09")],
        "id string, nome string, documento string",
    )
    companies = spark.createDataFrame(
        [("12345678", "B SA", "10"), ("12345678", "A SA", "20"), ("99999999", "", None)],
        "cnpj string, razao_social string, capital_social string",
    )
    establishments = spark.createDataFrame(
        [("12345678000190", "Loja", "1", "d"), ("12345678000190", "Casa", "2", "d"), ("99999999000199", "Fantasia", "3", "d")],
        "cnpj string, nome_fantasia string, cnae_principal string, data_inicio_atividade string",
    )
    rows = {r["id"]: r for r in enrich_suppliers(suppliers, companies, establishments).collect()}
    assert len(rows) == 6 and rows["6"]["razao_social"] is None
    assert (rows["1"]["nome"], rows["1"]["capital_social"], rows["1"]["nome_fantasia"]) == ("A SA", "20", "Casa")
    assert rows["2"]["nome"] == "Nome"
    assert rows["4"]["nome"] == "Fantasia"
    assert rows["3"]["nome"] is None and rows["5"]["razao_social"] is None
    empty = enrich_suppliers(suppliers, companies.where("false"), establishments.where("false"))
    assert empty.count() == 6


def test_registry_is_filtered_before_it_moves(spark):
    """Of 100,000 companies those of 50 suppliers reach the shuffle."""
    companies = spark.range(100_000).selectExpr("lpad(id, 8, '0') as cnpj", "concat('C', id) as razao_social")
    suppliers = spark.range(50).selectExpr("cast(id as string) as id", "null as nome", "concat(lpad(id * 7, 8, '0'), '000199') as documento")
    wanted = spark.range(50).selectExpr("lpad(id * 7, 8, '0') as registry_key")
    reduced = registry_table(companies, companies.limit(0), wanted)
    assert 50 <= reduced.count() < 200
    assert reduced.join(wanted, "registry_key", "left_semi").count() == 50
    plan = reduced._jdf.queryExecution().executedPlan().toString()
    assert plan.index("hashpartitioning(registry_key") < plan.index("BroadcastHashJoin")
    names = as_dict(enrich_suppliers(suppliers, companies, companies.limit(0)), "id", "nome")
    assert names == {str(i): f"C{i * 7}" for i in range(50)}


def test_synthetic_payload_is_seeded_and_holds_the_patterns(spark):
    today = F.lit("2024-06-30").cast("date")
    made = synthetic.generate(spark, seed=3, today=today)
    assert [t.count() for t in made] == [49, 12, 8]
    again = synthetic.generate(spark, seed=3, today=today)
    assert made.commitments.exceptAll(again.commitments.repartition(7)).count() == 0
    assert made.commitments.exceptAll(synthetic.generate(spark, seed=4, today=today).commitments).count() > 0
    hub = made.commitments.where("fornecedor_id = 'F-HUB'")
    assert hub.select("unidade_gestora_id").distinct().count() == 6
    low, high = hub.select(F.min(F.col("valor_empenhado").cast("double")), F.max(F.col("valor_empenhado").cast("double"))).first()
    assert 342_000 <= low <= high <= 572_000
    weak = made.commitments.where("fornecedor_id = 'F-ISO' and unidade_gestora_id not like 'O-ISO%'").collect()
    assert len(weak) == 1 and weak[0]["contrato_id"] is None
    plain = synthetic.generate(spark, include_contracts=False, today=today)
    assert plain.commitments.where("contrato_id is not null").count() == 0
