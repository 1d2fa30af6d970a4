"""Queries on sources, normalisation, validation and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgernet import schema as S
from ledgernet.catalog import derived as D
from ledgernet.catalog.registered import query
from ledgernet.catalog.sql import statement
from ledgernet.functions import amounts, dates, text
from ledgernet.operators import normalize as N
from ledgernet.operators import quality as Q
from ledgernet.operators.enrichment import enrich_suppliers as enrich
from ledgernet.operators.graph_build import filter_period as by_period
from ledgernet.operators.state_records import flatten, scan_years
from ledgernet.plans.load import load_graph
from ledgernet.sources import pages, synthetic
from ledgernet.sources import registry as R
from ledgernet.sources import tables as T
from ledgernet.sources.payload import scan_payloads
from ledgernet.sources.workspace import delete_path, scratch_path


@query(
    "scan_payload_json",
    statement(
        """select 'empenhos' as kind, empenho_id as id, valor_empenhado as valor from commitments
        union all select 'fornecedores', fornecedor_id, null from suppliers
        union all select 'orgaos', orgao_id, null from agencies""",
        "commitments", "suppliers", "agencies",
    ),
)
def scan_payload_json(spark, sf_dir):
    path = scratch_path(spark, "payloads")
    D.payload_documents(spark, sf_dir).write.json(path)
    tables = N.normalize(scan_payloads(spark, path, one_per_line=True))
    none = F.lit(None).cast("double").alias("valor")
    return (
        tables.commitments.select(F.lit("empenhos").alias("kind"), F.col("empenho_id").alias("id"), F.col("valor_empenhado").alias("valor"))
        .unionByName(tables.suppliers.select(F.lit("fornecedores").alias("kind"), F.col("fornecedor_id").alias("id"), none))
        .unionByName(tables.agencies.select(F.lit("orgaos").alias("kind"), F.col("orgao_id").alias("id"), none))
    )


_PAGES = """select cast(o_orderkey as varchar) as id, o_orderpriority as descricao,
    o_orderkey // 100 + 1 as page, o_totalprice as valor from orders"""


@query("scan_pages", _PAGES)
def scan_pages(spark, sf_dir):
    path = scratch_path(spark, "pages")
    D.order_pages(spark, sf_dir, "data", 100, last=[]).write.json(path)
    return _paged(pages.scan_commitments(spark, path))


@query(
    "scan_offset_pages",
    _PAGES + " union all select 'fim', 'fim', max(o_orderkey) // 100 + 2, 0.0 from orders",
)
def scan_offset_pages(spark, sf_dir):
    path = scratch_path(spark, "offset-pages")
    D.order_pages(spark, sf_dir, "Empenhos", 100, last=["fim"]).write.json(path)
    return _paged(pages.scan_offset_pages(spark, path, S.RAW_COMMITMENT, 100, "Empenhos"))


def _paged(rows):
    return rows.select("id", "descricao", F.col("position.page").alias("page"), amounts.parse_amount(F.col("valor_empenhado")).alias("valor"))


@query(
    "scan_years_capped",
    statement(
        """select ano, numero, doc as documento, valor from state where ano in ('1997', '1995')
        order by case ano when '1997' then 1 else 2 end, l_orderkey, l_linenumber, l_partkey, l_suppkey limit 2000""",
        "state",
    ),
)
def scan_years_capped(spark, sf_dir):
    capped = scan_years(D.state_records(spark, sf_dir), ["1997", "1995"], max_records=2000)
    return capped.select(
        F.col("Ano").alias("ano"), F.col("NumeroEmpenho").alias("numero"), F.col("CPFCNPJ").alias("documento"),
        amounts.parse_amount(F.col("Empenhado")).alias("valor"),
    )


_SUPPLIER_ID = D.stable_id_sql("fornecedor", "doc, tipo")
_AGENCY_ID = D.stable_id_sql("orgao", "trim(unidade)")
_COMMITMENT_ID = D.stable_id_sql("empenho", "ano, mes, trim(unidade), numero, doc")


@query(
    "flatten_state_records",
    statement(
        f"""select {_COMMITMENT_ID} as id, numero, 'Função: ' || funcao as descricao, empenho as valor_empenhado,
          ano || '-' || lpad(mes, 2, '0') || '-01' as data_empenho, {_SUPPLIER_ID} as fornecedor_id,
          {_AGENCY_ID} as unidade_gestora_id from state""",
        "state",
    ),
)
def flatten_state_records(spark, sf_dir):
    flat = flatten(D.state_records(spark, sf_dir)).commitments.drop("position", "contrato_id")
    return flat.withColumn("valor_empenhado", amounts.parse_amount(F.col("valor_empenhado")))


_FIRST = "row_number() over (partition by id order by l_orderkey, l_linenumber, l_partkey, l_suppkey) = 1"


@query(
    "flatten_state_dimensions",
    statement(
        f"""select 'fornecedor' as kind, id, doc as nome, tipo as tipo_documento
          from (select *, {_SUPPLIER_ID} as id from state) qualify {_FIRST}
        union all
        select 'orgao', id, trim(unidade), null from (select *, {_AGENCY_ID} as id from state) qualify {_FIRST}""",
        "state",
    ),
)
def flatten_state_dimensions(spark, sf_dir):
    flat = flatten(D.state_records(spark, sf_dir))
    return flat.suppliers.select(F.lit("fornecedor").alias("kind"), "id", "nome", "tipo_documento").unionByName(
        flat.agencies.select(F.lit("orgao").alias("kind"), "id", "nome", F.lit(None).cast("string").alias("tipo_documento"))
    )


def _company_rows(spark, sf_dir):
    """Customers as companies, their columns named as the source names them."""
    kind = F.col("c_nationkey") % 4
    ending = F.when(kind == 0, ' "Comércio"; Cia').when(kind == 1, "\nFilial").when(kind == 2, "\\").otherwise(" & Cia")
    return T.table(spark, sf_dir, "customer").select(
        F.lpad(F.col("c_custkey").cast("string"), 14, "0").alias("CNPJ"),
        F.concat("c_name", ending).alias("RazaoSocial"),
        F.col("c_acctbal").cast("string").alias("CAPITAL_SOCIAL_DA_EMPRESA"),
        F.col("c_mktsegment").alias("Situacao_Cadastral"),
    )


def _zipped(spark, sf_dir):
    """A folder of archives with companies and establishments; partners are missing."""
    folder = scratch_path(spark, "archives")
    orders = T.table(spark, sf_dir, "orders").select(
        F.concat(F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit("000199")).alias("CNPJ_BASICO"),
        F.concat(F.lit("São "), "o_orderpriority").alias("Nome_Fantasia"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("CNAE_FISCAL"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("DATA_INICIO_ATIVIDADE"),
    )
    R.write_zipped(_company_rows(spark, sf_dir).repartition(3), folder, "Empresas")
    R.write_zipped(orders.repartition(5), folder, "Estabelecimentos")
    return folder


_COMPANY_NAMES = """c_name || case c_nationkey % 4 when 0 then ' "Comércio"; Cia' when 1 then chr(10) || 'Filial' when 2 then chr(92)
    else ' & Cia' end"""


@query(
    "scan_registry",
    f"""select lpad(cast(c_custkey as varchar), 14, '0') as cnpj, {_COMPANY_NAMES} as razao_social, c_acctbal as capital, c_mktsegment as situacao_cadastral from customer""",
)
def scan_registry(spark, sf_dir):
    """Names with quotes, separators, line breaks and backslashes, written and read back."""
    path = scratch_path(spark, "registry")
    _company_rows(spark, sf_dir).write.options(sep=R.SEPARATOR, encoding=R.ENCODING, header=True, escape='"', quoteAll=True).csv(path)
    return R.scan_registry(spark, path, R.COMPANIES, line_breaks=True).select(
        "cnpj", "razao_social", F.col("capital_social").try_cast("double").alias("capital"), "situacao_cadastral"
    )


@query(
    "scan_registry_zip",
    f"""select lpad(cast(c_custkey as varchar), 14, '0') as cnpj, {_COMPANY_NAMES} as razao_social,
      c_acctbal as capital, c_mktsegment as situacao_cadastral from customer""",
)
def scan_registry_zip(spark, sf_dir):
    """The same names as in plain text, from several archives."""
    rows = R.scan_zipped_registry(spark, f"{_zipped(spark, sf_dir)}/Empresas*.zip", R.COMPANIES)
    return rows.select("cnpj", "razao_social", F.col("capital_social").try_cast("double").alias("capital"), "situacao_cadastral")


_CONVERTED = f"""select 'empresa' as kind, lpad(cast(c_custkey as varchar), 14, '0') as cnpj, {_COMPANY_NAMES} as nome,
      null as cnae, null as inicio from customer
    union all
    select 'estabelecimento', lpad(cast(o_orderkey as varchar), 8, '0') || '000199', 'São ' || o_orderpriority,
      nullif(o_orderstatus, 'F'), strftime(o_orderdate, '%Y-%m-%d') from orders"""


def _converted(spark, sf_dir):
    folder = _zipped(spark, sf_dir)
    R.convert_registry(spark, folder, f"{folder}-parquet")
    return f"{folder}-parquet"


@query("convert_registry", _CONVERTED)
def convert_registry(spark, sf_dir):
    """Archives to Parquet and read back; the table without archives is left out."""
    companies, establishments = R.read_registry(spark, _converted(spark, sf_dir))
    none = F.lit(None).cast("string")
    return companies.select(
        F.lit("empresa").alias("kind"), "cnpj", F.col("razao_social").alias("nome"), none.alias("cnae"), none.alias("inicio")
    ).unionByName(
        establishments.select(
            F.lit("estabelecimento").alias("kind"), "cnpj", F.col("nome_fantasia").alias("nome"),
            F.col("cnae_principal").alias("cnae"), F.col("data_inicio_atividade").alias("inicio"),
        )
    )


@query(
    "read_registry_missing",
    "select 'estabelecimentos' as gone, cast(s_suppkey as varchar) as id, s_name as nome, null as razao_social from supplier",
)
def read_registry_missing(spark, sf_dir):
    """Without one of the tables there is no registry, and suppliers stay as they are."""
    folder = _converted(spark, sf_dir)
    delete_path(spark, f"{folder}/estabelecimentos.parquet")
    rows = enrich(T.raw_collections(spark, sf_dir).suppliers, *R.read_registry(spark, folder))
    return rows.select(F.lit("estabelecimentos").alias("gone"), "id", "nome", "razao_social")


@query("synth_commitments")
def synth_commitments(spark, sf_dir):
    """A synthetic commitment per line item, drawn from its key, over as many suppliers and agencies as the tables have."""
    sizes = {name: T.table(spark, sf_dir, name).count() for name in ("supplier", "customer")}
    key = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    lines = T.table(spark, sf_dir, "lineitem").select(F.pmod(key, F.lit(1 << 62)).alias("id"))
    return synthetic.commitments(lines, sizes["customer"], sizes["supplier"], seed=42)


@query("synth_patterns")
def synth_patterns(spark, sf_dir):
    """The commitments of the tables with the hub, the isolated trio and the weak link added."""
    return synthetic.inject_patterns(T.raw_collections(spark, sf_dir), seed=42).commitments


@query(
    "normalize_commitments",
    statement(
        """select empenho_id, numero_empenho, descricao, valor_empenhado,
          strftime(data_empenho, '%Y-%m-%dT%H:%M:%S') as data_empenho, fornecedor_id, orgao_id, contrato_id,
          cast(null as varchar) as fonte_origem from commitments""",
        "commitments",
    ),
)
def normalize_commitments(spark, sf_dir):
    table = N.normalize_commitments(T.raw_collections(spark, sf_dir).commitments)
    return table.withColumn("data_empenho", dates.iso_text(F.col("data_empenho"))).drop("data_ingestao", "payload_hash")


@query(
    "normalize_suppliers",
    statement(
        """select fornecedor_id, nome_fornecedor, cast(null as varchar) as documento, uf from suppliers""", "suppliers"
    ),
)
def normalize_suppliers(spark, sf_dir):
    return N.normalize_suppliers(T.raw_collections(spark, sf_dir).suppliers).select(
        "fornecedor_id", "nome_fornecedor", "documento", "uf"
    )


@query("normalize_agencies", statement("select orgao_id, nome_orgao, sigla, uf from agencies", "agencies"))
def normalize_agencies(spark, sf_dir):
    return N.normalize_agencies(T.raw_collections(spark, sf_dir).agencies).select("orgao_id", "nome_orgao", "sigla", "uf")


@query(
    "lineage_columns",
    statement(
        """select fornecedor_id as id, nome_fornecedor as nome, 'tabelas' as fonte_origem,
          '2024-01-01T00:00:00.000000' as data_ingestao, 64 as hash_length from suppliers""",
        "suppliers",
    ),
)
def lineage_columns(spark, sf_dir):
    stamped = N.with_lineage(T.raw_collections(spark, sf_dir), "tabelas", F.lit("2024-01-01T00:00:00.000000"))
    return stamped.suppliers.select("id", "nome", "fonte_origem", "data_ingestao", F.length("payload_hash").alias("hash_length"))


def _print_sql(place: int, table: str, *fields: str) -> str:
    """The part of a fingerprint that one table gives; ``fields`` by name, null ones empty."""
    marked = ", ".join(f"coalesce({f}, chr(30))" if f else "chr(30)" for f in fields)
    return f"""select {place} || ':' || count(*) || ':' || bit_xor(h) || ':' || sum(h::hugeint) as part
        from (select ('0x' || substr(md5(concat_ws(chr(31), {marked})), 1, 15))::bigint as h from {table})"""


@query(
    "batch_fingerprint",
    statement(
        "select sha256(string_agg(part, '|' order by part)) as payload_hash from ("
        + " union all ".join(
            [
                _print_sql(
                    0, "commitments", "contrato_id", "strftime(data_empenho, '%Y-%m-%d')", "descricao", "fornecedor_id",
                    "empenho_id", "numero_empenho", "orgao_id", "valor_empenhado::varchar",
                ),
                _print_sql(1, "suppliers", "", "fornecedor_id", "", "nome_fornecedor", "", "uf"),
                _print_sql(2, "agencies", "orgao_id", "", "nome_orgao", "sigla", "uf"),
            ]
        )
        + ")",
        "commitments", "suppliers", "agencies",
    ),
)
def batch_fingerprint(spark, sf_dir):
    return N.fingerprint(*T.raw_collections(spark, sf_dir))


@query(
    "validate_commitments",
    statement("select id, numero, amount as valor from parsed where id is not null and amount >= 0", "parsed"),
)
def validate_commitments(spark, sf_dir):
    good, _ = Q.split_valid(D.dirty_commitments(spark, sf_dir), Q.commitment_checks())
    return good.select("id", "numero", amounts.parse_amount(F.col("valor_empenhado")).alias("valor"))


@query(
    "rejected_commitments",
    statement(
        """select line, errors from (select line, concat_ws(',', case when id is null then 'missing_id' end,
          case when amount is null then 'bad_amount' end, case when amount < 0 then 'negative_amount' end) as errors
          from parsed) where errors <> ''""",
        "parsed",
    ),
)
def rejected_commitments(spark, sf_dir):
    raw = T.raw_collections(spark, sf_dir)._replace(commitments=D.dirty_commitments(spark, sf_dir))
    bad = load_graph(raw, mode="quarantine").rejected.commitments
    return bad.select("line", F.array_join("errors", ",").alias("errors"))


def _signed(spark, sf_dir):
    """Line items keyed by order and line, which repeats; large discounts count as reversals."""
    sign = F.when(F.col("l_discount") > 0.095, -1.0).otherwise(1.0)
    return T.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_extendedprice") * sign).alias("valor_empenhado")
    )


_SIGNED = """(select l_orderkey, l_linenumber, l_partkey, l_suppkey,
    l_extendedprice * case when l_discount > 0.095 then -1.0 else 1.0 end as valor_empenhado from lineitem)"""


@query("drop_negative", f"select * from {_SIGNED} where valor_empenhado >= 0")
def drop_negative(spark, sf_dir):
    return Q.drop_negative(_signed(spark, sf_dir))


@query(
    "dedup_first",
    f"""select * from {_SIGNED}
    qualify row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, valor_empenhado) = 1""",
)
def dedup_first(spark, sf_dir):
    return Q.dedup_first(
        _signed(spark, sf_dir), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "valor_empenhado"]
    )


@query(
    "quality_report",
    f"""select 'empenhos' as kind, cast(sum(n) as bigint) as row_count, cast(sum(n - 1) as bigint) as duplicates,
      cast(count(*) filter (first_value < 0) as bigint) as negatives
    from (select count(*) over same as n, valor_empenhado as first_value from {_SIGNED}
          window same as (partition by l_orderkey, l_linenumber)
          qualify row_number() over (partition by l_orderkey, l_linenumber
            order by l_partkey, l_suppkey, valor_empenhado) = 1)""",
)
def quality_report(spark, sf_dir):
    return Q.quality_report(
        _signed(spark, sf_dir), "empenhos", ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"], "valor_empenhado"
    )


@query(
    "filter_period",
    statement(
        """select empenho_id, strftime(data_empenho, '%Y-%m-%d') as data, valor_empenhado from commitments
        where data_empenho between timestamp '1996-02-01' and timestamp '1997-01-31'""",
        "commitments",
    ),
)
def filter_period(spark, sf_dir):
    kept = by_period(T.commitments(spark, sf_dir), "1996-02-01", "1997-01-31")
    return kept.select("empenho_id", F.date_format("data_empenho", "yyyy-MM-dd").alias("data"), "valor_empenhado")


_REGISTRY_SQL = """with company as (
    select lpad(cast(p_partkey as varchar), 8, '0') as k, p_name as razao_social, cast(p_retailprice as varchar) as capital_social
    from part
    qualify row_number() over (partition by p_partkey order by p_name) = 1),
  establishment as (
    select lpad(cast(o_custkey as varchar), 8, '0') || '000199' as k, o_orderpriority as nome_fantasia,
      o_orderstatus as cnae_principal, strftime(o_orderdate, '%Y-%m-%d') as data_inicio_atividade
    from orders
    qualify row_number() over (partition by o_custkey order by o_orderpriority, o_orderstatus, o_orderdate) = 1),
  s as (
    select cast(s_suppkey as varchar) as id, case when s_nationkey >= 10 then s_name end as nome,
      case when s_acctbal >= 0 then r || '0001-99' when s_nationkey < 12 then r || '909' end as documento,
      case when s_acctbal >= 0 then r end as root
    from (select *, lpad(cast(s_suppkey * 31 as varchar), 8, '0') as r from supplier))
select id, coalesce(nome, razao_social, nome_fantasia) as nome, documento, razao_social,
  cast(capital_social as double) as capital, nome_fantasia, cnae_principal, data_inicio_atividade
from s left join company c on c.k = root left join establishment e on e.k = root || '000199'"""


@query("enrich_suppliers", _REGISTRY_SQL)
def enrich_suppliers(spark, sf_dir):
    rows = enrich(D.raw_suppliers(spark, sf_dir), *D.registry(spark, sf_dir))
    return rows.withColumn("capital", F.col("capital_social").try_cast("double")).drop("capital_social")


_LOADED = """with kept as (
    select l_orderkey, l_extendedprice as valor from lineitem join orders on l_orderkey = o_orderkey
    qualify row_number() over (partition by l_orderkey, l_linenumber, l_partkey, l_suppkey
      order by l_returnflag || l_linestatus, cast(l_extendedprice as varchar), l_shipdate) = 1),
  total as (select count(*) as n, cast(sum(cast(valor as decimal(18, 2))) as double) as valor from kept)
select 'vertex' as part, 'empenho' as type, n as row_count, valor from total
union all select 'vertex', 'contrato', count(distinct l_orderkey), null from kept
union all select 'vertex', 'fornecedor', count(*), null from supplier
union all select 'vertex', 'orgao', count(*), null from customer
union all select 'edge', t, n, valor from total,
  (values ('orgao_empenho'), ('empenho_fornecedor'), ('empenho_contrato')) as types(t)"""


@query("load_graph", _LOADED)
def load_whole_graph(spark, sf_dir):
    """Payload to graph, every step of the load, summed up by type."""
    graph = load_graph(T.raw_collections(spark, sf_dir), "tabelas", registry=D.registry(spark, sf_dir)).graph
    total = F.sum(F.col("valor").cast("decimal(18,2)")).cast("double").alias("valor")
    return (
        graph.vertices.groupBy(F.lit("vertex").alias("part"), F.col("node_type").alias("type"))
        .agg(F.count("*").alias("row_count"), total)
        .unionByName(
            graph.edges.groupBy(F.lit("edge").alias("part"), F.col("edge_type").alias("type")).agg(
                F.count("*").alias("row_count"), total
            )
        )
    )


@query(
    "load_counters",
    statement(
        """select 'empenhos' as kind, cast(count(*) as bigint) as row_count, count(*) - count(distinct numero) as duplicates,
          0::bigint as negatives from parsed where id is not null and amount >= 0
        union all select 'fornecedores', count(*), 0, 0 from supplier
        union all select 'orgaos', count(*), 0, 0 from customer""",
        "parsed",
    ),
)
def load_counters(spark, sf_dir):
    """The counters of a load whose commitment ids repeat."""
    dirty = D.dirty_commitments(spark, sf_dir)
    dirty = dirty.withColumn("id", F.when(F.col("id").isNotNull(), F.col("numero")))
    return load_graph(T.raw_collections(spark, sf_dir)._replace(commitments=dirty), mode="quarantine").counters


@query("parse_amount", statement("select line, amount from parsed", "parsed"))
def parse_amount(spark, sf_dir):
    return D.dirty_commitments(spark, sf_dir).select("line", amounts.parse_amount(F.col("valor_empenhado")).alias("amount"))


@query(
    "parse_dates",
    """select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as line,
      case l_returnflag when 'R' then null else strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') end as data from lineitem""",
)
def parse_dates(spark, sf_dir):
    shipped = F.col("l_shipdate").cast("string")
    raw = (
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("não informada "), F.substring(shipped, 1, 4)))
        .when(F.col("l_returnflag") == "A", F.substring(shipped, 1, 10))
        .otherwise(shipped)
    )
    lines = T.table(spark, sf_dir, "lineitem")
    line = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return lines.select(line.alias("line"), dates.iso_text(dates.parse_timestamp(raw)).alias("data"))


@query(
    "month_date",
    """select o_orderkey, case when o_orderpriority <> '5-LOW' then strftime(o_orderdate, '%Y-%m') || '-01' end as month_start
    from orders""",
)
def month_date(spark, sf_dir):
    month = F.when(F.col("o_orderpriority") == "5-LOW", "13").otherwise(F.month("o_orderdate").cast("string"))
    start = dates.month_start(F.year("o_orderdate"), month)
    return T.table(spark, sf_dir, "orders").select("o_orderkey", start.cast("string").alias("month_start"))


@query(
    "finite_values",
    """select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as line,
      case when l_linenumber in (1, 2, 3) then null else l_extendedprice end as valor from lineitem""",
)
def finite_values(spark, sf_dir):
    n = F.col("l_linenumber")
    value = (
        F.when(n == 1, F.lit(float("nan"))).when(n == 2, F.lit(float("inf"))).when(n == 3, F.lit(float("-inf")))
        .otherwise(F.col("l_extendedprice"))
    )
    line = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return T.table(spark, sf_dir, "lineitem").select(line.alias("line"), amounts.finite(value).alias("valor"))


@query(
    "node_label",
    """select c_custkey, coalesce(case when c_nationkey > 12 then c_name end,
      case when c_nationkey > 6 then c_mktsegment end, case when c_nationkey > 3 then 'n' || c_custkey end,
      case when c_nationkey > 1 then cast(c_custkey as varchar) end, 'orgao::' || c_custkey) as label from customer""",
)
def node_label(spark, sf_dir):
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey")
    label = text.label(
        F.when(nation > 12, F.col("c_name")).otherwise(F.lit("")),
        F.when(nation > 6, F.col("c_mktsegment")),
        F.when(nation > 3, F.concat(F.lit("n"), key)).otherwise(F.lit("")),
        F.when(nation > 1, key),
        text.node_id("orgao", key),
    )
    return T.table(spark, sf_dir, "customer").select("c_custkey", label.alias("label"))


@query(
    "slugify",
    """select c_custkey, trim(regexp_replace(lower(strip_accents('  Órgão ' || c_name || ' / Seção: ' || c_mktsegment || '!')),
      '[^a-z0-9]+', '-', 'g'), '-') || case when c_nationkey > 12 then '-acme-a' else '' end as slug from customer""",
)
def slugify(spark, sf_dir):
    name = F.concat(F.lit("  Órgão "), "c_name", F.lit(" / Seção: "), "c_mktsegment", F.lit("!"))
    # Letters of the supplementary planes: a mathematical A and a boxed one.
    name = F.concat(name, F.when(F.col("c_nationkey") > 12, " \U0001d400cme \U0001f130").otherwise(""))
    return T.table(spark, sf_dir, "customer").select("c_custkey", text.slugify(name).alias("slug"))


@query(
    "stable_id",
    "select c_custkey, "
    + D.stable_id_sql("orgao", "'Secretaria de Inovação', case when c_nationkey > 5 then c_mktsegment end, c_name")
    + " as id from customer",
)
def stable_id(spark, sf_dir):
    segment = F.when(F.col("c_nationkey") > 5, F.col("c_mktsegment")).otherwise(F.lit(""))
    id_ = text.stable_id("orgao", F.lit("Secretaria de Inovação"), segment, F.col("c_name"))
    return T.table(spark, sf_dir, "customer").select("c_custkey", id_.alias("id"))


@query(
    "mask_document",
    statement(
        """select o_orderkey, case when documento is null or documento = '' then documento
          when length(d) = 11 then '***.' || substr(d, 4, 3) || '.***-' || right(d, 2)
          when length(d) = 14 then '**.' || substr(d, 3, 3) || '.***/*' || substr(d, 9, 4) || '-' || right(d, 2)
          when length(d) >= 4 then repeat('*', length(d) - 4) || right(d, 4) else '***' end as masked
        from (select *, regexp_replace(documento, '[^0-9]', '', 'g') as d from documents_of)""",
        "documents_of",
    ),
)
def mask_document(spark, sf_dir):
    return D.documents(spark, sf_dir).select("o_orderkey", text.mask_document(F.col("documento")).alias("masked"))


@query(
    "json_props",
    """select event_id, cast(json_extract_string(props, '$.k') as bigint) as k,
      '{"event_id":' || event_id || ',"k":' || json_extract_string(props, '$.k') || ',"kind":"' || event_type || '"}' as document
    from events""",
)
def json_props(spark, sf_dir):
    parsed = T.table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k bigint")["k"])
    return parsed.select("event_id", "k", F.to_json(F.struct("event_id", "k", F.col("event_type").alias("kind"))).alias("document"))
