"""Inputs that the tables lack, derived from whole tables: raw texts, documents, pages.

Each has its twin among the SQL subqueries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgernet.catalog.sql import subquery
from ledgernet.sources.tables import raw_collections, table


def _brazilian(value: Column) -> Column:
    return F.translate(F.format_number(value, 2), ",.", ".,")


def dirty_commitments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw commitments with missing ids and amounts in every style, some of them bad."""
    price = F.col("l_extendedprice")
    amount = (
        F.when((F.col("l_tax") > 0.075) & (F.col("l_quantity") < 10), F.lit("n/d"))
        .when(F.col("l_discount") > 0.095, F.concat(F.lit("-"), price.cast("string")))
        .when(F.col("l_returnflag") == "R", _brazilian(price))
        .when(F.col("l_quantity") > 48, F.lit(" "))
        .when(F.col("l_returnflag") == "A", F.replace(price.cast("string"), F.lit("."), F.lit(",")))
        .otherwise(price.cast("string"))
    )
    id_ = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        F.when((F.col("l_linenumber") < 7) | (F.col("l_quantity") <= 45), id_).alias("id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("numero"),
        amount.alias("valor_empenhado"),
        id_.alias("line"),
    )


subquery(
    "dirty",
    """select case when l_linenumber < 7 or l_quantity <= 45 then line end as id, numero, line,
         case when l_tax > 0.075 and l_quantity < 10 then 'n/d'
              when l_discount > 0.095 then '-' || price
              when l_returnflag = 'R' then translate(format('{:,.2f}', l_extendedprice), ',.', '.,')
              when l_quantity > 48 then ' '
              when l_returnflag = 'A' then replace(price, '.', ',')
              else price end as valor_empenhado
       from (select *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as line,
               concat_ws('-', l_orderkey, l_linenumber) as numero, cast(l_extendedprice as varchar) as price
             from lineitem)""",
)
subquery(
    "parsed",
    """select *, case when t = '' then 0.0
         when contains(t, ',') and contains(t, '.') then try_cast(replace(replace(t, '.', ''), ',', '.') as double)
         else try_cast(replace(t, ',', '.') as double) end as amount
       from (select *, trim(valor_empenhado) as t from dirty)""",
    "dirty",
)


def state_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat state records of all commitments; ``position`` is the line key."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        customers, F.col("o_custkey") == F.col("c_custkey")
    )
    price = F.col("l_extendedprice").cast("string")
    final = F.col("l_linestatus") == "F"
    return joined.select(
        F.concat(F.lit(" Órgão "), "c_name").alias("Unidade"),
        F.year("l_shipdate").cast("string").alias("Ano"),
        F.month("l_shipdate").cast("string").alias("Mes"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("NumeroEmpenho"),
        F.when(F.col("l_returnflag") == "N", F.lit("JURÍDICA")).alias("TipoPessoa"),
        F.lpad(F.col("l_suppkey").cast("string"), 14, "0").alias("CPFCNPJ"),
        F.when(final, F.col("o_orderpriority")).alias("Funcao"),
        F.when(~final, F.when(F.col("l_quantity") == 13, "n/d").when(F.col("l_quantity") == 14, " ").otherwise(price)).alias("Empenho"),
        price.alias("Empenhado"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("position"),
    )


subquery(
    "state",
    """select ' Órgão ' || c_name as unidade, cast(year(l_shipdate) as varchar) as ano,
         cast(month(l_shipdate) as varchar) as mes,
         concat_ws('-', l_orderkey, l_linenumber, l_partkey) as numero,
         case when l_returnflag = 'N' then 'JURÍDICA' end as tipo, lpad(cast(l_suppkey as varchar), 14, '0') as doc,
         case when l_linestatus = 'F' then o_orderpriority end as funcao, l_extendedprice as valor,
         case when l_linestatus = 'F' then l_extendedprice when l_quantity = 13 then null when l_quantity = 14 then 0.0
           else l_extendedprice end as empenho,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate
       from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey""",
)


def stable_id_sql(prefix: str, parts: str) -> str:
    """The id expression over a list of parts that are not blank."""
    key = f"concat_ws('::', {parts})"
    slug = f"trim(regexp_replace(lower(strip_accents({key})), '[^a-z0-9]+', '-', 'g'), '-')"
    return f"'{prefix}-' || {slug} || '-' || substr(sha1({key}), 1, 10)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document text per order: company numbers, person numbers, short ones, blanks."""
    key = F.col("o_orderkey").cast("string")
    long = F.lpad(key, 14, "7")
    company = F.concat(
        F.substring(long, 1, 2), F.lit("."), F.substring(long, 3, 3), F.lit("."), F.substring(long, 6, 3),
        F.lit("/"), F.substring(long, 9, 4), F.lit("-"), F.substring(long, 13, 2),
    )
    person = F.lpad(key, 11, "3")
    priority = F.col("o_orderpriority")
    text = (
        F.when(priority == "1-URGENT", company)
        .when(priority == "2-HIGH", person)
        .when(priority == "3-MEDIUM", F.concat(F.lit("nº "), key))
        .when(priority == "4-NOT SPECIFIED", F.lit(""))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("documento"))


subquery(
    "documents_of",
    """select o_orderkey, case o_orderpriority
         when '1-URGENT' then substr(l, 1, 2) || '.' || substr(l, 3, 3) || '.' || substr(l, 6, 3) || '/'
           || substr(l, 9, 4) || '-' || substr(l, 13, 2)
         when '2-HIGH' then lpad(k, 11, '3') when '3-MEDIUM' then 'nº ' || k when '4-NOT SPECIFIED' then '' end
         as documento
       from (select *, cast(o_orderkey as varchar) as k, lpad(cast(o_orderkey as varchar), 14, '7') as l from orders)""",
)


def raw_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw suppliers: companies the registry knows or not, persons, some without a name or a document.

    A person's number begins like a company root.
    """
    root = F.lpad((F.col("s_suppkey") * 31).cast("string"), 8, "0")
    number = F.when(F.col("s_acctbal") >= 0, F.concat(root, F.lit("0001-99"))).when(
        F.col("s_nationkey") < 12, F.concat(root, F.lit("909"))
    )
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("id"),
        F.when(F.col("s_nationkey") >= 10, F.col("s_name")).alias("nome"),
        number.alias("documento"),
    )


def registry(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Companies by 8-digit root, and several establishments per full number."""
    companies = table(spark, sf_dir, "part").select(
        F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("cnpj"),
        F.col("p_name").alias("razao_social"),
        F.col("p_retailprice").cast("string").alias("capital_social"),
    )
    establishments = table(spark, sf_dir, "orders").select(
        F.concat(F.lpad(F.col("o_custkey").cast("string"), 8, "0"), F.lit("000199")).alias("cnpj"),
        F.col("o_orderpriority").alias("nome_fantasia"),
        F.col("o_orderstatus").alias("cnae_principal"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("data_inicio_atividade"),
    )
    return companies, establishments


def payload_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload documents of one record each, so that none grows with the data."""
    raw = raw_collections(spark, sf_dir)._asdict()
    names = {"commitments": "empenhos", "suppliers": "fornecedores", "agencies": "orgaos"}
    one = [raw[k].select(F.array(F.struct(*raw[k].columns)).alias(name)) for k, name in names.items()]
    return one[0].unionByName(one[1], allowMissingColumns=True).unionByName(one[2], allowMissingColumns=True)


def order_pages(spark: SparkSession, sf_dir: str, data_key: str, page_size: int, last: list[str]) -> DataFrame:
    """Envelopes of all orders by key, then the page that ends the scan, then a stray page.

    ``last`` are the ids on the ending page.
    """
    orders = table(spark, sf_dir, "orders")
    record = F.struct(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_orderpriority").alias("descricao"),
        F.col("o_totalprice").cast("string").alias("valor_empenhado"),
    )
    page = F.floor(F.col("o_orderkey") / page_size) + 1
    full = orders.groupBy(page.alias("page")).agg(F.sort_array(F.collect_list(record)).alias(data_key))
    kind = "array<struct<id:string,descricao:string,valor_empenhado:string>>"

    def page_of(ids: list[str], offset: int) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(i).alias("id"), F.lit("fim").alias("descricao"), F.lit("0").alias("valor_empenhado")) for i in ids])
        return orders.agg((F.floor(F.max("o_orderkey") / page_size) + 1 + offset).alias("page")).select(
            "page", rows.cast(kind).alias(data_key)
        )

    return full.unionByName(page_of(last, 1)).unionByName(page_of(["stray"], 2))
