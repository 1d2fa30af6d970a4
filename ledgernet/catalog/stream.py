"""Queries that run a stream over landed files of the events until all are read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgernet.catalog.registered import query
from ledgernet.operators.graph_build import dangling_edges
from ledgernet.sources.tables import table
from ledgernet.sources.workspace import scratch_path
from ledgernet.streaming import ingest as I

_LANDED = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, copy int"


def _run(spark, sf_dir, start):
    """Land all events, run the stream, land them a second time, and run it on.

    ``start`` begins a stream over the landed records.
    """
    path = scratch_path(spark, "landed")
    events = table(spark, sf_dir, "events").drop("props")
    # The text carries the zone, so every session reads the same instants.
    stamped = events.withColumn("ts", F.concat(F.translate(F.col("ts").cast("string"), " ", "T"), F.lit("Z")))
    for copy in (1, 2):
        stamped.withColumn("copy", F.lit(copy)).write.mode("append").json(path)
        start(I.read_landed(spark, path, _LANDED)).awaitTermination()


@query(
    "stream_ingest",
    """select 'edge' as part, 'empenho_fornecedor' as type, count(*) as row_count, round(sum(value), 2) as valor from events
    union all select 'edge', 'orgao_empenho', count(*), round(sum(value), 2) from events
    union all select 'vertex', 'empenho', count(*), round(sum(value), 2) from events
    union all select 'vertex', 'fornecedor', count(distinct user_id), null from events
    union all select 'vertex', 'orgao', count(distinct event_type), null from events
    union all select 'dangling', 'all', 0, null
    union all select 'repeated', 'all', count(*), null from events""",
)
def stream_ingest(spark, sf_dir):
    """Events as commitments: the user is paid, the event type commits; copies are dropped and listed."""
    out, state = scratch_path(spark, "ingested"), scratch_path(spark, "ingest-checkpoint")

    def start(events):
        records = events.select(
            F.col("event_id").cast("string").alias("id"),
            F.lit(None).cast("string").alias("numero"),
            F.lit(None).cast("string").alias("descricao"),
            F.col("value").cast("string").alias("valor_empenhado"),
            F.col("ts").cast("string").alias("data_empenho"),
            F.col("user_id").cast("string").alias("fornecedor_id"),
            F.col("event_type").alias("unidade_gestora_id"),
            F.lit(None).cast("string").alias("contrato_id"),
            F.col("ts").alias("arrived"),
        )
        return I.ingest_commitments(records, out, state)

    _run(spark, sf_dir, start)
    graph = I.ingested_graph(spark, out)

    def counted(table, part, kind):
        return table.groupBy(F.lit(part).alias("part"), F.col(kind).alias("type")).agg(
            F.count("*").alias("row_count"), F.round(F.sum("valor"), 2).alias("valor")
        )

    loose = dangling_edges(graph).agg(
        F.lit("dangling").alias("part"), F.lit("all").alias("type"), F.count("*").alias("row_count"), F.lit(None).cast("double").alias("valor")
    )
    again = spark.read.parquet(f"{out}/repeated").agg(
        F.lit("repeated").alias("part"), F.lit("all").alias("type"), F.count("*").alias("row_count"), F.lit(None).cast("double").alias("valor")
    )
    tables = counted(graph.edges, "edge", "edge_type").unionByName(counted(graph.vertices, "vertex", "node_type"))
    return tables.unionByName(loose).unionByName(again)


@query(
    "daily_counts",
    "select strftime(ts, '%Y-%m-%d') as day, event_type, 2 * count(*) as n from events group by 1, 2",
)
def daily_counts(spark, sf_dir):
    out, state = scratch_path(spark, "daily"), scratch_path(spark, "daily-checkpoint")
    _run(spark, sf_dir, lambda events: I.count_daily(events, "ts", "event_type", out, state, delay="60 days"))
    # Windows are cut at midnight UTC.
    day = F.date_format(F.to_utc_timestamp("day", F.current_timezone()), "yyyy-MM-dd")
    return I.latest(spark, out, ["day", "event_type"], "n").withColumn("day", day)


@query(
    "stream_degree",
    """select node_id, round(sum(value), 2) as centrality from (
      select 'fornecedor::' || user_id as node_id, 2 * value as value from events
      union all select 'orgao::' || event_type, 2 * value from events) group by 1""",
)
def stream_degree(spark, sf_dir):
    """Running weighted degree of both ends; the copies count here."""
    ends = F.array(F.concat(F.lit("fornecedor::"), "user_id"), F.concat(F.lit("orgao::"), "event_type"))
    out, state = scratch_path(spark, "degree"), scratch_path(spark, "degree-checkpoint")

    def start(events):
        weights = events.select(F.explode(ends).alias("node_id"), F.col("value").alias("weight"))
        return I.accumulate_degree(weights, out, state)

    _run(spark, sf_dir, start)
    I.compact(spark, out, ["node_id"], "centrality")
    current = I.latest(spark, out, ["node_id"], "centrality")
    return current.select("node_id", F.round(F.col("centrality").cast("double"), 2).alias("centrality"))
