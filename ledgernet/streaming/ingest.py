"""Incremental forms: landed records to graph tables, counts over time, running degree.

Every sink writes a folder per micro-batch and replaces it on a retry, so a batch that
runs twice leaves its rows once. State is kept by key; on a cluster choose the RocksDB
state store in the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgernet import vocabulary as V
from ledgernet.functions.amounts import money
from ledgernet.functions.text import join_id
from ledgernet.graph import SpendGraph
from ledgernet.operators.graph_build import build_edges, build_vertices, commitment_vertices
from ledgernet.operators.membership import BITS
from ledgernet.operators.normalize import normalize_commitments
from ledgernet.operators.quality import commitment_checks, dedup_first, split_valid
from ledgernet.schema import COMMITMENTS
from ledgernet.sources.workspace import delete_path
from ledgernet.streaming.history import History


def read_landed(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", files_per_batch: int | None = None) -> DataFrame:
    """A stream over the files of a landing folder."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def _write_batch(table: DataFrame, path: str, batch: int) -> None:
    table.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def ingest_commitments(
    records: DataFrame, out: str, checkpoint: str, arrived: str = "arrived", bits: int = BITS
) -> StreamingQuery:
    """Grow the commitment, vertex and edge tables under ``out`` with what has landed.

    An id counts once over the whole load, however late it comes again: of a batch its
    first record by ``arrived`` (then by content) is taken, and ids that earlier batches
    hold are dropped and listed in ``repeated``. No state is kept but bitmaps of id hashes
    (see ``History``). Rejected records go to their own table. Runs until all landed files
    are read; a batch that runs twice leaves its rows once.
    """
    good, _ = split_valid(records, commitment_checks())
    spark = records.sparkSession
    history = History(spark, out, bits)

    def rebuild(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in ("id", arrived)]
        once = dedup_first(batch, ["id"], [arrived, *rest])
        again = None
        if history.before(number) is not None:
            known = spark.read.parquet(f"{out}/commitments").where(F.col("batch") < number)
            again = history.seen_again(once, "id", number, known.select(F.col("empenho_id").alias("id")))
        if again is not None:
            _write_batch(again, f"{out}/repeated", number)
            again = spark.read.parquet(f"{out}/repeated/batch={number}")
            once = once.join(again, "id", "left_anti")
        _write_batch(normalize_commitments(once), f"{out}/commitments", number)
        commitments = spark.read.schema(COMMITMENTS).parquet(f"{out}/commitments/batch={number}")
        _write_batch(commitment_vertices(commitments), f"{out}/vertices", number)
        _write_batch(_named(commitments), f"{out}/named", number)
        _write_batch(build_edges(commitments, include_contracts=True), f"{out}/edges", number)
        history.add(commitments, "empenho_id", number)

    return good.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_ENDS = {V.FORNECEDOR: "fornecedor_id", V.ORGAO: "orgao_id", V.CONTRATO: "contrato_id"}


def _named(commitments: DataFrame) -> DataFrame:
    """``(node_type, original_id)`` of the suppliers, agencies and contracts that a batch names."""
    ends = [F.struct(F.lit(t).alias("node_type"), F.col(c).alias("original_id")) for t, c in _ENDS.items()]
    return commitments.select(F.inline(F.array(*ends))).where("original_id is not null").distinct()


def ingested_graph(
    spark: SparkSession, out: str, suppliers: DataFrame | None = None, agencies: DataFrame | None = None
) -> SpendGraph:
    """The whole graph of what ``ingest_commitments`` has written so far.

    Suppliers and agencies get the attributes of the normalised tables, if given, and
    stand with their id alone where a commitment names one that the tables lack.
    """
    commitments = spark.read.parquet(f"{out}/commitments").drop("batch")
    known = build_vertices(commitments, suppliers, agencies)
    named = spark.read.parquet(f"{out}/named").select("node_type", "original_id").distinct()
    bare = named.withColumn("id", join_id(F.col("node_type"), F.col("original_id"))).join(known.select("id"), "id", "left_anti")
    edges = spark.read.parquet(f"{out}/edges").drop("batch")
    return SpendGraph(
        known.unionByName(bare, allowMissingColumns=True), edges, end_types=V.END_TYPES, commitments=commitments
    )


def quarantine_rejected(records: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append the rejected records with the rules they broke."""
    rejected = split_valid(records, commitment_checks())[1]
    return (
        rejected.writeStream.format("parquet")
        .options(path=f"{out}/rejected", checkpointLocation=checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def count_daily(events: DataFrame, time: str, kind: str, out: str, checkpoint: str, delay: str = "2 days") -> StreamingQuery:
    """Running counts per day and kind; each batch writes the counts it changed."""
    counts = events.withWatermark(time, delay).groupBy(F.window(time, "1 day"), kind).agg(F.count("*").alias("n"))
    flat = counts.select(F.col("window.start").alias("day"), kind, "n")
    return _upsert(flat, out, checkpoint)


def accumulate_degree(weights: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Running weighted degree of ``weights(node_id, weight)``; each batch writes changed nodes."""
    degree = weights.groupBy("node_id").agg(F.sum(money(F.col("weight"))).alias("centrality"))
    return _upsert(degree, out, checkpoint)


def _upsert(changes: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return (
        changes.writeStream.outputMode("update")
        .foreachBatch(lambda batch, number: _write_batch(batch, out, number))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest(spark: SparkSession, out: str, keys: list[str], value: str) -> DataFrame:
    """The current value of every key of an upserted table: that of its newest batch."""
    changes = spark.read.parquet(out)
    return changes.groupBy(*keys).agg(F.max_by(value, "batch").alias(value))


def compact(spark: SparkSession, out: str, keys: list[str], value: str) -> None:
    """Replace the batches of an upserted table by one with the current values.

    Run it while the stream is stopped. The new batch gets a number below all others, so
    that the old ones, while they are still there, overrule it with what it holds as well;
    they go oldest first. A compaction that is cut short leaves the right values.
    """
    numbers = sorted(r["batch"] for r in spark.read.parquet(out).select("batch").distinct().collect())
    merged = min(numbers[0], 0) - 1
    _write_batch(latest(spark, out, keys, value), out, merged)
    # Former compactions, below zero, are older than any batch, the larger the older.
    for number in [*reversed([n for n in numbers if n < 0]), *[n for n in numbers if n >= 0]]:
        delete_path(spark, f"{out}/batch={number}")
