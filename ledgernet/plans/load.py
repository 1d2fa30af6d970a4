"""Raw payload collections to a graph: validate, clean, stamp, enrich, normalise, build."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgernet.functions.amounts import parse_amount
from ledgernet.functions.dates import parse_timestamp
from ledgernet.graph import SpendGraph
from ledgernet.operators.enrichment import enrich_suppliers
from ledgernet.operators.graph_build import build_graph
from ledgernet.operators.normalize import Collections, fingerprint, normalize, with_lineage
from ledgernet.operators.quality import (
    commitment_checks,
    dimension_checks,
    judge,
    repeated_keys,
    without_repeats,
)
from ledgernet.sources.workspace import concurrently, stored


class Loaded(NamedTuple):
    """What a load gives: the graph, its normalised tables, rejected rows and counters.

    ``rejected`` holds the raw rows that broke a rule, with their ``errors``; ``counters`` has
    per collection how many valid rows came, how many of them repeat an id, and how many
    kept ones have a negative amount.
    """

    graph: SpendGraph
    tables: Collections
    rejected: Collections
    counters: DataFrame


class Judged(NamedTuple):
    """The raw collections after one pass over them: rows kept, rows rejected with their ``errors``, counters.

    ``amount`` and ``date`` name the columns of kept commitments that hold them parsed.
    """

    kept: Collections
    rejected: Collections
    counters: DataFrame
    amount: str
    date: str


_KINDS = ("empenhos", "fornecedores", "orgaos")


def _order(table: DataFrame) -> list[str]:
    """A total order of the rows of one id: by ``position`` where the source gives one, then by content."""
    rest = [c for c in table.columns if c not in ("id", "position")]
    return (["position"] if "position" in table.columns else []) + rest


def judge_payload(raw: Collections, mode: str = "strict") -> Judged:
    """Validate, parse and de-duplicate each collection, which is read once.

    Each collection is written as it comes, tagged with a verdict, to a table in the shared
    folder: no shuffle. Ids that repeat are counted there; only their rows are sorted, and
    without any the table holds the kept rows already. Rejects and counters come from these
    tables, so that a task that ran twice does not change them. ``strict`` fails here at a
    bad row.
    """
    amount, date = (_free(raw.commitments, n) for n in ("_amount", "_date"))
    dated = "data_empenho" in raw.commitments.columns
    parsed = {
        amount: parse_amount(F.col("valor_empenhado")),
        date: parse_timestamp(F.col("data_empenho")) if dated else F.lit(None).cast("timestamp_ntz"),
    }
    checks = (commitment_checks(F.col(amount)), dimension_checks(), dimension_checks())

    def sort_out(table: DataFrame, check, kind: str, more: dict[str, Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
        verdict = F.when(F.size("errors") > 0, "rejected").otherwise("kept")
        tagged = stored(judge(table, check, kind, mode, more).withColumn("verdict", verdict), kind, "verdict")
        valid = tagged.where("verdict = 'kept'").drop("errors", "verdict")
        repeated = stored(repeated_keys(valid, ["id"]), "repeated")
        kept = valid
        if not repeated.isEmpty():
            kept = stored(without_repeats(valid, repeated, ["id"], _order(table)), "kept")
        copies = F.coalesce(repeated.agg(F.sum(F.col("copies") - 1)).scalar(), F.lit(0))
        negative = F.count_if(F.col(amount) < 0) if more else F.lit(0).cast("long")
        report = kept.agg(F.count("*").alias("n"), negative.alias("negatives")).select(
            F.lit(kind).alias("kind"), (F.col("n") + copies).alias("row_count"), copies.alias("duplicates"), "negatives"
        )
        rejected = tagged.where("verdict = 'rejected'").select(*table.columns, "errors")
        return kept.drop("position"), rejected, report

    steps = zip(raw, checks, _KINDS, (parsed, {}, {}))
    kept, rejected, reports = zip(*concurrently(*[lambda step=step: sort_out(*step) for step in steps]))
    return Judged(Collections(*kept), Collections(*rejected), reduce(DataFrame.unionByName, reports), amount, date)


def _free(table: DataFrame, name: str) -> str:
    while name in table.columns:
        name += "_"
    return name


def clean(raw: Collections, mode: str = "strict") -> Collections:
    """Valid rows, one per id; none has a negative amount."""
    done = judge_payload(raw, mode)
    return done.kept._replace(commitments=done.kept.commitments.drop(done.amount, done.date))


def load_graph(
    raw: Collections,
    source_label: str = "manual",
    mode: str = "strict",
    registry: tuple[DataFrame, DataFrame] | None = None,
    include_contracts: bool = True,
    ingested_at: Column | None = None,
) -> Loaded:
    """The graph of a payload, its normalised tables, and what was left out.

    ``registry`` is the company and the establishment table; without it suppliers stay
    as they are. Each raw collection is read once (see ``judge_payload``); everything else
    reads what that pass has written, and in ``strict`` mode the load fails there.
    """
    done = judge_payload(raw, mode)
    plain = done.kept._replace(commitments=done.kept.commitments.drop(done.amount, done.date))
    stamped = with_lineage(done.kept, source_label, ingested_at, batch=fingerprint(*plain))
    if registry is not None:
        stamped = stamped._replace(suppliers=enrich_suppliers(stamped.suppliers, *registry))
    parsed = stamped.commitments.withColumns({"valor_empenhado": F.col(done.amount), "data_empenho": F.col(done.date)})
    tables = normalize(stamped._replace(commitments=parsed))
    graph = build_graph(*tables, include_contracts=include_contracts, unique_commitments=True)
    return Loaded(graph, tables, done.rejected, done.counters)
