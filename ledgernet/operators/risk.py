"""Risk per node from the anomalies that name it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgernet.functions.severity import (
    known_severity,
    severity_of_rank,
    severity_rank,
    signal_strength,
)


def anomaly_members(anomalies: DataFrame, *evidence: DataFrame) -> DataFrame:
    """Distinct ``(anomaly_id, node_id)``: the centre and every node of the evidence tables."""
    named = anomalies.where("node_id is not null").select("anomaly_id", "node_id")
    for table in evidence:
        named = named.unionByName(table.select("anomaly_id", "node_id"))
    return named.distinct()


def node_risk(anomalies: DataFrame, members: DataFrame) -> DataFrame:
    """``(node_id, score, signals)``: mean strength of the anomalies naming a node, and how many."""
    strength = signal_strength(F.col("score"), F.col("severity"), F.col("detector"))
    signals = anomalies.select("anomaly_id", strength.alias("strength")).join(members, "anomaly_id")
    return signals.groupBy("node_id").agg(F.avg("strength").alias("score"), F.count("*").alias("signals"))


def node_signals(anomalies: DataFrame, members: DataFrame) -> DataFrame:
    """One row per node and anomaly naming it: the details behind a node's severity."""
    facts = anomalies.select(
        "anomaly_id",
        "detector",
        F.coalesce(F.col("reason"), F.col("detector")).alias("reason"),
        known_severity(F.col("severity")).alias("severity"),
        "score",
    )
    return members.join(facts, "anomaly_id")


def node_severity(signals: DataFrame) -> DataFrame:
    """``(node_id, severity, signals)``: the worst severity of a node and its signal count."""
    return signals.groupBy("node_id").agg(
        severity_of_rank(F.max(severity_rank(F.col("severity")))).alias("severity"), F.count("*").alias("signals")
    )


def count_by_severity(anomalies: DataFrame) -> DataFrame:
    """Anomalies per severity, and the total on the row ``total``."""
    severity = F.lower(F.coalesce(F.col("severity"), F.lit("media")))
    return (
        anomalies.select(severity.alias("severity"))
        .rollup("severity")
        .agg(F.count("*").alias("anomalies"))
        .select(F.coalesce("severity", F.lit("total")).alias("severity"), "anomalies")
    )


def count_by_detector(anomalies: DataFrame) -> DataFrame:
    """Anomalies per detector and severity."""
    severity = F.lower(F.coalesce(F.col("severity"), F.lit("media")))
    return anomalies.groupBy("detector", severity.alias("severity")).agg(F.count("*").alias("anomalies"))
