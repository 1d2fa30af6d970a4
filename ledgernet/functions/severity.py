"""Scores, severities and their weights."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgernet import vocabulary as V


def robust_z(value: Column, median: Column, mad: Column) -> Column:
    return F.lit(V.Z_SCALE) * (value - median) / mad


def floored(deviation: Column) -> Column:
    """A spread that can divide: the floor stands in for zero."""
    return F.when(deviation == 0, F.lit(V.MAD_FLOOR)).otherwise(deviation)


def severity_from_z(z: Column) -> Column:
    return F.when(z >= V.Z_ALTA, "alta").when(z >= V.Z_MEDIA, "media").otherwise("baixa")


def severity_from_isolation(score: Column) -> Column:
    return (
        F.when(score >= V.ISOLATION_ALTA, "alta")
        .when(score >= V.ISOLATION_MEDIA, "media")
        .otherwise("baixa")
    )


def _lookup(column: Column, table: dict, default) -> Column:
    out = F
    for key, value in table.items():
        out = out.when(column == key, F.lit(value))
    return out.otherwise(F.lit(default))


def known_severity(severity: Column) -> Column:
    """The severity, or the default for null and unknown words."""
    return F.when(severity.isin(*V.SEVERITY_RANKS), severity).otherwise(F.lit(V.DEFAULT_SEVERITY))


def severity_rank(severity: Column) -> Column:
    return _lookup(known_severity(severity), V.SEVERITY_RANKS, V.SEVERITY_RANKS[V.DEFAULT_SEVERITY])


def severity_of_rank(rank: Column) -> Column:
    return _lookup(rank, {r: s for s, r in V.SEVERITY_RANKS.items()}, V.DEFAULT_SEVERITY)


def severity_weight(severity: Column) -> Column:
    word = F.lower(F.coalesce(severity, F.lit(V.DEFAULT_SEVERITY)))
    return _lookup(word, V.SEVERITY_WEIGHTS, V.DEFAULT_SEVERITY_WEIGHT)


def detector_weight(detector: Column) -> Column:
    return _lookup(detector, V.DETECTOR_WEIGHTS, V.DEFAULT_DETECTOR_WEIGHT)


def signal_strength(score: Column, severity: Column, detector: Column) -> Column:
    """What one anomaly adds to the risk of a node; a missing score counts as 1."""
    base = F.greatest(F.lit(0.0), F.coalesce(score.try_cast("double"), F.lit(1.0)))
    return base * severity_weight(severity) * detector_weight(detector)
