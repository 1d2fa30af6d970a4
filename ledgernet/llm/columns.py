"""Helpers for frames whose columns are not known in advance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores behind until no column has that name."""
    taken = {name.lower() for name in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def field(df: DataFrame, name: str) -> Column:
    """The column of that exact name, dots and blanks included."""
    return df["`" + name.replace("`", "``") + "`"]


def crc_remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; -1 for null, which no split holds out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus, F.lit(-1))
