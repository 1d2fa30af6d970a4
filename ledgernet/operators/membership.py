"""Membership in a large set of keys: bitmaps of hashes that rule most others out.

A key whose bit is not set is not in the set; one whose bit is set may be, which an exact
join has to settle. The bitmaps have a fixed greatest size, whatever the number of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of all bitmaps together, as a power of two: 128 MB at most. A key needs some ten bits.
BITS = 30
#: The same for bitmaps that are broadcast: 16 MB at most.
BROADCAST_BITS = 27


def _place(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << bits))


def marks(ids: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """``(bucket, bitmap)``: a bit for the hash of every id, 32,768 bits to a bucket."""
    place = _place(F.col(key), bits)
    return ids.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap")
    )


def merged(*tables: DataFrame) -> DataFrame:
    """The bits that any of the tables has."""
    union = tables[0]
    for table in tables[1:]:
        union = union.unionByName(table)
    return union.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def suspects(ids: DataFrame, key: str, seen: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows whose bit is set: all ids that are in ``seen``, and few others while bits are free.

    Null keys have no place and are left out. A broadcast ``seen`` filters a scan in place.
    """
    place = _place(F.col(key), bits)
    named = ids.withColumns({"_bucket": F.bitmap_bucket_number(place), "_at": F.bitmap_bit_position(place).cast("int")})
    joined = named.join(seen.withColumnRenamed("bucket", "_bucket"), "_bucket")
    byte = F.conv(F.hex(F.expr("substring(bitmap, _at div 8 + 1, 1)")), 16, 10).cast("int")
    hit = joined.where(byte.bitwiseAND(F.expr("shiftleft(1, _at % 8)")) > 0)
    return hit.select(*ids.columns)
