"""A bitmap of bounded size that tells rows that can't be among some chosen ones from those that can."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 32768
BUCKETS = 512
MOST_BITS = 1 << 30


def buckets_for(count: int) -> int:
    """Buckets with 16 to 32 bits for each of so many hashes, 2 MB to 128 MB in all."""
    return 1 << min((MOST_BITS // BITS).bit_length() - 1, max(9, (16 * count // BITS).bit_length()))


def bits_of(hashes: DataFrame, buckets: int) -> np.ndarray:
    """The bitmap of a single column of hashes as bytes, for a broadcast: of a fixed size, read partition by partition."""
    out = np.zeros(buckets * BITS // 8, np.uint8)
    for r in bitmaps(hashes, buckets).toLocalIterator():
        out[r["__bucket"] * BITS // 8 : (r["__bucket"] + 1) * BITS // 8] = np.frombuffer(r["__map"], np.uint8)
    return out


def among(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each int64 hash may be among those of the bitmap."""
    bit = hashes % (len(bits) * 8)  # of the sign of the divisor, as pmod
    return (bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)


def bitmaps(hashes: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and map (4 KB) of a single column of hashes: at most `buckets` rows."""
    (name,) = hashes.columns
    bit = hashes.select(F.pmod(F.col(name), F.lit(buckets * BITS)).alias("bit"))
    return bit.groupBy(F.floor(F.col("bit") / BITS).cast("int").alias("__bucket")).agg(F.expr(f"bitmap_construct_agg(bit % {BITS})").alias("__map"))


def flagged(df: DataFrame, hashed: Column, chosen: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Adds __maybe: false only if the hash is not in the single column of `chosen`. What is broadcast has a fixed size."""
    df = df.withColumn("__bit", F.pmod(hashed, F.lit(buckets * BITS))).withColumn("__bucket", F.floor(F.col("__bit") / BITS).cast("int"))
    byte = f"cast(conv(hex(substring(__map, cast((__bit % {BITS}) div 8 as int) + 1, 1)), 16, 10) as int)"
    told = df.join(F.broadcast(bitmaps(chosen, buckets)), "__bucket", "left")
    return told.withColumn("__maybe", F.coalesce(F.expr(f"shiftright({byte}, cast(__bit % 8 as int)) & 1 = 1"), F.lit(False))).drop("__bit", "__bucket", "__map")


def among_maybe(df: DataFrame, hashes: DataFrame, use) -> DataFrame:
    """Applies a step to the rows whose __h may be among some hashes; the others are neither changed nor exchanged."""
    told = flagged(df, F.col("__h"), hashes, buckets_for(hashes.count()))
    return told.filter("not __maybe").drop("__maybe").unionByName(use(told.filter("__maybe").drop("__maybe")))
