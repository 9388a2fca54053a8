"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows lie in cells (the partitions of the input). The driver draws, cell by cell, how many of a cell's rows go
to each shard: the conditional hypergeometric counts of a uniform permutation, so that shard sizes are exact.
A window permutes each cell locally, ranks are cut by the cell's row of the matrix, rows are exchanged by
(shard, bucket), and a second random key permutes every bucket; slots are the bucket's offset plus the rank.

Only DataFrame functions touch rows. The driver holds one count for each cell and shard, never rows.

Defined cases: an empty table gives an empty result; null or repeated ids and repeated rows are ordinary rows
(a row's identity is its place in the written table); columns of the input that clash with our names are not
read. Null text has no bytes. Shard counts differ by one at most, also with fewer rows than shards.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import written

ROWS_PER_BUCKET = 8192


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` rows, taken without replacement, are good ones; by inversion, for totals of any size."""
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    total = good + bad
    mean = drawn * (good / total)
    sd = math.sqrt(max(0.0, mean * (bad / total) * ((total - drawn) / max(1, total - 1))))
    reach = int(14 * sd) + 60
    a, b = max(low, int(mean) - reach), min(high, int(mean) + reach)
    k = np.arange(a, b, dtype=np.float64)  # from k to k + 1
    steps = np.log((good - k) * (drawn - k)) - np.log((k + 1) * (bad - drawn + k + 1))
    weight = np.concatenate(([0.0], np.cumsum(steps)))
    mass = np.cumsum(np.exp(weight - weight.max()))
    return a + int(np.searchsorted(mass, rng.random() * mass[-1], side="right").clip(0, b - a))


def communication_matrix(cells: list[tuple[int, int]], n_shards: int, seed: int) -> list[tuple[int, list[int]]]:
    """For each (cell, rows): the running sums over shards of the rows that it sends."""
    total = sum(n for _, n in cells)
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    rng, left, out = np.random.default_rng(seed), total, []
    for cell, n in sorted(cells):
        rest, others, sent, at = n, left, [], 0
        for s in range(n_shards):
            others -= room[s]
            take = hypergeometric(rng, room[s], others, rest)
            rest -= take
            at += take
            sent.append(at)
            room[s] -= take
        left -= n
        out.append((cell, sent))
    return out


def key(seed: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def assign(df: DataFrame, n_shards: int, seed: int = 17, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds shard (int) and slot (long, gapless from 0 in each shard) to a narrow DataFrame.

    df is written to the shared folder first, so that a row's place is the same in every later pass; pass the
    columns that identify a row, not the text.
    """
    spark = df.sparkSession
    placed = written(df.select(F.struct(*df.columns).alias("row"), F.spark_partition_id().alias("cell"), F.monotonically_increasing_id().alias("place")), "shard-rows")
    cells = [(r["cell"], r["n"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()]
    total = sum(n for _, n in cells)
    matrix = spark.createDataFrame(communication_matrix(cells, n_shards, seed), "cell int, sent array<long>")
    local = Window.partitionBy("cell").orderBy(key(seed, F.col("place")), "place")
    dealt = placed.withColumn("rank", F.row_number().over(local) - 1).join(matrix, "cell")
    buckets = max(1, math.ceil(total / n_shards / rows_per_bucket))
    dealt = dealt.select(
        "row",
        "place",
        F.size(F.filter("sent", lambda x: x <= F.col("rank"))).cast("int").alias("shard"),
        F.pmod(key(seed + 1, F.col("place")), F.lit(buckets)).cast("int").alias("bucket"),
    )
    dealt = written(dealt, "shard-dealt")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    final = Window.partitionBy("shard", "bucket").orderBy(key(seed + 2, F.col("place")), "place")
    return (
        dealt.withColumn("rank", F.row_number().over(final) - 1)
        .join(offsets.select("shard", "bucket", "offset"), ["shard", "bucket"])
        .select("row.*", "shard", (F.col("offset") + F.col("rank")).cast("long").alias("slot"))
    )


def shard_documents(documents: DataFrame, n_shards: int = 16, seed: int = 17) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = documents.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    return assign(narrow, n_shards, seed)


def write_shards(df: DataFrame, id_col: str, path: str, n_shards: int = 16, seed: int = 17) -> None:
    """Writes whole rows as Parquet folders shard=k, each sorted by slot.

    The rows are written once with their place, and shards are joined by it, so null and repeated ids are ordinary
    rows; id_col is not read.
    """
    whole = written(df.select(F.struct(*df.columns).alias("row"), F.monotonically_increasing_id().alias("__place")), "shard-whole")
    placed = assign(whole.select("__place"), n_shards, seed)
    rows = whole.join(placed, "__place").select("row.*", "shard", "slot")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)
