"""Incremental seed gathering: a file stream, distinct functions, native filters, appended tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators import seeds


def gather(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, watermark: str | None = None) -> StreamingQuery:
    """Takes what is new in a folder of Parquet files (content, and ts with a watermark) and ends.

    Without a watermark every text is remembered for good; with one, only that long by `ts`.
    """
    rows = spark.readStream.schema(schema).parquet(source)
    if watermark:
        rows = rows.withWatermark("ts", watermark)
        found = rows.select("ts", F.explode(seeds.udfs.functions("content")).alias("content")).dropDuplicatesWithinWatermark(["content"]).select("content")
    else:
        found = seeds.distinct(seeds.extracted(rows))

    def append(batch: DataFrame, number: int) -> None:
        seeds.filtered(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return found.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
