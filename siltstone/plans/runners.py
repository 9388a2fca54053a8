"""Runners of single parts: seeds from a connector, validation of a file, of a flat folder and of a tree.

Each writes its tables in a folder that all machines share and returns them. Errors are raised, not swallowed.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators import dataset, seeds, validate
from siltstone.sources.connectors import Connector, contents
from siltstone.sources.files import FILE, bare, files, first_files
from siltstone.sources.sinks import function_rows, seed_rows, write_json_lines, write_table


def gather_seeds(spark: SparkSession, connector: Connector, folder: str, max_samples: int | None = None, checker: str | None = None) -> dict[str, DataFrame]:
    """raw_functions, filtered_functions (id, content), seeds (id, seed; also as JSON lines) and stats of a connector's rows."""
    out = {}

    def table(name: str, df: DataFrame) -> None:
        write_table(df, f"{folder}/{name}")
        out[name] = spark.read.parquet(f"{folder}/{name}")

    table("raw_functions", seeds.distinct(seeds.extracted(contents(connector, spark, max_samples))))
    table("filtered_functions", function_rows(seeds.filtered(out["raw_functions"], checker)))
    table("seeds", seed_rows(out["filtered_functions"]))
    write_json_lines(out["seeds"], f"{folder}/filtered_functions.jsonl")
    table("stats", seeds.seed_stats(out["raw_functions"], out["filtered_functions"]))
    return out


def validate_files(spark: SparkSession, paths: list[str], schema: str, folder: str, max_items: int | None = None, root: str | None = None, **options) -> DataFrame:
    """Validated rows of some files of JSON lines, read by one scan, with `file`: its path below the root, or its name.

    max_items: the first rows of each file (a limit by group: a task passes on so many rows of a file at most). The code runs
    once, as the result is written to the folder. A malformed line raises. No files give no rows.
    """
    if paths:
        rows = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
        rows = rows.filter(F.trim("value") != "").withColumn("row", F.from_json("value", schema, {"mode": "FAILFAST"}))
        file = bare(F.col(FILE))
        rows = rows.withColumn("file", F.element_at(F.split(file, "/"), -1) if root is None else F.replace(file, F.concat(bare(root), F.lit("/")), F.lit("")))
        if max_items is not None:
            nth = F.row_number().over(Window.partitionBy("file").orderBy("block", "place"))
            rows = rows.withColumn("nth", nth).filter(F.col("nth") <= max_items)
        rows = rows.select("row.*", "file")
    else:
        rows = spark.createDataFrame([], f"{schema}, file string")
    path = f"{folder}/validated"
    # dealt anew, as scripts take far longer than reading: few large files have few tasks, and the limit leaves one for each file
    rows = rows.repartition(2 * spark.sparkContext.defaultParallelism)
    write_table(validate.validated(rows, **options), path)
    return spark.read.parquet(path)


def file_report(rows: DataFrame, seconds: float) -> DataFrame:
    """input_file, total_items, valid_items and validation_rate of each file, and the seconds that all took together."""
    return validate.file_stats(rows, "file").withColumnRenamed("file", "input_file").withColumn("processing_time", F.lit(seconds))


def validate_folder(spark: SparkSession, source: str, folder: str, schema: str, max_items: int | None = None, glob: str = "*.jsonl", recursive: bool = False, max_files: int | None = None, **options) -> dict[str, DataFrame]:
    """aggregated (all validated rows), file_stats, directory_stats and report of a folder's files: flat, or a whole tree.

    No file is an empty result with a rate of 0. Rows without code are invalid; a malformed line raises.
    """
    began = time.time()
    found = first_files(files(spark, source, glob, recursive), max_files)
    paths = [r["path"] for r in found.select("path").collect()]  # names of files, not rows
    rows = validate_files(spark, paths, schema, folder, max_items, source if recursive else None, **options)
    out = {"aggregated": rows, "file_stats": file_report(rows, time.time() - began), "directory_stats": validate.directory_stats(rows, "file")}
    return out | {"report": dataset.validation_report(out["directory_stats"])}


def validate_file(spark: SparkSession, path: str, folder: str, schema: str, max_items: int | None = None, **options) -> dict[str, DataFrame]:
    """validated rows of one file, also written as JSON lines, and its stats."""
    began = time.time()
    rows = validate_files(spark, [path], schema, folder, max_items, **options)
    write_json_lines(rows, f"{folder}/validated.jsonl")
    return {"validated": rows, "stats": file_report(rows, time.time() - began)}
