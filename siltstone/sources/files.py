"""Scans: JSON lines (tolerant and strict), tables with a fallback, discovery, limits, counts; and options."""

from __future__ import annotations

import os
import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.session import conf, written

FILE = "__file"
#: Keys that numbered() samples for a range: Spark takes three times as many. At 100, Spark's default, the driver gets almost all
#: keys of some tables, whole texts; 10 deal out ranges that differ by some 18 % (one standard deviation).
SAMPLED = 10
#: The environment's names of the services' keys.
SERVICE_KEYS = {"huggingface": "HUGGINGFACE_API_KEY", "openai": "OPENAI_API_KEY"}


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False, recursive: bool = False) -> DataFrame:
    """Rows of JSON lines of files of any name, with the file's name. Blank lines are skipped; a malformed line raises if
    strict, else it is skipped (skipped_lines() counts those). The tolerant form keeps rows whose values don't fit their type
    (those values are null) and values that are no object (all columns null; `value` has the line where the schema asks for it)."""
    lines = lines_of(spark, path, recursive)
    mode = "FAILFAST" if strict else "PERMISSIVE"
    rows = lines.withColumn("row", F.from_json("value", schema, {"mode": mode}))
    if not strict:
        rows = rows.filter(F.try_parse_json("value").isNotNull())
    fields = StructType.fromDDL(schema).names if isinstance(schema, str) else schema.names
    plain = ~F.ltrim("value").startswith("{")
    columns = [F.when(plain, F.col("value")).otherwise(F.col(f"row.{n}")).alias(n) if n == "value" else F.col(f"row.{n}") for n in fields]
    return rows.select(*columns, FILE)


def lines_of(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """value and the file's name of the lines that are not blank."""
    lines = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path)
    return lines.select("value", F.col("_metadata.file_path").alias(FILE)).filter(F.trim("value") != "")


def skipped_lines(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """file and n: the lines that the tolerant scan skips as malformed."""
    return lines_of(spark, path, recursive).filter(F.try_parse_json("value").isNull()).groupBy(F.col(FILE).alias("file")).agg(F.count("*").alias("n"))


def table_or_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or JSON lines if it is none."""
    try:
        return spark.read.parquet(path)
    except (AnalysisException, Py4JJavaError):  # a file of another kind fails when its footer is read
        return json_lines(spark, path, schema).drop(FILE)


def bare(path: str | Column) -> Column:
    """A path without its scheme."""
    return F.regexp_replace(F.lit(path.rstrip("/")) if isinstance(path, str) else path, "^[A-Za-z0-9]+:/+", "/")


def files(spark: SparkSession, path: str, glob: str = "*.jsonl", recursive: bool = True) -> DataFrame:
    """path and bytes of each file of a tree, or of a folder alone; a partitioned table's folders are folders like others."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    if not recursive:
        found = found.filter(F.regexp_replace(bare(F.col("path")), "/[^/]*$", "") == bare(path))
    return found.select("path", F.col("length").alias("bytes"))


def first_files(found: DataFrame, most: int | None) -> DataFrame:
    """The first files by path; all without a limit."""
    return first_rows(found, most, "path")


def count_lines(spark: SparkSession, path: str, blank: bool = True) -> int:
    """Lines of a file or folder, or only those that are not blank; 0 if it can't be read."""
    try:
        lines = spark.read.text(path)
        return (lines if blank else lines.filter("trim(value) <> ''")).count()
    except (AnalysisException, Py4JJavaError):
        return 0


def first_rows(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first n rows; all without n."""
    df = df.orderBy(*order) if order else df
    return df if n is None else df.limit(n)


def numbered(df: DataFrame, *order: str, name: str = "ordinal") -> DataFrame:
    """A number from 0 on by some order: counts of ranges first, so that no task holds all rows.

    The dealt rows are written once to the shared folder: ranges are sampled anew by each exchange, so counts and rows
    must come from one. The driver gets three times SAMPLED whole keys for each range. Equal keys are numbered in no stated order; null keys come first."""
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__place": F.monotonically_increasing_id()})
    with conf(spark, "spark.sql.execution.rangeExchange.sampleSizePerPartition", SAMPLED):
        dealt = written(dealt, "numbered")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    return dealt.join(F.broadcast(sizes), "__part").withColumn(name, F.col("__before") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__place", "__before")


def sliced(df: DataFrame, ordinal: str, start: int = 0, items: int | None = None) -> DataFrame:
    """Rows from an ordinal on; 0 or None items: to the end."""
    out = df.filter(F.col(ordinal) >= start)
    return out.filter(F.col(ordinal) < start + items) if items else out


def environment(path: str | None = None) -> dict[str, str]:
    """The environment with the settings of the first .env file that is found; empty without one."""
    for p in [path] if path else [".env", "../.env"]:
        if p and os.path.isfile(p):
            with open(p) as f:
                own = dict(m.groups() for line in f if (m := re.match(r"\s*(\w+)\s*=\s*(.*?)\s*$", line)))
            return {**own, **os.environ}
    return {}


def secret(name: str, env: dict[str, str] | None = None) -> str:
    """A service's key; empty for placeholders."""
    if name not in SERVICE_KEYS:
        raise ValueError(f"unknown service {name}")
    value = (os.environ if env is None else env).get(SERVICE_KEYS[name], "")
    return "" if value.startswith("your_") or value == "your-api-key-here" else value


def setting(value: str | None, default=None):
    """An int of digits, a float of digits and one dot, else the string."""
    if value is None:
        return default
    if re.fullmatch(r"[0-9]+", value):
        return int(value)
    return float(value) if re.fullmatch(r"[0-9]+\.[0-9]*|\.[0-9]+", value) else value
