"""Sinks: JSON lines with explicit nulls, tables, seed rows, statistics, resumed results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.sources.files import numbered


def write_json_lines(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def function_rows(functions: DataFrame) -> DataFrame:
    """id and content: numbered in order of the text; rows without text stay."""
    return numbered(functions.select("content"), "content", name="id").select("id", "content")


def write_table(df: DataFrame, path: str) -> None:
    """An empty result keeps its schema."""
    df.write.mode("overwrite").parquet(path)


def seed_rows(functions: DataFrame) -> DataFrame:
    """id and seed (content, or else seed, of the input): numbered in order of the text; rows without text are left out, though
    they use up a number."""
    texts = [F.nullif(F.col(c), F.lit("")) for c in ("content", "seed") if c in functions.columns]
    rows = numbered(functions.select(F.coalesce(*texts, F.lit("")).alias("seed")), "seed", name="id")
    return rows.filter("seed <> ''").select("id", "seed")


def stats_text(df: DataFrame) -> str:
    """A one-row DataFrame as a JSON object."""
    (row,) = df.collect()
    return json.dumps(row.asDict(recursive=True), indent=2)


def resumed(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Earlier rows and new ones."""
    return existing.unionByName(new, allowMissingColumns=True)
