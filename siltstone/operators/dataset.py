"""The final dataset, unions of results, and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def final(rows: DataFrame) -> DataFrame:
    """instruction and response (as generated) of the valid rows; missing ones are empty."""
    valid = rows.filter(F.coalesce("execution_valid", F.lit(False)))
    return valid.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("instruction", "response")))


def final_stats(dataset: DataFrame) -> DataFrame:
    return dataset.agg(F.count("*").alias("total_items"), F.count("*").alias("instruction_response_pairs"))


def report(seed_stats: DataFrame, stage_counts: DataFrame, validation: DataFrame, final_stats: DataFrame) -> DataFrame:
    """One row, `report`: the run as Markdown. All inputs have one row; stage_counts: concepts, instructions, responses."""
    rows = seed_stats.crossJoin(stage_counts).crossJoin(validation.select("valid_items", "validation_rate")).crossJoin(final_stats.select(F.col("total_items").alias("final_items")))
    lines = [
        F.lit("# Run report\n"),
        F.format_string("- functions: %d raw, %d kept (%.2f%%)", "raw_functions", "filtered_functions", "filter_rate"),
        F.format_string("- concepts: %d, instructions: %d, responses: %d", "concepts", "instructions", "responses"),
        F.format_string("- valid: %d (%.2f%%)", "valid_items", F.col("validation_rate") * 100),
        F.format_string("- final pairs: %d", "final_items"),
    ]
    return rows.select(F.concat_ws("\n", *lines).alias("report"))


def validation_report(directory_stats: DataFrame) -> DataFrame:
    part = F.transform("file_stats", lambda f: F.format_string("## %s\n- rows: %d\n- valid: %d", f["file"], f["total_items"], f["valid_items"]))
    head = F.format_string("# Validation\n- files: %d\n- rows: %d\n- valid: %d (%.2f%%)", "total_files", "total_items", "valid_items", F.col("success_rate") * 100)
    return directory_stats.select(F.concat_ws("\n\n", head, F.array_join(part, "\n\n")).alias("report"))
