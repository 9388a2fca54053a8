"""Sanitize, execute in a child process, measure; statistics by file and in all."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from queue import SimpleQueue

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import syntax, text, udfs
from siltstone.operators.sandbox import OUTPUT, TIMED_OUT, Interpreter
from siltstone.operators.seeds import rate

TIMEOUT = 5.0
FLAG = "execution_valid"
# Fixed values.
NO_CODE = "No code provided"
# End of fixed values.


def execute(script: str, timeout: float = TIMEOUT, memory_mb: int | None = None) -> tuple[bool, str, float]:
    """One script in an interpreter of its own: see Interpreter.execute()."""
    with Interpreter() as interpreter:
        return interpreter.execute(script, timeout, memory_mb)


ADDED = "execution_valid boolean, execution_output string, execution_time double, complexity int, has_type_annotations boolean"


def validated(rows: DataFrame, timeout: float = TIMEOUT, memory_mb: int | None = None, threads: int = 4) -> DataFrame:
    """Adds the six columns of validation; rows without code are invalid and have no metrics. Write the result before
    using it twice: the code would run again. Each thread of a task has an interpreter that forks for each script."""
    code = F.when(F.col("response") != "", text.sanitized(F.col("response")))
    made = rows.withColumn("__code", code).withColumn("function_name", F.when(F.col("__code").isNotNull(), udfs.main_name("__code")))
    made = made.withColumn("__script", text.script(F.col("__code"), F.col("function_name")))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema if not f.name.startswith("__")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idle: SimpleQueue[Interpreter] = SimpleQueue()

        def measure(code: str | None, script: str | None) -> tuple:
            if code is None:
                return False, NO_CODE, None, None, None
            interpreter = idle.get()
            try:
                return *interpreter.execute(script, timeout, memory_mb), syntax.complexity(code), syntax.annotated(code)
            finally:
                idle.put(interpreter)

        with contextlib.ExitStack() as interpreters, ThreadPoolExecutor(threads) as pool:
            for _ in range(threads):
                idle.put(interpreters.enter_context(Interpreter()))
            for frame in frames:
                clean = frame[["__code", "__script"]].astype(object).where(frame[["__code", "__script"]].notna(), None)
                found = list(pool.map(measure, clean["__code"], clean["__script"]))
                out = frame.drop(columns=["__code", "__script"])
                for i, (name, kind) in enumerate((("execution_valid", "boolean"), ("execution_output", object), ("execution_time", "Float64"), ("complexity", "Int32"), ("has_type_annotations", "boolean"))):
                    out[name] = pd.array([x[i] for x in found], dtype=kind)
                yield out

    return made.mapInPandas(run, ", ".join(kept) + ", " + ADDED)


def counts() -> list:
    return [F.count("*").alias("total_items"), F.count_if(F.coalesce(F.col(FLAG), F.lit(False))).alias("valid_items")]


def stats(rows: DataFrame) -> DataFrame:
    return rows.agg(*counts()).withColumn("validation_rate", rate("valid_items", "total_items"))


def file_stats(rows: DataFrame, file: str) -> DataFrame:
    """A row for each file."""
    return rows.groupBy(file).agg(*counts()).withColumn("validation_rate", rate("valid_items", "total_items"))


def directory_stats(rows: DataFrame, file: str) -> DataFrame:
    """One row: totals, and the files' rows as an array."""
    per = file_stats(rows, file)
    total = per.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("total_items"), F.lit(0)).alias("total_items"), F.coalesce(F.sum("valid_items"), F.lit(0)).alias("valid_items"), F.sort_array(F.collect_list(F.struct(file, "total_items", "valid_items"))).alias("file_stats"))
    return total.withColumn("success_rate", rate("valid_items", "total_items"))
