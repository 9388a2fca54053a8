"""From source files to seed functions: extract, distinct, quality filter, statistics."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import syntax, text, udfs


def extracted(files: DataFrame) -> DataFrame:
    """One row for each distinct documented function of each file's `content`."""
    return files.select(F.explode(udfs.functions("content")).alias("content"))


def distinct(functions: DataFrame) -> DataFrame:
    """Exact text equality over the whole corpus (partial aggregates before the exchange)."""
    return functions.dropDuplicates(["content"])


def default_checker() -> str:
    """mypy where the driver has it, else compile."""
    return "compile" if shutil.which("mypy") is None else "mypy"


def checked(functions: DataFrame, checker: str | None = None) -> DataFrame:
    """Type check after the native tests, all columns kept. compile: it parses; mypy: one call for each batch (an error without
    mypy); none; by default mypy where it is installed, else compile."""
    checker = checker or default_checker()
    if checker == "none":
        return functions
    check: Callable[[pd.Series], pd.Series] = {"compile": lambda s: s.map(syntax.compiles), "mypy": by_mypy}[checker]
    if checker == "mypy" and shutil.which("mypy") is None:
        raise RuntimeError("mypy is not installed; without it every row would be rejected")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[check(b["content"]).astype(bool)]

    return functions.mapInPandas(run, functions.schema)


#: Fixed value: the language version that functions are checked for.
PYTHON_VERSION = "3.8"


def with_stubs(source: str) -> str:
    """A function's file: every module that its text seems to import may be missing."""
    names = dict.fromkeys(m.split(".")[0] for m in re.findall(text.IMPORT.replace("(?mdU)", "(?m)"), source))
    stubs = "".join(f"try:\n    import {n}\nexcept ImportError:\n    pass\n" for n in names if n)
    return f"# mypy: ignore-missing-imports\n{stubs}\n{source}"


def by_mypy(sources: pd.Series) -> pd.Series:
    """A batch in one call, each function a module of its own; it fails with an error of its own, or, if the call breaks off
    without naming any, the functions are checked one by one."""
    with tempfile.TemporaryDirectory() as folder:
        names = [f"m{i}.py" for i in range(len(sources))]
        for name, source in zip(names, sources, strict=True):
            with open(os.path.join(folder, name), "w", encoding="utf-8", errors="replace") as f:
                f.write(with_stubs(source or ""))
        ask = lambda some: subprocess.run(["mypy", "--python-version", PYTHON_VERSION, "--no-error-summary", *some], capture_output=True, text=True, cwd=folder)
        out = ask(names)
        bad = {line.partition(":")[0] for line in out.stdout.splitlines() if "error:" in line}
        if out.returncode and (not bad or out.returncode > 1):
            singles = [ask([n]) for n in names]
            bad = {n for n, r in zip(names, singles, strict=True) if r.returncode or "error:" in r.stdout}
    return pd.Series([n not in bad for n in names], index=sources.index)


def filtered(functions: DataFrame, checker: str | None = None) -> DataFrame:
    """The rows (all columns, an id too) whose content passes every test."""
    return checked(functions.filter(text.good_seed(F.col("content"))), checker)


def rate(part: str, whole: str, factor: float = 1.0):
    """A share, 0 for empty input."""
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)) * factor, F.lit(0.0))


def seed_stats(functions: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """raw_functions, filtered_functions and filter_rate (percent). kept: the filtered table; without it the native tests
    alone are counted, in one pass."""
    if kept is None:
        counts = functions.agg(F.count("*").alias("raw_functions"), F.count_if(text.good_seed(F.col("content"))).alias("filtered_functions"))
    else:
        counts = functions.agg(F.count("*").alias("raw_functions")).crossJoin(kept.agg(F.count("*").alias("filtered_functions")))
    return counts.withColumn("filter_rate", rate("filtered_functions", "raw_functions", 100.0))
