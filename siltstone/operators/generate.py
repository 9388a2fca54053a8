"""Batched generation by a pluggable model, and a deterministic stand-in that is a Catalyst expression."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.operators import prompts
from siltstone.sources.files import numbered, sliced
from siltstone.sources.sinks import resumed


class Generator(Protocol):
    def generate(self, prompts: list[str], seeds: list[int], **options) -> list[str]: ...


DEFAULTS = {"max_new_tokens": 1024, "temperature": 0.7, "top_p": 0.95}


def row_seed(seed: int) -> Column:
    """A row's own seed: of its prompt and of the run's."""
    return F.xxhash64("prompt", F.lit(seed))


def generated(rows: DataFrame, make: Callable[[], Generator], batch_size: int = 8, delay: float = 0.0, seed: int = 42, defaults: dict | None = None, **options) -> DataFrame:
    """Adds output. The model is made once in each worker; a row's seed depends on its prompt, not on its place."""
    options = (DEFAULTS if defaults is None else defaults) | options
    if options["temperature"] <= 0:
        options["top_p"] = 1.0
    seeded = rows.withColumn("__seed", row_seed(seed))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", output string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, first = make(), True
        for frame in frames:
            for a in range(0, len(frame), batch_size):
                if delay and not first:
                    time.sleep(delay)
                first = False
                part = frame.iloc[a : a + batch_size]
                yield part.drop(columns="__seed").assign(output=model.generate(part["prompt"].tolist(), part["__seed"].tolist(), **options))

    return seeded.mapInPandas(run, schema)


def stand_in(mode: str, prompt: Column, source: Column) -> Column:
    """What the stand-in answers: the prompt, then a line about the row's text; a fenced function for the last stage."""
    digest = F.substring(F.md5(source.cast("binary")), 1, 8)
    answer = {
        "S->C": F.concat(F.lit("Idea "), digest),
        "C->I": F.concat(F.lit("Task for "), source, F.lit("\\nInstruction: no more")),
        "I->R": F.concat(F.lit("Here:\n```python\ndef solve(x):\n    return '"), digest, F.lit("'\n```")),
    }[mode]
    return F.concat(prompt, answer, F.lit(" \n"))


def stage(rows: DataFrame, mode: str, make: Callable[[], Generator] | None = None, **options) -> DataFrame:
    """One of the three stages: prompt, output, completion, and the mode's extraction as a new column; empty ones go.
    Without a model the stand-in answers, and the stage is one expression that names its source once."""
    source, name = prompts.columns(mode)
    if make is None:
        told = lambda s: text.let(prompts.plain(mode, source=s), lambda p: text.after_mode(text.completion(p, stand_in(mode, p, s)), mode))
        out = rows.withColumn(name, text.let(F.col(source), told))
    else:
        answered = generated(prompts.prompted(rows, mode), make, **options)
        out = answered.withColumn(name, text.after_mode(text.completion(F.col("prompt"), F.col("output")), mode)).drop("prompt", "output")
    return out.filter(F.col(name).isNotNull())


def run_stages(
    seeds: DataFrame,
    make: Callable[[], Generator] | None = None,
    samples: tuple[int, int, int] = (1, 1, 1),
    start: tuple[int, int, int] = (0, 0, 0),
    items: tuple[int | None, int | None, int | None] = (None, None, None),
    continue_from: tuple[DataFrame | None, DataFrame | None, DataFrame | None] = (None, None, None),
    skip: tuple[str, ...] = (),
    **options,
) -> dict[str, DataFrame]:
    """The three stages' tables by mode, from rows with an id.

    samples: answers for each row, told apart by sample_idx. start, items: the slice of a stage's input by id (0 or None items:
    to the end). continue_from: a stage's earlier rows, which stand before the new ones; with a skipped stage they are its
    table as it is, without one the next stage reads the skipped stage's input.
    """
    out, rows = {}, seeds
    for i, mode in enumerate(prompts.MODES):
        if mode in skip:
            rows = out[mode] = rows if continue_from[i] is None else continue_from[i]
            continue
        if start[i] or items[i]:
            rows = sliced(numbered(rows, "id", *(["sample_idx"] if "sample_idx" in rows.columns else [])), "ordinal", start[i], items[i]).drop("ordinal")
        if samples[i] > 1:
            again = F.explode(F.sequence(F.lit(0), F.lit(samples[i] - 1)))
            mixed = F.col("sample_idx") * samples[i] if "sample_idx" in rows.columns else F.lit(0)
            rows = rows.withColumn("__again", again).withColumn("sample_idx", mixed + F.col("__again")).drop("__again")
        rows = stage(rows, mode, make, **options)
        if continue_from[i] is not None:
            rows = resumed(continue_from[i], rows)
        out[mode] = rows
    return out


def chain(seeds: DataFrame, make: Callable[[], Generator] | None = None) -> DataFrame:
    for mode in prompts.MODES:
        seeds = stage(seeds, mode, make)
    return seeds
