"""The stage runner: each stage is written once, found again by a hash of its options, and read by the next."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import dataset, generate, seeds, validate
from siltstone.sources.sinks import seed_rows


ARTEFACTS = ("functions", "seeds", "concepts", "instructions", "responses", "validated", "final", "report")


def identity(files: DataFrame) -> str:
    """What the contents are, whatever their order: one aggregate over the input."""
    h = F.xxhash64("content")
    (row,) = files.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1 << 20))).alias("s")).collect()
    return f"{row['n']}-{row['x']}-{row['s']}"


class Pipeline:
    """Runs stages in a folder that all machines share. A failed stage raises; finished ones are not run again.

    What was run is found again by the options, the checker, the model's name and the input: its contents, or a name that the
    caller gives to it (which saves a scan of the input).
    """

    def __init__(self, spark: SparkSession, folder: str, clean: bool = False, **options):
        self.spark, self.folder, self.clean = spark, folder.rstrip("/"), clean
        self.options = options
        self.key: str | None = None
        self.ran: list[str] = []

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.folder}/{self.key}/{name}"
        if not self.clean:
            try:
                return self.spark.read.parquet(path)
            except AnalysisException:
                pass
        self.ran.append(name)
        make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def run(self, files: DataFrame, model: Callable | None = None, checker: str | None = None, name: str | None = None, samples=(1, 1, 1), start=(0, 0, 0), items=(None, None, None)) -> dict[str, DataFrame]:
        """files: content. samples, start and items: those of generate.run_stages(). Returns every stage's table."""
        checker = checker or seeds.default_checker()
        made_by = model and (getattr(model, "name", None) or f"{model.__module__}.{model.__qualname__}")
        what = [self.options, samples, start, items, checker, made_by, name or identity(files)]
        self.key = hashlib.sha256(json.dumps(what, sort_keys=True, default=str).encode()).hexdigest()[:12]
        out = {"functions": self.stage("functions", lambda: seeds.distinct(seeds.extracted(files)))}
        out["seeds"] = self.stage("seeds", lambda: seed_rows(seeds.filtered(out["functions"], checker)))
        rows = out["seeds"]
        for i, (mode, stage) in enumerate((("S->C", "concepts"), ("C->I", "instructions"), ("I->R", "responses"))):
            one = [tuple(v[j] if j == i else none for j in range(3)) for v, none in ((samples, 1), (start, 0), (items, None))]
            rest = tuple(m for m in generate.prompts.MODES if m != mode)
            rows = out[stage] = self.stage(stage, lambda r=rows, m=mode, o=one, k=rest: generate.run_stages(r, model, *o, skip=k)[m])
        out["validated"] = self.stage("validated", lambda: validate.validated(rows))
        out["final"] = self.stage("final", lambda: dataset.final(out["validated"]))
        counts = [out[n].agg(F.count("*").alias(n)) for n in ("concepts", "instructions", "responses")]
        counts = counts[0].crossJoin(counts[1]).crossJoin(counts[2])
        out["report"] = self.stage("report", lambda: dataset.report(seeds.seed_stats(out["functions"], out["seeds"]), counts, validate.stats(out["validated"]), dataset.final_stats(out["final"])))
        return out

    def missing(self) -> list[str]:
        """Artefacts of the last run that are not there; all before one."""
        lacking = []
        for name in ARTEFACTS:
            try:
                self.spark.read.parquet(f"{self.folder}/{self.key}/{name}")
            except AnalysisException:
                lacking.append(name)
        return lacking
