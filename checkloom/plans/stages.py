"""Named stages with dependencies, run in order, skipped while their inputs' manifests stay the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Stage:
    name: str
    run: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    needs: tuple[str, ...] = ()
    options: dict[str, str] = field(default_factory=dict)


class Registry:
    def __init__(self):
        self.stages: dict[str, Stage] = {}

    def add(self, stage: Stage) -> Stage:
        if stage.name in self.stages:
            raise ValueError(f"stage {stage.name} is there already")
        self.stages[stage.name] = stage
        return stage

    def order(self, *wanted: str) -> list[str]:
        """The wanted stages and all that they need, dependencies first."""
        out: list[str] = []
        state: dict[str, int] = {}

        def visit(n):
            if state.get(n) == 1:
                raise ValueError(f"stage {n} needs itself")
            if n not in state:
                state[n] = 1
                for m in self.stages[n].needs:
                    visit(m)
                state[n] = 2
                out.append(n)

        for n in wanted:
            visit(n)
        return out

    def run(self, spark: SparkSession, path: str, *wanted: str, unchanged: frozenset[str] = frozenset()) -> dict[str, DataFrame]:
        """Runs stages into Parquet tables under `path`; those in `unchanged` whose needs are too are read only."""
        done: dict[str, DataFrame] = {}
        fresh: set[str] = set()
        for n in self.order(*wanted):
            stage = self.stages[n]
            if n not in unchanged or fresh & set(stage.needs):
                stage.run(spark, {m: done[m] for m in stage.needs}).write.mode("overwrite").parquet(f"{path}/{n}")
                fresh.add(n)
            done[n] = spark.read.parquet(f"{path}/{n}")
        return done
