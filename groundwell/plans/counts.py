"""What the stages of a run have seen, observed while their tables are written (A6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Counts:
    """Observations by stage. Nothing is read again for them: they come with the pass that writes a stage's table."""

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def watched(self, stage: str, rows: DataFrame, **more: Column) -> DataFrame:
        """``rows``, whose number and aggregates ``more`` are kept when they are first written."""
        self._seen[stage] = Observation()
        return rows.observe(self._seen[stage], F.count(F.lit(1)).alias("rows"), *[c.alias(name) for name, c in more.items()])

    def get(self) -> dict[str, dict[str, int]]:
        """stage: name: value, of the stages that were written."""
        return {stage: dict(o.get) for stage, o in self._seen.items()}

    def table(self, like: DataFrame) -> DataFrame:
        """stage, name, value: a row a count."""
        rows = [(stage, name, int(v)) for stage, values in self.get().items() for name, v in values.items()]
        return like.sparkSession.createDataFrame(rows, "stage string, name string, value long")
