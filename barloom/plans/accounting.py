"""How many rows each step takes, drops, and why, counted while the step runs."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from barloom.functions.columns import present
from barloom.plans.steps import Keep


class Account:
    """Rows in, rows out and rows dropped of steps, by the first of the step's columns that is missing.

    keep(step) stands in for present() in a step: it drops the same rows and observes both sides of the drop in the same
    job. table() gives the counts once every observed step has been written; a step that is run twice counts once.
    """

    def __init__(self) -> None:
        self.seen: list[tuple[str, list[str], Observation, Observation]] = []

    def keep(self, step: str) -> Keep:
        def drop(df: DataFrame, names: list[str]) -> DataFrame:
            before, after = Observation(), Observation()
            self.seen.append((step, names, before, after))
            first = {n: reduce(and_, [F.col(m).isNotNull() for m in names[:k]], F.col(n).isNull()) for k, n in enumerate(names)}
            counted = df.observe(before, F.count(F.lit(1)).alias("rows_in"), *[F.count(F.when(c, 1)).alias(n) for n, c in first.items()])
            return present(counted, names).observe(after, F.count(F.lit(1)).alias("rows_out"))

        return drop

    def table(self, spark: SparkSession) -> DataFrame:
        """(step, reason, n): rows_in, rows_out, dropped, and the rows dropped for each column."""
        out = []
        for step, names, before, after in self.seen:
            seen, kept = before.get, after.get
            out += [(step, "rows_in", seen["rows_in"]), (step, "rows_out", kept["rows_out"]), (step, "dropped", seen["rows_in"] - kept["rows_out"])]
            out += [(step, f"missing {n}", seen[n]) for n in names]
        return spark.createDataFrame(out, "step string, reason string, n long")
