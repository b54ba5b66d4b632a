"""What every stage really read, and what holds of the rows that it wrote, at no scan of its own.

A ledger hands a stage its input with metrics attached (DataFrame.observe): while the stage's own job reads the rows, they are counted by split.
The leakage matrix is made of those counts, so it tells what was read and not what somebody typed. Row checks ride on a write in the same way.
"""

from __future__ import annotations

import threading
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from evimine.operators.audit import STAGES
from evimine.sources.scratch import stored

#: Seconds after which a stage counts as one that never ran.
PATIENCE = 60.0


class NotRun(RuntimeError):
    """A stage was given its input and ran no job on it."""


def _metrics(observation: Observation, what: str, patience: float) -> dict:
    found: list[dict] = []
    waiting = threading.Thread(target=lambda: found.append(observation.get), daemon=True)
    waiting.start()
    waiting.join(patience)
    if not found:
        raise NotRun(what)
    return found[0]


class Ledger:
    """Inputs of stages. What is not observed to the end of a job (an input cut short by a limit, say) is counted as far as it was read."""

    def __init__(self, split: str = "split", train: str = "train"):
        self.split, self.train, self.entries = split, train, []

    def reads(self, stage: str, name: str, df: DataFrame) -> DataFrame:
        """df, whose first job counts its rows by split for the entry of this stage. A null split is not for training."""
        if stage not in STAGES:
            raise KeyError(stage)
        seen, own = Observation(), F.coalesce(F.col(self.split) == self.train, F.lit(False))
        self.entries.append((stage, name, seen))
        return df.observe(seen, F.count_if(own).alias("n_train"), F.count_if(~own).alias("n_other"))

    def matrix(self, spark: SparkSession, patience: float = PATIENCE) -> DataFrame:
        """stage, input, n_train, n_other and status of every entry: rows that are not for training are a FAIL unless the stage only evaluates."""
        rows = []
        for stage, name, seen in self.entries:
            m = _metrics(seen, f"{stage}: {name}", patience)
            rows.append((stage, name, m["n_train"], m["n_other"], "PASS" if STAGES[stage] or not m["n_other"] else "FAIL"))
        return spark.createDataFrame(rows, "stage string, input string, n_train long, n_other long, status string")


def written(df: DataFrame, conditions: Mapping[str, str], patience: float = PATIENCE) -> tuple[DataFrame, DataFrame]:
    """df written once, and a row per condition (SQL that each row has to meet; null does not): name, required, n_bad and status.

    The checks are counted while the table is written. An empty table meets every condition.
    """
    seen = Observation()
    bad = [F.count_if(~F.coalesce(F.expr(c), F.lit(False))).alias(f"c{i}") for i, c in enumerate(conditions.values())]
    table = stored(df.observe(seen, *bad) if bad else df)
    m = _metrics(seen, "write", patience) if bad else {}
    rows = [(name, c, m[f"c{i}"], "PASS" if not m[f"c{i}"] else "FAIL") for i, (name, c) in enumerate(conditions.items())]
    return table, df.sparkSession.createDataFrame(rows, "name string, required string, n_bad long, status string")


def group_checks(df: DataFrame, keys: list[str], conditions: Mapping[str, str]) -> DataFrame:
    """The same rows for conditions on groups: aggregates of the rows of one key, counted by groups that fail. All conditions in one aggregation."""
    each = df.groupBy(*keys).agg(*(F.coalesce(F.expr(c), F.lit(False)).alias(f"c{i}") for i, c in enumerate(conditions.values())))
    counts = each.agg(*(F.count_if(~F.col(f"c{i}")).alias(f"n{i}") for i in range(len(conditions))))
    row = lambda i, name, c: F.struct(F.lit(name).alias("name"), F.lit(c).alias("required"), F.col(f"n{i}").alias("n_bad"), F.when(F.col(f"n{i}") == 0, "PASS").otherwise("FAIL").alias("status"))
    return counts.select(F.inline(F.array(*(row(i, name, c) for i, (name, c) in enumerate(conditions.items())))))
