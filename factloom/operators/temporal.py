"""As-of joins, last changes and streaks over ordered steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def forward_asof(overlays: DataFrame, steps: list[int], key: str, step: str, value: str) -> DataFrame:
    """``key, step, value``: the value of the smallest overlay step at or after each step (null after the last one).

    Overlays (one row per key and step) and the listed steps are brought into one ordered window per key, so the join needs no theta condition.
    """
    grid = overlays.select(key).distinct().withColumn(step, F.explode(F.array(*[F.lit(n) for n in steps])))
    both = grid.join(overlays.select(key, step, value), [key, step], "left")
    w = W.partitionBy(key).orderBy(F.col(step)).rowsBetween(0, W.unboundedFollowing)
    return both.withColumn(value, F.first(value, ignorenulls=True).over(w))


def last_change(states: DataFrame, key: str, step: str, value: str) -> DataFrame:
    """``key, step, changed_step``: the step at which the value that holds now was first seen in a row."""
    w = W.partitionBy(key).orderBy(step)
    before = F.lag(value).over(w)
    change = F.when(F.row_number().over(w) == 1, F.col(step)).when(~before.eqNullSafe(F.col(value)), F.col(step))
    return states.withColumn("c", change).withColumn("changed_step", F.last("c", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).drop("c")


def streaks(rows: DataFrame, key: str, order: list[str], flag: str, least: int) -> DataFrame:
    """Runs of at least ``least`` successive rows on which ``flag`` holds: ``key, first, n`` (``first`` is the order value at the start)."""
    w = W.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("island", F.sum(F.when(F.col(flag), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = marked.where(flag).groupBy(key, "island").agg(F.min(order[0]).alias("first"), F.count("*").alias("n"))
    return runs.where(F.col("n") >= least).select(key, "first", "n")
