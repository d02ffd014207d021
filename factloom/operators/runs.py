"""Tiers lifted and demoted by test runs. ``runs`` has ``node, step, attempt, outcome``, one row per attempt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_step(runs: DataFrame) -> DataFrame:
    """``node, step, outcome, flaky``: the latest attempt decides; flaky where attempts both passed and failed."""
    passed, failed = F.max(F.col("outcome") == "passed"), F.max(F.col("outcome") == "failed")
    return runs.groupBy("node", "step").agg(F.max_by("outcome", "attempt").alias("outcome"), (passed & failed).alias("flaky"), passed.alias("any_pass"))


def demotion(runs: DataFrame) -> DataFrame:
    """``node, step, opened_step`` of steps at which a failure stands: a failure opens, a pass closes, skips and flaky steps inherit."""
    steps = by_step(runs)
    verdict = F.when(~F.col("flaky") & F.col("outcome").isin("passed", "failed"), F.col("outcome"))
    w = W.partitionBy("node").orderBy("step")
    to_now = w.rowsBetween(W.unboundedPreceding, 0)
    steps = steps.withColumn("verdict", verdict).withColumn("state", F.last("verdict", ignorenulls=True).over(to_now))
    passes = F.sum(F.when(F.col("verdict") == "passed", 1).otherwise(0)).over(to_now)
    steps = steps.withColumn("island", passes)
    first = F.min(F.when(F.col("verdict") == "failed", F.col("step"))).over(W.partitionBy("node", "island"))
    return steps.withColumn("opened_step", first).where("state = 'failed'").select("node", "step", "opened_step")


def lifted(runs: DataFrame, changes: DataFrame, target: int) -> DataFrame:
    """``node, pass_step`` of nodes whose latest pass at or before ``target`` still counts: no change (``node, step``) after it up to the target.

    The latest pass is a map-side maximum; the changes are a left anti join on it.
    """
    last = runs.where((F.col("outcome") == "passed") & (F.col("step") <= target)).groupBy("node").agg(F.max("step").alias("pass_step"))
    later = changes.where(F.col("step") <= target).groupBy("node").agg(F.max("step").alias("changed"))
    return last.join(later, "node", "left").where("changed IS NULL OR changed <= pass_step").select("node", "pass_step")


def unexpected(expected: DataFrame, reported: DataFrame) -> DataFrame:
    """Outcomes that differ from what is expected (``node, step, expected``) or that nobody reported."""
    return expected.join(by_step(reported), ["node", "step"], "left").where(~F.col("expected").eqNullSafe(F.col("outcome"))).select("node", "step", "expected", "outcome")
