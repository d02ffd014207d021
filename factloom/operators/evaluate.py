"""Measures of answers against labelled truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole to six digits, null where the whole is 0."""
    return F.round(part / F.nullif(whole, F.lit(0)), 6)


def f1(precision: Column, recall: Column) -> Column:
    """Harmonic mean; where one side is undefined the other."""
    both = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    return F.round(F.when(precision.isNull(), recall).when(recall.isNull(), precision).otherwise(both), 6)


def precision_recall(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Micro-averaged precision, recall and F1 of boolean ``expected`` and ``returned`` per key."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    sums = rows.groupBy(*keys).agg(n(F.col("expected") & F.col("returned")).alias("hit"), n(F.col("returned")).alias("got"), n(F.col("expected")).alias("want"))
    sums = sums.withColumns({"precision": ratio(F.col("hit"), F.col("got")), "recall": ratio(F.col("hit"), F.col("want"))})
    return sums.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def wilson_lower(hits: Column, total: Column, z: float = 1.96) -> Column:
    """Lower end of the Wilson interval of a share; null for no trials."""
    n = total.cast("double")
    p = hits / F.nullif(n, F.lit(0.0))
    return F.round((p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n), 6)


#: A count drawn from the Poisson distribution of mean 1 is as many as of these shares the draw reaches.
_POISSON = (0.367879, 0.735759, 0.919699, 0.981012, 0.99634, 0.999406, 0.999917)


def bootstrap(pairs: DataFrame, key: str, a: str, b: str, rounds: int = 200, seed: str = "17") -> DataFrame:
    """95 % interval of the mean difference a - b over resampled keys: ``rounds, lo, hi``.

    ``pairs`` has one row per key. How often a key counts in a round is drawn (Poisson, mean 1) from a digest of seed, round and key, so any engine draws
    alike, and a round is a sum that every task makes of its own rows: nothing is joined, and one row a round and task is shuffled.
    """
    drawn = pairs.select(F.col(key).cast("string").alias("k"), (F.col(a) - F.col(b)).alias("d"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("r"))
    share = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("r").cast("string"), "k")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    weight = sum((F.when(F.col("u") >= p, 1).otherwise(0) for p in _POISSON[1:]), F.when(F.col("u") >= _POISSON[0], 1).otherwise(0))
    means = drawn.select("r", "d", share.alias("u")).select("r", "d", weight.alias("w")).groupBy("r").agg((F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("m"))
    q = lambda p: F.round(F.percentile("m", F.lit(p)), 6)
    return means.agg(F.count("*").alias("rounds"), q(0.025).alias("lo"), q(0.975).alias("hi"))
