"""Versions of changing attributes with the period each was valid (gaps and islands)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.scratch import Scratch

#: Open ends sort after every instant.
_OPEN = 2**63 - 1


def versions(obs: DataFrame, hot_rows: int = 200_000, slices: int = 200) -> DataFrame:
    """Version history of every claim from dated observations.

    ``obs`` needs ``id, base_id, claim_entity, claim_attribute, valid_at, invalid_at, created_at, expired_at``; other
    columns are ignored. The result is ``version_id, valid_us, invalid_us, superseded_by``. ``base_id`` stands for one
    entity, attribute and value.

    Method: over all observations, the hash of the attribute's value (``base_id``) is compared with that of the row
    before it; a change, or a gap between the two periods, starts an island; a running sum numbers the islands; minimum
    start and last end give the validity.

    Defined results: rows without entity, attribute, id, base_id or ``valid_at``, rows with ``expired_at`` and rows whose
    ``invalid_at`` is not after ``valid_at`` do not count. Of rows with equal start the latest ``created_at`` counts (null
    is earliest), then the largest id; a row delivered twice therefore counts once. An open end is -1; an empty table gives
    an empty result.

    Ties are removed by a map-side aggregate before any sort. A claim with more than ``hot_rows`` rows is cut into up to
    ``slices`` time slices of about equal size, each sorted by itself; what a row must know of the slice before or after
    it comes from one summary row per slice. So no task holds a whole hot claim, and the result is the same.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = obs.where(
        F.col("id").isNotNull()
        & F.col("base_id").isNotNull()
        & F.col("claim_entity").isNotNull()
        & F.col("claim_attribute").isNotNull()
        & F.col("valid_at").isNotNull()
        & F.col("expired_at").isNull()
        & (F.col("invalid_at").isNull() | (F.col("invalid_at") > F.col("valid_at")))
    ).select(
        F.col("claim_entity").alias("ent"),
        F.col("claim_attribute").alias("att"),
        micros("valid_at").alias("start"),
        F.struct(
            F.coalesce(micros("created_at"), F.lit(-(2**63))).alias("created"),
            F.col("id").alias("id"),
            F.col("base_id").alias("base"),
            F.coalesce(micros("invalid_at"), F.lit(_OPEN)).alias("stop"),
        ).alias("r"),
    )
    hot = rows.groupBy("ent", "att").count().where(F.col("count") > hot_rows).select("ent", "att")
    cut = not hot.isEmpty()
    counting = rows.groupBy("ent", "att", "start").agg(F.max("r").alias("r")).select("ent", "att", "start", "r.base", "r.stop")
    if cut:
        scratch = Scratch(obs.sparkSession, "history")
        counting = scratch.save(_sliced(counting, scratch.save(hot, "hot"), slices), "counting")
    else:
        counting = counting.withColumn("slice", F.lit(0))

    inner = W.partitionBy("ent", "att", "slice").orderBy("start")
    if cut:
        per = counting.where("slice > 0").groupBy("ent", "att", "slice").agg(
            F.min("start").alias("first"), F.max(F.struct("start", "base", "stop")).alias("last")
        )
        order = W.partitionBy("ent", "att").orderBy("slice")
        per = per.select(
            "ent", "att", "slice", F.lead("first").over(order).alias("after"), F.lag("last.base").over(order).alias("base_before"),
            F.least(F.lag("last.stop").over(order), "first").alias("stop_before"),
        )
        counting = counting.join(per, ["ent", "att", "slice"], "left")
    else:
        counting = counting.withColumns({"after": F.lit(None).cast("bigint"), "base_before": F.lit(None).cast("string"), "stop_before": F.lit(None).cast("bigint")})
    periods = counting.withColumn("stop", F.least("stop", F.coalesce(F.lead("start").over(inner), F.col("after"), F.lit(_OPEN))))
    first = F.row_number().over(inner) == 1
    base_before = F.when(first, F.col("base_before")).otherwise(F.lag("base").over(inner))
    code_before = F.when(first, F.xxhash64("base_before")).otherwise(F.lag(F.xxhash64("base")).over(inner))
    stop_before = F.when(first, F.col("stop_before")).otherwise(F.lag("stop").over(inner))
    same = (code_before == F.xxhash64("base")) & (base_before == F.col("base")) & (stop_before == F.col("start"))
    marked = periods.withColumn("fresh", F.when(same, 0).otherwise(1)).withColumn(
        "island", F.sum("fresh").over(inner.rowsBetween(W.unboundedPreceding, 0))
    )
    if cut:
        marked = scratch.save(marked, "marked")
        order = W.partitionBy("ent", "att").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
        before = marked.where("slice > 0").groupBy("ent", "att", "slice").agg(F.sum("fresh").alias("n"))
        before = before.select("ent", "att", "slice", F.sum("n").over(order).alias("earlier"))
        marked = marked.join(before, ["ent", "att", "slice"], "left").withColumn("island", F.col("island") + F.coalesce("earlier", F.lit(0)))
    islands = marked.groupBy("ent", "att", "island").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.max("base").alias("base"), F.min("slice").alias("slice")
    )
    own = F.row_number().over(W.partitionBy("ent", "att", "base", "slice").orderBy("start")) - 1
    if cut:
        # A value that a hot claim takes again and again is numbered slice by slice, from the count of the slices before.
        islands = scratch.save(islands, "islands")
        per = islands.where("slice > 0").groupBy("ent", "att", "base", "slice").agg(F.count("*").alias("k"))
        order = W.partitionBy("ent", "att", "base").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
        per = per.select("ent", "att", "base", "slice", F.sum("k").over(order).alias("before"))
        islands = islands.join(per, ["ent", "att", "base", "slice"], "left")
        own = own + F.coalesce("before", F.lit(0))
    numbered = islands.withColumn("n", own).withColumn(
        "version_id", F.when(F.col("n") == 0, F.col("base")).otherwise(F.concat_ws(".", "base", F.col("n").cast("string")))
    )
    if cut:
        numbered = scratch.save(numbered, "numbered")
        after = numbered.select("ent", "att", (F.col("island") - 1).alias("island"), F.col("start").alias("next_start"), F.col("version_id").alias("next_id"))
        numbered = numbered.join(after, ["ent", "att", "island"], "left")
    else:
        by_start = W.partitionBy("ent", "att").orderBy("start")
        numbered = numbered.withColumns({"next_start": F.lead("start").over(by_start), "next_id": F.lead("version_id").over(by_start)})
    return numbered.select(
        "version_id",
        F.col("start").alias("valid_us"),
        F.when(F.col("stop") == _OPEN, F.lit(-1)).otherwise(F.col("stop")).alias("invalid_us"),
        F.when(F.col("next_start") == F.col("stop"), F.col("next_id")).otherwise(F.lit("")).alias("superseded_by"),
    )


def _sliced(counting: DataFrame, hot: DataFrame, slices: int) -> DataFrame:
    """Number the time slices of hot claims from 1; all other rows are in slice 0."""
    shares = [i / slices for i in range(1, slices)]
    cuts = counting.join(hot, ["ent", "att"]).groupBy("ent", "att").agg(F.percentile_approx("start", shares, 10_000).alias("cuts"))
    where = F.size(F.filter("cuts", lambda c: c <= F.col("start"))) + 1
    return counting.join(cuts, ["ent", "att"], "left").withColumn("slice", F.when(F.col("cuts").isNull(), 0).otherwise(where)).drop("cuts")
