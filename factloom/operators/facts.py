"""Filters, ranking, merging and identity of facts. Every function takes and returns DataFrames; nulls follow the rules of each docstring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import norm


def live(facts: DataFrame, as_of: Column | None = None, created: str = "created_at", expired: str = "expired_at") -> DataFrame:
    """Facts present in stored time: now those never expired, else those created by ``as_of`` and not expired by then."""
    if as_of is None:
        return facts.where(F.col(expired).isNull())
    return facts.where((F.col(created).isNull() | (F.col(created) <= as_of)) & (F.col(expired).isNull() | (F.col(expired) > as_of)))


def held_after(facts: DataFrame, since: Column, invalid: str = "invalid_at") -> DataFrame:
    """Facts that held at some time after ``since``: open ones and those that ended later (exclusive)."""
    return facts.where(F.col(invalid).isNull() | (F.col(invalid) > since))


def since(facts: DataFrame, start: Column, valid: str = "valid_at") -> DataFrame:
    """Facts valid from ``start`` on, inclusive."""
    return facts.where(F.col(valid) >= start)


def citing(facts: DataFrame, documents: DataFrame, key: str = "document_id") -> DataFrame:
    """Facts that cite one of ``documents`` (column ``id``)."""
    return facts.join(documents.select(F.col("id").alias(key)).distinct(), key, "left_semi")


def rank_within(facts: DataFrame, key: str, k: int, valid: str = "valid_at") -> DataFrame:
    """The ``k`` first facts of every key by tier, then the later start (missing last), then id, with their ``rank``.

    The window limit is applied before the shuffle too, so a hot key sends k rows per task; a row delivered twice has one rank.
    """
    order = W.partitionBy(key).orderBy(norm.tier_rank("tier").desc(), F.col(valid).desc_nulls_last(), "id")
    return facts.where(F.col(key).isNotNull()).withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k).distinct()


def page(facts: DataFrame, offset: int = 0, limit: int = 20, valid: str = "valid_at") -> DataFrame:
    """One page of the ranked facts; ``limit`` 1 to 100, ``offset`` not negative."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be 1 to 100 and offset at least 0")
    return facts.orderBy(norm.tier_rank("tier").desc(), F.col(valid).desc_nulls_last(), "id").offset(offset).limit(limit)


def latest_episode(facts: DataFrame) -> DataFrame:
    """The row of the highest episode of every base id (missing counts as 0; of equal ones the largest id)."""
    episode = F.coalesce("episode", F.lit(0))
    return facts.where("base_id IS NOT NULL").groupBy("base_id").agg(F.max(F.struct(episode.alias("episode"), "id")).alias("m")).select("base_id", "m.episode", "m.id")


def merge(facts: DataFrame) -> DataFrame:
    """One row per base id from its observations in the order of storing (``created_at``, then id).

    Earliest start, highest confidence, number of different documents, first source key. Tier: the first observation's; a test
    observation replaces it, another connector observation raises it, a page never changes it. Written as aggregates
    (the last replacing observation, then the highest tier after it), so no group is collected whatever its size.
    """
    order = F.struct(F.coalesce("created_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("at"), "id")
    rows = facts.where("base_id IS NOT NULL").select(
        "base_id", order.alias("ord"), norm.tier_rank("tier").alias("rank"), "valid_at", "confidence", "document_id", "source_key"
    )
    connector, test = F.col("rank") >= 2, F.coalesce(F.col("source_key").startswith("test:"), F.lit(False))
    sums = rows.groupBy("base_id").agg(
        F.min("valid_at").alias("valid_at"),
        F.max(F.when(~F.isnan("confidence"), F.col("confidence"))).alias("confidence"),
        F.countDistinct("document_id").alias("n_documents"),
        F.min(F.when(F.col("source_key").isNotNull(), F.struct("ord", "source_key"))).alias("source"),
        F.min(F.struct("ord", "rank")).alias("first"),
        F.max(F.when(connector & test, F.struct("ord", "rank"))).alias("reset"),
        F.count("*").alias("n"),
    )
    base = F.greatest(F.col("first"), F.coalesce("reset", "first"))
    sums = sums.withColumn("from", base)
    raised = rows.where(connector & ~test).join(sums.select("base_id", "from"), "base_id").where(F.col("ord") > F.col("from.ord"))
    raised = raised.groupBy("base_id").agg(F.max("rank").alias("raised"))
    names = {v: k for k, v in norm.TIER_RANK.items()}
    final = F.greatest("from.rank", F.coalesce("raised", F.lit(0)))
    tier = F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), final)
    return sums.join(raised, "base_id", "left").select("base_id", tier.alias("tier"), "valid_at", "confidence", "n_documents", F.col("source.source_key").alias("source_key"), "n")


def winners(facts: DataFrame, keys: list[str], valid: str, created: str) -> DataFrame:
    """The fact of every key that wins: tier, then later start, then later storing, then the larger id; one map-side aggregate."""
    best = F.max(F.struct(norm.tier_rank("tier").alias("rank"), F.coalesce(valid, F.lit(-(2**62))).alias("v"), F.coalesce(created, F.lit(-(2**62))).alias("c"), "id", "tier"))
    return facts.groupBy(*keys).agg(best.alias("w")).select(*keys, F.col("w.id").alias("id"), F.col("w.tier").alias("tier"))


def superseded(edges: DataFrame) -> DataFrame:
    """Folded supersessions ``old, new, at``: the earliest end, and the successor named first; a fact never supersedes itself."""
    real = edges.where("old <> new")
    return real.groupBy("old").agg(F.min("at").alias("invalid_us"), F.min(F.struct("at", "new")).alias("m")).select("old", "invalid_us", F.col("m.new").alias("superseded_by"))


def closed_by_conflict(facts: DataFrame, key: list[str]) -> DataFrame:
    """``id, superseded_by, closed_us``: every fact (``id, value, valid_us`` and the columns of ``key``) with the first later start of its key that has another
    value, and the smallest id with another value there. Starts of equal single value form islands, so nothing is compared in pairs.
    """
    rows = facts.where("value IS NOT NULL AND valid_us IS NOT NULL").select("id", *key, "value", "valid_us")
    w = W.partitionBy(*key).orderBy("valid_us")
    starts = rows.groupBy(*key, "valid_us").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    same = (F.col("lo") == F.col("hi")) & (F.lag("lo").over(w) == F.col("lo")) & (F.lag("hi").over(w) == F.col("lo"))
    starts = starts.withColumn("first", F.when(~F.coalesce(same, F.lit(False)), F.col("valid_us")))
    after = F.min("first").over(w.rowsBetween(1, W.unboundedFollowing))
    # The start of the next island, seen from each start, and from the start that follows it.
    starts = starts.withColumn("after", after)
    ahead = [F.lead(c).over(w).alias(f"next_{c}") for c in ("valid_us", "lo", "hi", "after")]
    open_ = rows.join(starts.select(*key, "valid_us", *ahead), [*key, "valid_us"])
    repeats = (F.col("next_lo") == F.col("value")) & (F.col("next_hi") == F.col("value"))
    open_ = open_.withColumn("closed_us", F.when(repeats, F.col("next_after")).otherwise(F.col("next_valid_us"))).where("closed_us IS NOT NULL")
    least = rows.groupBy(*key, F.col("valid_us").alias("closed_us"), F.col("value").alias("other")).agg(F.min("id").alias("by"))
    hit = open_.select("id", *key, "value", "closed_us").join(least, [*key, "closed_us"]).where("other <> value")
    return hit.groupBy("id", "closed_us").agg(F.min("by").alias("superseded_by")).select("id", "superseded_by", "closed_us")
