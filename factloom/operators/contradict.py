"""Contradictions between claims, and pages that have gone stale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import identity, norm


_LAST = 2**62


def _held(facts: DataFrame) -> DataFrame:
    """Per entity, attribute, value and unit: the unbroken times it was held (``start, stop``), from the facts' periods, with the smallest id and the ``best`` fact of the value.

    Repeats are folded before anything is sorted.
    """
    key = ["entity", "attribute", "value", "unit"]
    rank = F.struct(norm.tier_rank("tier").alias("rank"), F.coalesce("valid_us", F.lit(-_LAST)).alias("v"), F.coalesce("created_us", F.lit(-_LAST)).alias("c"))
    ends = facts.groupBy(*key, F.coalesce("valid_us", F.lit(-_LAST)).alias("start")).agg(
        F.max(F.coalesce("invalid_us", F.lit(_LAST))).alias("stop"), F.min("id").alias("name"), F.max(rank).alias("best")
    )
    w = W.partitionBy(*key).orderBy("start")
    real = F.when(F.col("stop") > F.col("start"), F.col("stop"))  # an empty period names its value but holds nothing
    before = F.max(real).over(w.rowsBetween(W.unboundedPreceding, -1))
    whole = W.partitionBy(*key)
    marked = ends.withColumns({"name": F.min("name").over(whole), "best": F.max("best").over(whole), "fresh": F.when(before >= F.col("start"), 0).otherwise(1)})
    marked = marked.withColumn("island", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.where("stop > start").groupBy(*key, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.first("name").alias("name"), F.first("best").alias("best"))


def claim_contradictions(facts: DataFrame, slices: int = 32, least: int = 64) -> DataFrame:
    """Pairs of different values of one entity and attribute with compatible units that were held at one time: ``id, a, b, winner, opened_us, entity, attribute``.

    ``facts`` has ``id, entity, attribute, value, unit, tier, valid_us, invalid_us, created_us, expired_us``; expired ones and those without a value do not count.
    Facts of one value and unit are a class, named by its smallest id: a and b are such names, a < b, and :func:`claim_classes` has the members.
    A missing unit is compatible with any, a missing start is the beginning of time, a missing end is open. Winner: tier, then later
    start, then later storing (b on a tie), of each class's best fact. ``opened_us`` is when the two values first were held together.

    What is compared is never facts but the unbroken times of values, and these only within slices of time: a key's times are cut at up to
    ``slices`` quantiles of their starts (``least`` or more in each), and a long one is seen once in every slice that it covers. So a key with a third of all facts costs
    what its values and their changes cost, and its slices are apart.
    """
    live = facts.where("expired_us IS NULL AND value IS NOT NULL")
    key = ["entity", "attribute"]
    held = _held(live)
    cuts = held.groupBy(*key).agg(F.percentile_approx("start", [n / slices for n in range(1, slices)], 200).alias("cuts"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    # A slice has 64 times or more: most keys have but one.
    step = F.ceil(F.lit(slices) / F.greatest(F.lit(1), F.floor(F.col("n") / least)))
    cuts = cuts.withColumn("cuts", F.filter("cuts", lambda _, i: (F.col("n") >= 2 * least) & ((i + 1) % step == 0)))
    slice_ = lambda t: F.size(F.filter("cuts", lambda c: c <= t))
    held = held.join(cuts.select(*key, "cuts"), key)
    held = held.select(*key, "value", "unit", "start", "stop", "name", "best", F.explode(F.sequence(slice_(F.col("start")), slice_(F.col("stop") - 1))).alias("slice"))
    columns = ("value", "unit", "start", "stop", "name", "best")
    a, b = (held.select(*key, "slice", *[F.col(c).alias(f"{side}_{c}") for c in columns]) for side in "ab")
    met = a.join(b, [*key, "slice"]).where("a_name < b_name AND a_value <> b_value AND (a_unit IS NULL OR b_unit IS NULL OR a_unit = b_unit) AND a_start < b_stop AND b_start < a_stop")
    met = met.groupBy(*key, F.col("a_name").alias("a"), F.col("b_name").alias("b")).agg(F.min(F.greatest("a_start", "b_start")).alias("opened_us"), F.first("a_best").alias("x"), F.first("b_best").alias("y"))
    c = F.col
    opened = F.when(c("opened_us") > -_LAST, c("opened_us"))
    return met.select(identity.contradiction_id(c("a"), c("b")).alias("id"), "a", "b", F.when(c("x") > c("y"), c("a")).otherwise(c("b")).alias("winner"), opened.alias("opened_us"), *key)


def claim_classes(facts: DataFrame) -> DataFrame:
    """``id, class``: every unexpired fact with a value, and the name (smallest id) of those of its entity, attribute, value and unit."""
    live = facts.where("expired_us IS NULL AND value IS NOT NULL").select("id", "entity", "attribute", "value", F.coalesce("unit", F.lit("")).alias("unit"))
    names = live.groupBy("entity", "attribute", "value", "unit").agg(F.min("id").alias("class"))
    return live.join(names, ["entity", "attribute", "value", "unit"]).select("id", "class")


def stale_claims(facts: DataFrame) -> DataFrame:
    """Open documented facts that a connector fact of the same key contradicts from later on: ``id, because, changed_us``.

    Of several such facts the latest counts, then the smallest id. Connector facts are first reduced to the latest of each value and unit, so a
    page is compared with the values of its key and not with their facts.
    """
    opened = facts.where("invalid_us IS NULL AND expired_us IS NULL AND value IS NOT NULL")
    d = opened.where("tier = 'documented'").select("id", "entity", "attribute", F.col("value").alias("n"), F.col("unit").alias("u"), F.col("valid_us").alias("v"))
    k = opened.where(F.col("tier").isin(*norm.CONNECTOR_TIERS) & F.col("valid_us").isNotNull()).groupBy("entity", "attribute", "value", "unit", "valid_us").agg(F.min("id").alias("because"))
    k = k.groupBy("entity", "attribute", "value", "unit").agg(F.max(F.struct("valid_us", "because")).alias("k"))
    hit = d.join(k, ["entity", "attribute"]).where("(u IS NULL OR unit IS NULL OR u = unit) AND n <> value").where(norm.later(F.col("k.valid_us"), F.col("v")))
    last = hit.groupBy("id").agg(F.max("k.valid_us").alias("changed_us"), F.collect_set("k").alias("ks"))
    because = F.array_min(F.transform(F.filter("ks", lambda k: k["valid_us"] == F.col("changed_us")), lambda k: k["because"]))
    return last.select("id", because.alias("because"), "changed_us")


def stale_pages(documented: DataFrame, code: DataFrame) -> DataFrame:
    """Documented facts (``id, entity, number, page_us``) whose page is older than the last code change about the same entity with another number.

    ``code`` has ``entity, number, code_us``. For each entity only the latest change and the latest one with a different number are
    kept: whichever number a page states, the latest change with another number is one of these two, so nothing is compared in pairs.
    """
    latest = code.where("entity IS NOT NULL AND number IS NOT NULL AND code_us IS NOT NULL").groupBy("entity", "number").agg(F.max("code_us").alias("code_us"))
    first = latest.groupBy("entity").agg(F.max(F.struct("code_us", "number")).alias("m1"))
    second = latest.join(first, "entity").where("number <> m1.number").groupBy("entity").agg(F.max(F.struct("code_us", "number")).alias("m2"))
    both = first.join(second, "entity", "left")
    changed = F.when(F.col("number") != F.col("m1.number"), F.col("m1.code_us")).otherwise(F.col("m2.code_us"))
    return documented.where("number IS NOT NULL").join(both, "entity").withColumn("changed_us", changed).where(norm.later(F.col("changed_us"), F.col("page_us"))).select("id", "changed_us")
