"""Traversal of entity relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.scratch import Scratch


def reach(edges: DataFrame, start: DataFrame, depth: int, hubs: DataFrame | None = None) -> DataFrame:
    """``id, distance`` of nodes within ``depth`` undirected steps of ``start`` (``id``). Hubs may be a start but are never entered.

    Breadth first: each round joins the frontier with the edges and drops what was seen by an anti join; rounds are cut by written tables.
    """
    scratch = Scratch(edges.sparkSession, "reach")
    clean = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst")
    ends = F.inline(F.array(F.struct(F.col("src").alias("at"), F.col("dst").alias("id")), F.struct(F.col("dst").alias("at"), F.col("src").alias("id"))))
    both = clean.select(ends)  # the edges are read as they are, from either end; only what the frontier touches is shuffled and made distinct
    barred = scratch.save(hubs.select("id").distinct(), "hubs") if hubs is not None else None
    seen = scratch.save(start.select("id").distinct().withColumn("distance", F.lit(0)), "seen")
    front = seen
    for step in range(1, depth + 1):
        found = both.join(front.select(F.col("id").alias("at")), "at").select("id").distinct().join(seen.select("id"), "id", "left_anti")
        if barred is not None:
            found = found.join(barred, "id", "left_anti")
        front = scratch.save(found.withColumn("distance", F.lit(step)), "front")
        if front.isEmpty():
            break
        seen = scratch.save(seen.unionByName(front), "seen")
    return seen


def relations(members: DataFrame, hub_kinds: tuple[str, ...] = ("service", "team"), most: int = 200) -> DataFrame:
    """Relations among entities named by one fact (``fact_id, entity, kind, position``): ``src, dst, kind``.

    Every entity that is no hub is ``part_of`` every hub of the fact, and ``related`` to every other one, the one of smaller position first (then of
    smaller id). Set semantics, no relation of a node to itself; rows without fact or entity take no part. A fact that names more than ``most`` entities
    which are no hubs stands for itself: each of them is ``named_by`` the fact, which says the same in as many rows as it has entities.
    """
    rows = members.where("fact_id IS NOT NULL AND entity IS NOT NULL").select(F.col("fact_id").cast("string").alias("fact_id"), "entity", F.coalesce(F.col("kind").isin(*hub_kinds), F.lit(False)).alias("hub"), "position")
    once = rows.groupBy("fact_id", "entity", "hub").agg(F.min("position").alias("position"))
    sizes = once.where("NOT hub").groupBy("fact_id").count()
    large = sizes.where(F.col("count") > most).select("fact_id")
    plain = once.where("NOT hub").select("fact_id", F.col("entity").alias("src"), F.struct("position", "entity").alias("at"))
    part = plain.join(once.where("hub").select("fact_id", F.col("entity").alias("dst")), "fact_id").select("src", "dst", F.lit("part_of").alias("kind"))
    few = plain.join(large, "fact_id", "left_anti")
    other = few.select("fact_id", F.col("src").alias("dst"), F.col("at").alias("after"))
    beside = few.join(other, "fact_id").where("at < after").select("src", "dst", F.lit("related").alias("kind"))
    named = plain.join(large, "fact_id", "left_semi").select("src", F.col("fact_id").alias("dst"), F.lit("named_by").alias("kind"))
    return part.unionByName(beside).unionByName(named).where("src <> dst").distinct()
