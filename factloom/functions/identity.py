"""Identities by content hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import norm


def base_fact_id(statement: Column, entity: Column, attribute: Column, value: Column, unit: Column) -> Column:
    """A claim's identity is the claim itself, whatever sentence states it; without a claim it is the normalised statement."""
    number = norm.value_number(value)
    text = F.coalesce(norm.number_text(number), norm.value_text(value), F.lit(""))
    claim = F.concat_ws("|", F.lit("claim"), entity, attribute, text, F.coalesce(norm.unit(unit), F.lit("")))
    key = F.when(entity.isNotNull() & attribute.isNotNull(), claim).otherwise(F.concat(F.lit("||"), F.coalesce(norm.statement(statement), F.lit(""))))
    return F.concat(F.lit("f-"), F.substring(F.sha1(key), 1, 16))


def episode_id(base: Column, episode: Column) -> Column:
    return F.when(F.coalesce(episode, F.lit(0)) == 0, base).otherwise(F.concat(base, F.lit("."), episode.cast("string")))


def contradiction_id(a: Column, b: Column) -> Column:
    """The same for a pair in either order."""
    return F.concat(F.lit("x-"), F.substring(F.sha1(F.concat_ws("|", F.least(a, b), F.greatest(a, b))), 1, 16))


def entity_id(name: Column, kind: Column) -> Column:
    return F.concat(F.lit("e-"), F.substring(F.sha1(F.concat_ws(":", kind, norm.fold(name))), 1, 12))
