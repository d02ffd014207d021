"""Names resolved to entities by exact, alias and folded forms, and mentions of entities in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import norm


def resolve(names: DataFrame, entities: DataFrame) -> DataFrame:
    """``name, kind, entity_id, how`` of distinct ``names`` (``name, kind``): by name, else alias, else folded form, ignoring case.

    Of several entities the one of the same kind (folded forms only), then the smallest id. Unresolved names keep a null id and ``how`` 'new'.
    Each pass is one equi-join against a table reduced to one row per key.
    """
    asked = names.where("name IS NOT NULL AND trim(name) <> ''").select("name", "kind").distinct()
    asked = asked.withColumns({"low": F.lower(F.trim("name")), "folded": norm.fold(F.col("name"))})
    by_name = entities.groupBy(F.lower("name").alias("low")).agg(F.min("id").alias("by_name"))
    aliases = entities.select("id", F.explode("aliases").alias("alias")).where("alias IS NOT NULL")
    by_alias = aliases.groupBy(F.lower("alias").alias("low")).agg(F.min("id").alias("by_alias"))
    forms = entities.select("id", "kind", norm.fold(F.col("name")).alias("folded")).unionByName(
        aliases.join(entities.select("id", "kind"), "id").select("id", "kind", norm.fold(F.col("alias")).alias("folded"))
    )
    same = forms.groupBy("folded", "kind").agg(F.min("id").alias("by_kind"))
    any_kind = forms.groupBy("folded").agg(F.min("id").alias("by_fold"))
    out = asked.join(by_name, "low", "left").join(by_alias, "low", "left").join(same, ["folded", "kind"], "left").join(any_kind, "folded", "left")
    how = F.when(F.col("by_name").isNotNull(), "name").when(F.col("by_alias").isNotNull(), "alias").when(F.col("by_fold").isNotNull(), "folded").otherwise("new")
    return out.select("name", "kind", F.coalesce("by_name", "by_alias", "by_kind", "by_fold").alias("entity_id"), how.alias("how"))


def mentions(docs: DataFrame, labels: DataFrame, id: str, text: str, longest: int = 4) -> DataFrame:
    """``id, entity_id`` of entities whose label occurs in a text as a run of up to ``longest`` words, compared folded (four letters or more).

    Runs of words are made by higher-order functions and met with the labels by one equi-join on the folded form.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_./\-]+"), F.lit(0))
    rows = docs.select(id, words.alias("w")).where(F.size("w") > 0)
    run = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.lit(longest)),
            lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), "")),
        )
    )
    runs = rows.select(id, F.explode(F.array_distinct(run)).alias("run")).select(id, norm.fold(F.col("run")).alias("folded"))
    keys = labels.select(F.col("id").alias("entity_id"), norm.fold(F.col("label")).alias("folded")).where(F.length("folded") >= 4).distinct()
    return runs.join(keys, "folded").select(id, "entity_id").distinct()
