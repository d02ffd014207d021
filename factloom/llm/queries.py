"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import canonical, encode, knn, language, leak
from factloom.scratch import Scratch
from factloom.session import table


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "stored_fact").select(F.lit("fact").alias("grp"), "id", "embedding")
    entities = table(spark, sf_dir, "entity").where("kind IS NOT NULL")
    entities = entities.select(F.concat(F.lit("entity:"), "kind").alias("grp"), "id", "embedding")
    return facts.unionByName(entities)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of similar stored facts, and of similar entities of one kind."""
    return knn.similar_pairs(_records(spark, sf_dir))


def p1_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten closest vectors of every vector whose id is divisible by 20, by greedy search of the graph over all vectors."""
    scratch = Scratch(spark, "search")
    rows = table(spark, sf_dir, "embeddings").select(F.lit("all").alias("grp"), F.col("vec_id").cast("string").alias("id"), "embedding")
    coded = knn.index(rows, scratch, nearest=4)
    graph = knn.named(knn.neighbour_graph(coded, scratch, k=20, floor=-1.0, seed=10), coded)
    asked = coded.where("cast(id as bigint) % 20 = 0").select("grp", F.col("id").alias("q"), "code")
    found = knn.search(asked, coded, graph, scratch, k=11, beam=48).where("q <> v")
    return found.select(F.col("q").cast("bigint").alias("query_id"), F.col("v").cast("bigint").alias("vec_id"), "sim")


def p1_search_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten closest other facts, or entities of the kind, of every stored fact and entity whose id (a hexadecimal number) is divisible by 20.

    By greedy search of the graph over all of them. A row delivered twice counts once; rows with equal vectors are all listed.
    """
    scratch = Scratch(spark, "search")
    coded = knn.index(_records(spark, sf_dir), scratch, nearest=3)
    graph = knn.named(knn.neighbour_graph(coded, scratch, k=20, floor=-1.0, seed=20, follow=0.6), coded)
    asked = coded.where("cast(conv(substring(id, 3), 16, 10) as bigint) % 20 = 0").select("grp", F.col("id").alias("q"), "code")
    found = knn.closest_rows(knn.search(asked, coded, graph, scratch, k=11, beam=48), coded, 10)
    return found.select(F.col("q").alias("query_id"), F.col("v").alias("id"), "sim")


#: What the people and extractors of these tables type besides names.
_TYPED = canonical.Vocabulary(
    decoration=frozenset([*canonical.DECORATION, "thing", "old", "new", "item", "no", "nr"]),
    placeholders=frozenset([*canonical.PLACEHOLDERS, "test", "see", "above", "below", "same", "as", "before", "other"]),
)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog entry that every entity's name or aliases denote."""
    return canonical.map_to_list(table(spark, sf_dir, "entity"), table(spark, sf_dir, "entity_catalog"), vocabulary=_TYPED)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document under the public vocabulary byte_bpe_50k."""
    import public_tokenizers as public

    return encode.encode_corpus(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that carry twelve or more consecutive words of a held-out item."""
    return leak.leaked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_item").select("item_id", "text"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of documents whose label is missing or wrong or that mix languages."""
    return language.wrong_labels(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of every document and of each of its stretches."""
    return language.languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


QUERIES = {"p1_found": p1_found, "p1_search": p1_search, "p1_search_records": p1_search_records, "p2_found": p2_found, "p6_ids": p6_ids, "p7_found": p7_found, "p8_found": p8_found, "p8_segments": p8_segments}

ORACLE: dict[str, str] = {}
