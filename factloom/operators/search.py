"""Text search by term overlap, vector search, their fusion, and answers drawn from both."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import norm


def _asked_terms(queries: DataFrame) -> DataFrame:
    """``q, term, size``: the distinct terms of every query (``q, text``), and how many there are."""
    asked = queries.where("q IS NOT NULL").select("q", F.array_distinct(norm.terms(F.col("text"))).alias("ts")).where(F.size("ts") > 0)
    return asked.select("q", F.size("ts").alias("size"), F.explode("ts").alias("term")).distinct()


def _top(scored: DataFrame, limit: int, id: str) -> DataFrame:
    """The ``limit`` best of every query, ties by id; limited before the shuffle too."""
    order = W.partitionBy("q").orderBy(F.desc("score"), id)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def text_search(docs: DataFrame, queries: DataFrame, id: str, text: str, limit: int = 20, idf: bool = False) -> DataFrame:
    """For every query (``q, text``) the documents with the largest share of its terms: ``q, id, score, rank``, ties by id.

    With ``idf`` a term weighs its inverse frequency over all documents, and the score is the sum of what is shared. Queries without terms find nothing;
    null texts are not found. Documents meet queries by an equi-join on terms; terms of a document stay in its task, so with few queries
    (broadcast by their size) its scores are summed where it was read.
    """
    asked = _asked_terms(queries)
    words = docs.where(F.col(text).isNotNull()).select(id, F.explode(F.array_distinct(norm.terms(F.col(text)))).alias("term"))
    if idf:
        total = docs.where(F.col(text).isNotNull()).select(F.count("*")).scalar()
        hits = words.join(asked.select("term").distinct(), "term", "left_semi")
        df = hits.groupBy("term").agg(F.count("*").alias("df")).select("term", F.log((total + 1) / F.col("df")).alias("w"))
        score = F.sum("w")
        scored = words.join(asked.join(df, "term"), "term").groupBy("q", id).agg(F.round(score, 6).alias("score"))
    else:
        scored = words.join(asked, "term").groupBy("q", id).agg(F.round(F.count("*") / F.max("size"), 6).alias("score"))
    return _top(scored, limit, id).select("q", id, "score", "rank")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


#: Query vectors of up to this many numbers are broadcast at once; more are searched in blocks of these.
BLOCK_NUMBERS = 8_000_000


def vector_search(vectors: DataFrame, queries: DataFrame, id: str, embedding: str, limit: int = 20, floor: float | None = None, group: str | None = None, within: str | None = None) -> DataFrame:
    """For every query (``q, embedding``) the vectors of largest cosine: ``q, id, score, rank``, ties by id; with ``group`` the best of every group, with ``within`` only
    vectors that have the query's value in that column.

    Cosines are rounded to six digits, 0 where a norm is 0; vectors of another dimension, null or empty ones or with null numbers are not compared. Queries
    are taken in blocks of a bounded size, each broadcast to all vectors; a batch of rows is one matrix product, of which every task keeps its best.
    """
    spark = vectors.sparkSession
    whole = lambda df: df.where((F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull()))
    asked = whole(queries.where("q IS NOT NULL").select("q", (F.col(within).cast("string") if within else F.lit("")).alias("_w"), F.col("embedding").cast("array<double>").alias("embedding")))
    width = asked.agg(F.max(F.size("embedding")), F.count("*")).first()
    blocks = max(1, -(-(width[0] or 0) * width[1] // BLOCK_NUMBERS))
    kept = [id, *([group] if group else [])]
    rows = whole(vectors.where(F.col(id).isNotNull()).select(*kept, (F.col(within).cast("string") if within else F.lit("")).alias("_w"), F.col(embedding).cast("array<double>").alias("embedding")))
    kinds = dict(rows.dtypes) | dict(asked.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ["q", *kept]) + ", score double"
    found = None
    for n in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == n).collect()
        by: dict[tuple, list] = {}
        for r in part:
            by.setdefault((r["_w"], len(r["embedding"])), []).append(r)
        table = spark.sparkContext.broadcast({d: (np.array([r["q"] for r in rs], object), np.array([r["embedding"] for r in rs])) for d, rs in by.items()})

        def work(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            unit = lambda m: m / np.maximum(np.sqrt(np.einsum("ij,ij->i", m, m)), 1e-300)[:, None]
            for batch in batches:
                lists, places = batch.column(len(kept) + 1), batch.column(len(kept)).to_pylist()
                lengths, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
                starts = np.cumsum(lengths) - lengths
                at_: dict[tuple, list[int]] = {}
                for n_, key in enumerate(zip(places, lengths.tolist())):
                    at_.setdefault(key, []).append(n_)
                for key, found_ in at_.items():
                    if key not in table.value:
                        continue
                    names, matrix = table.value[key]
                    dim, at = key[1], np.array(found_)
                    sims = np.round(unit(matrix) @ unit(flat[starts[at][:, None] + np.arange(dim)]).T, 6) + 0.0
                    if group is None and len(at) > limit:
                        least = np.partition(sims, len(at) - limit, axis=1)[:, len(at) - limit]
                        a, b = np.nonzero(sims >= least[:, None])
                    else:
                        a, b = np.nonzero(sims >= -2)
                    out = {"q": pa.array(names[a].tolist())} | {c: batch.column(k).take(pa.array(at[b])) for k, c in enumerate(kept)} | {"score": pa.array(sims[a, b])}
                    yield pa.RecordBatch.from_pydict(out)

        near = rows.mapInArrow(work, schema)
        found = near if found is None else found.unionByName(near)
    if floor is not None:
        found = found.where(F.col("score") >= floor)
    if group is None:
        return _top(found, limit, id).select("q", id, "score", "rank")
    order = W.partitionBy("q", group).orderBy(F.desc("score"), id)
    return found.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("q", group, id, "score")


def fuse(lists: list[DataFrame], id: str, k: int = 60, limit: int = 10) -> DataFrame:
    """Reciprocal rank fusion of result lists (``q, id, rank``) of every query: the sum of 1 / (k + rank), as ``q, id, score``."""
    parts = [hits.select("q", id, (F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("s")) for hits in lists]
    scored = reduce(DataFrame.unionByName, parts).groupBy("q", id).agg(F.round(F.sum("s"), 9).alias("score"))
    return _top(scored, limit, id).select("q", id, "score")


def sparse_search(docs: DataFrame, queries: DataFrame, id: str, limit: int = 20, floor: float | None = None) -> DataFrame:
    """As :func:`vector_search` for sparse vectors: ``docs`` (``id, bucket, weight``) and ``queries`` (``q, bucket, weight``) of unit length meet bucket by bucket."""
    asked = queries.select("q", "bucket", F.col("weight").alias("qw"))
    scored = docs.join(asked, "bucket").groupBy("q", id).agg(F.round(F.sum(F.col("weight") * F.col("qw")), 5).alias("score"))
    if floor is not None:
        scored = scored.where(F.col("score") >= floor)
    return _top(scored, limit, id).select("q", id, "score", "rank")


def best_citations(citations: DataFrame, cap: int = 3) -> DataFrame:
    """Up to ``cap`` citations per fact (``fact_id, tier, document, position``): by what proves the tier, the latest first, one per document before others.

    ``fact_id, place, document``. Executed facts lead with runs, code facts with code, documented ones with pages.
    """
    kind = norm.document_kind(F.col("document"))
    grade = (
        F.when(F.col("tier") == "executed", F.when(kind == "run", 0.0).when(kind == "code", 1.0).otherwise(0.5))
        .when(F.col("tier") == "code", F.when(kind == "code", 0.0).when(kind == "run", 2.0).otherwise(0.5))
        .when(F.col("tier") == "documented", F.when(kind == "code", 1.0).when(kind == "run", 2.0).otherwise(0.5))
        .otherwise(0.5)
    )
    graded = citations.withColumn("grade", grade)
    first = W.partitionBy("fact_id", "document").orderBy(F.desc("position"))
    graded = graded.withColumn("again", F.when(F.row_number().over(first) == 1, 0).otherwise(1))
    place = F.row_number().over(W.partitionBy("fact_id").orderBy("again", "grade", F.desc("position"), "document"))
    return graded.withColumn("place", place).where(F.col("place") <= cap).select("fact_id", "place", "document")


def hash_embedding(docs: DataFrame, id: str, text: str, dim: int = 384) -> DataFrame:
    """Sparse hash embedding ``id, bucket, weight``: every term adds its sign to the bucket of its digest; unit length over the buckets of a text.

    A text's buckets are summed within its row, so nothing is shuffled. A text without terms, or whose signs cancel out, has no row.
    """

    def coded(term: Column) -> Column:
        digest = F.md5(term)
        number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
        sign = F.when(F.conv(F.substring(digest, 9, 1), 16, 10).cast("int") % 2 == 1, 1).otherwise(-1)
        return F.struct((number % dim).cast("int").alias("b"), sign.alias("s"))

    # Exploding an array of one keeps the digests a column, which is made once, instead of an expression that every use repeats.
    rows = docs.select(id, F.explode(F.array(F.transform(norm.terms(F.col(text)), coded))).alias("ts"))
    total = lambda b: F.aggregate(F.filter("ts", lambda t: t["b"] == b), F.lit(0), lambda n, t: n + t["s"])
    sums = F.transform(F.array_distinct(F.transform("ts", lambda t: t["b"])), lambda b: F.struct(b.alias("bucket"), total(b).alias("s")))
    rows = rows.select(id, F.explode(F.array(F.filter(sums, lambda x: x["s"] != 0))).alias("sums"))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("sums", F.lit(0).cast("bigint"), lambda n, x: n + x["s"] * x["s"])))
    return rows.select(id, "norm", F.inline("sums")).select(id, "bucket", F.round(F.col("s") / F.col("norm"), 6).alias("weight"))
