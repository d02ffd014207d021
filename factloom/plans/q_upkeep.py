"""Queries that keep a store in order: upserts, retractions, snapshots, constraints, context and scope; and the SQL of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import norm
from factloom.operators import runs
from factloom.plans.views import FACT, RANK, REGISTRY, RUNS, STORED, fact, registry, runs as run_view, stored
from factloom.session import table


def excluded_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Code documents per top directory, those under directories of no interest left out."""
    skip = F.array(*[F.lit(x) for x in ("return", "sender", "shelf")])
    parts = F.split("id", "/")
    rows = registry(spark, sf, "id", "kind", once=False).where("kind = 'code'").where(~F.arrays_overlap(parts, skip))
    return rows.groupBy(parts[1].alias("directory")).agg(F.countDistinct("id").alias("n_paths"))


def step_of_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Which steps hold equal trees: the number of paths and two sums of 60 bits of a digest of (path, content), whatever the order, stand for a step's tree."""
    li = table(spark, sf, "lineitem")
    tree = li.groupBy((F.year("l_shipdate") - 1995).cast("int").alias("step"), F.col("l_suppkey").alias("path")).agg((F.count("*") % 2).alias("blob"))
    digest = F.md5(F.concat_ws("|", F.col("path").cast("string"), F.col("blob").cast("string")))
    part = lambda at: F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    trees = tree.groupBy("step").agg(F.concat_ws("-", F.count("*").cast("string"), part(1), part(17)).alias("tree"))
    return trees.groupBy("tree").agg(F.min("step").alias("first_step"), F.count("*").alias("n_steps"))


def known_context(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct claims that an extractor is shown: entity, attribute and unit, without expired facts."""
    rows = stored(spark, sf, "claim_entity", "claim_attribute", "claim_unit", "expired_at", once=False).where("claim_entity IS NOT NULL AND claim_attribute IS NOT NULL AND expired_at IS NULL")
    return rows.select(F.col("claim_entity").alias("entity"), norm.attribute(F.col("claim_attribute")).alias("attribute"), norm.unit(F.col("claim_unit")).alias("unit")).distinct()


def implicit_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that are cited or hold text but were never registered, with their source."""
    cited = table(spark, sf, "stored_fact").select(F.col("document_id").alias("id")).unionByName(table(spark, sf, "documents").select(F.col("document_id").alias("id")))
    new = cited.where("id IS NOT NULL").distinct().join(registry(spark, sf, "id", once=False).select("id"), "id", "left_anti")
    return new.select("id", norm.source_of(F.col("id")).alias("source"))


def retracted_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Base facts after every citation of a ticket is retracted: how many documents are left; without any the fact expires."""
    rows = stored(spark, sf, "base_id", "document_id", once=False).where("base_id IS NOT NULL AND document_id IS NOT NULL")
    left = F.countDistinct(F.when(~F.col("document_id").startswith("ticket/"), F.col("document_id")))
    return rows.groupBy("base_id").agg(left.alias("n_left")).withColumn("expires", F.col("n_left") == 0)


def entity_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Entities by folded name and kind: the smallest id, the number of names merged, the distinct aliases; values are counted, not collected."""
    e = table(spark, sf, "entity").where("id IS NOT NULL AND name IS NOT NULL AND kind IS NOT NULL")
    keyed = e.select("id", "kind", norm.fold(F.col("name")).alias("folded"), "name", "aliases")
    heads = keyed.groupBy("kind", "folded").agg(F.min("id").alias("id"), F.countDistinct("name").alias("n_names"))
    al = keyed.select("kind", "folded", F.explode("aliases").alias("a")).where("a IS NOT NULL").groupBy("kind", "folded").agg(F.countDistinct(F.lower("a")).alias("n_aliases"))
    return heads.join(al, ["kind", "folded"], "left").withColumn("n_aliases", F.coalesce("n_aliases", F.lit(0)))


def snapshot_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts that were live at each of four snapshots, by tier."""
    rows = stored(spark, sf, "created_at", "expired_at", "tier").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(3))))
    at = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("step").cast("bigint") * 182 * 86_400_000_000).cast("timestamp_ntz")
    hit = rows.where((F.col("created_at") <= at) & (F.col("expired_at").isNull() | (F.col("expired_at") > at)))
    return hit.groupBy("step", "tier").agg(F.count("*").alias("n"))


def symmetric_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes that only one of two steps reports."""
    r = run_view(spark, sf)
    a, b = r.where("step = 1").select("node").distinct(), r.where("step = 2").select("node").distinct()
    return a.exceptAll(b).withColumn("side", F.lit("before")).unionByName(b.exceptAll(a).withColumn("side", F.lit("after")))


def flaky_inherits(spark: SparkSession, sf: str) -> DataFrame:
    """The outcome that counts at every step: a flaky step keeps that of the last step that was not."""
    w = W.partitionBy("node").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    rows = runs.by_step(run_view(spark, sf)).withColumn("sure", F.when(~F.col("flaky"), F.col("outcome")))
    return rows.select("node", "step", F.last("sure", ignorenulls=True).over(w).alias("outcome"))


def replaced_test(spark: SparkSession, sf: str) -> DataFrame:
    """Small parts as vanished tests, large ones of the same brand and type as added: the best successor shares the most words (0.6 or more).

    Names of the same words are one class, and only these are compared; the successor is the class's smallest number.
    """
    p = table(spark, sf, "part").where("p_name IS NOT NULL").select("p_partkey", "p_brand", "p_type", "p_size", F.array_sort(F.array_distinct(F.split("p_name", " "))).alias("w"))
    gone = p.where("p_size <= 10").select("p_brand", "p_type", F.col("p_partkey").alias("gone"), F.col("w").alias("a"))
    new = p.where("p_size > 10").groupBy("p_brand", "p_type", F.col("w").alias("b")).agg(F.min("p_partkey").alias("new"))
    both = gone.select("p_brand", "p_type", "a").distinct().join(new, ["p_brand", "p_type"])
    both = both.withColumn("score", F.round(F.size(F.array_intersect("a", "b")) / F.least(F.size("a"), F.size("b")), 6)).where("score >= 0.6")
    best = both.groupBy("p_brand", "p_type", "a").agg(F.max(F.struct("score", (-F.col("new")).alias("neg"))).alias("m"))
    return gone.join(best, ["p_brand", "p_type", "a"]).select("gone", (-F.col("m.neg")).alias("new"), F.col("m.score").alias("score"))


def pair_either_order(spark: SparkSession, sf: str) -> DataFrame:
    """Supersessions named by both sides, whichever order the pair is written in."""
    rows = stored(spark, sf, "superseded_by").where("superseded_by IS NOT NULL AND superseded_by <> id")
    pairs = rows.select(F.least("id", "superseded_by").alias("a"), F.greatest("id", "superseded_by").alias("b"), (F.col("id") < F.col("superseded_by")).alias("forward"))
    return pairs.groupBy("a", "b").agg(F.count_if(F.col("forward")).alias("n_forward"), F.count_if(~F.col("forward")).alias("n_back"))


def prior_version_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Claims of each document in its first and second half of observations: restated, retracted or new."""
    rows = stored(spark, sf, "document_id", "base_id", "created_at", once=False).where("document_id IS NOT NULL AND base_id IS NOT NULL AND created_at IS NOT NULL")
    late = F.col("created_at") >= F.lit("2025-06-01 00:00:00").cast("timestamp_ntz")
    sides = rows.groupBy("document_id", "base_id").agg(F.max(late).alias("now"), F.max(~late).alias("before"))
    state = F.when(F.col("now") & F.col("before"), "restated").when(F.col("now"), "new").otherwise("retracted")
    return sides.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def cost_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens (a quarter of the characters) and price at three units a million, per source."""
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    tokens = F.sum(F.floor(F.length("text") / 4)).cast("bigint")
    return d.groupBy("source").agg(tokens.alias("tokens"), F.round(tokens.cast("double") * 3 / 1_000_000, 6).alias("price"))


def tier_totals(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored(spark, sf, "category", "tier")
    return rows.groupBy("category").pivot("tier", list(norm.TIER_RANK)).count().na.fill(0, list(norm.TIER_RANK))


def claim_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that break a rule of the model: half a claim, an end not after the start, an expiry before storing, an unknown tier or category."""
    rows = stored(spark, sf, "claim_entity", "claim_attribute", "valid_at", "invalid_at", "created_at", "expired_at", "tier", "superseded_by")
    c = F.col
    broken = {
        "half_claim": c("claim_entity").isNull() != c("claim_attribute").isNull(),
        "empty_period": c("invalid_at") <= c("valid_at"),
        "expired_before_stored": c("expired_at") < c("created_at"),
        "unknown_tier": norm.tier_rank("tier") == 0,
        "supersedes_itself": c("superseded_by") == c("id"),
    }
    kinds = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in broken.items()]))
    return rows.select(F.explode(kinds).alias("rule"), "id").groupBy("rule").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def carrier_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Facts per kind of carrier, tests and code told apart by path, configuration files left out."""
    rows = stored(spark, sf, "document_id", "source_key").where("document_id IS NOT NULL")
    scope = F.when(F.coalesce(F.col("source_key"), F.lit("")).startswith("test:"), "test").when(F.col("document_id").startswith("code/"), "code").otherwise("page")
    return rows.where(~F.col("document_id").rlike(r"\.(toml|json|yaml)$")).groupBy(scope.alias("scope")).agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("n_documents"))


def term_contradictions(spark: SparkSession, sf: str) -> DataFrame:
    """Any two different statements of a claim that share enough words but differ in denial or numbers, each named by its smallest fact, with how many facts make it."""
    from factloom.operators import match

    key = ["claim_entity", "claim_attribute"]
    texts = match.statement_classes(stored(spark, sf, "statement", *key), key)
    pairs = match.term_pairs(texts, key, 0.35)
    side = lambda c: texts.select(*key, F.col("name").alias(c), F.col("text").alias(f"t_{c}"), F.col("n").alias(f"n_{c}"))
    wide = pairs.join(side("a"), [*key, "a"]).join(side("b"), [*key, "b"])
    na, nb = norm.numbers(F.col("t_a")), norm.numbers(F.col("t_b"))
    differ = (match.negated(F.col("t_a")) != match.negated(F.col("t_b"))) | ((F.size(na) > 0) & (F.size(nb) > 0) & (na != nb))
    return wide.where(differ).select("a", "b", "n_a", "n_b", "overlap")


def recency(spark: SparkSession, sf: str) -> DataFrame:
    """The latest registration among the documents of every base fact."""
    seen = registry(spark, sf, "id", "ingested_at", once=False).groupBy("id").agg(F.max("ingested_at").alias("at")).withColumnRenamed("id", "document_id")
    rows = stored(spark, sf, "base_id", "document_id", once=False).where("base_id IS NOT NULL AND document_id IS NOT NULL")
    return rows.join(seen, "document_id").groupBy("base_id").agg(F.max(F.unix_micros(F.col("at").cast("timestamp"))).alias("latest_us"))


def supersession_rank(spark: SparkSession, sf: str) -> DataFrame:
    """How many facts of a claim were closed before each fact began: a running count per key."""
    w = W.partitionBy("entity", "attribute").orderBy(F.col("valid_us").asc_nulls_last(), "id").rowsBetween(W.unboundedPreceding, -1)
    closed = F.coalesce(F.sum(F.when(F.col("invalid_us").isNotNull(), 1).otherwise(0)).over(w), F.lit(0))
    return fact(spark, sf).select("id", closed.alias("closed_before"))


QUERIES = {
    f.__name__: f
    for f in (
        excluded_paths, step_of_tree, known_context, implicit_documents, retracted_citations, entity_upsert, snapshot_counts, symmetric_difference, flaky_inherits, replaced_test, pair_either_order,
        prior_version_diff, cost_estimate, tier_totals, claim_checks, carrier_scope, term_contradictions, recency, supersession_rank,
    )
}

_ATT = "trim(regexp_replace(lower(claim_attribute), '[^a-z0-9]+', '_', 'g'), '_')"
_UNIT = "CASE WHEN u NOT IN ('', 'none', 'null') THEN CASE u {0} ELSE u END END".format(" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in norm.UNITS.items()))
_SOURCE = "CASE split_part(id, '/', 1) {0} ELSE 'other' END".format(" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in norm.SOURCES.items()))
_FOLD = r"regexp_replace(lower(trim(name)), '[\s\-_./]+', '', 'g')"
_NEG = r"regexp_matches(lower({0}), '(^|[^a-z])(not|never|no|none|without|off|cannot|can''t|isn''t|doesn''t|no longer)([^a-z]|$)')"
_NUMS = r"list_sort(list_distinct(list_transform(regexp_extract_all({0}, '[0-9]+(?:\.[0-9]+)?'), lambda x: CASE WHEN contains(x, '.') THEN rtrim(rtrim(x, '0'), '.') ELSE x END)))"
_STOP = ", ".join(f"'{w}'" for w in norm.STOPWORDS)


def _terms(text: str) -> str:
    words = f"list_filter(list_transform(regexp_extract_all(lower({text}), '[a-z0-9$%.]+'), lambda w: trim(w, '.')), lambda w: w <> '' AND w NOT IN ({_STOP}))"
    return f"list_distinct(list_transform({words}, lambda w: CASE WHEN length(w) > 4 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END))"


_NORM = r"regexp_replace(regexp_replace(trim(lower(statement)), '\s+', ' ', 'g'), '[ .]+$', '')"
_BY_STEP = f"(SELECT node, step, arg_max(outcome, attempt) outcome, bool_or(outcome = 'passed') AND bool_or(outcome = 'failed') flaky FROM {RUNS} GROUP BY 1, 2)"

ORACLE = {
    "excluded_paths": f"SELECT split_part(id, '/', 2) directory, count(DISTINCT id) n_paths FROM {REGISTRY} WHERE kind = 'code' AND NOT list_has_any(string_split(id, '/'), ['return', 'sender', 'shelf']) GROUP BY 1",
    "step_of_tree": """WITH t AS (SELECT CAST(year(l_shipdate) - 1995 AS INTEGER) step, l_suppkey p, count(*) % 2 b FROM lineitem GROUP BY 1, 2), h AS (SELECT step, md5(p || '|' || b) m FROM t),
      d AS (SELECT step, count(*) || '-' || sum(CAST('0x' || substr(m, 1, 15) AS HUGEINT)) || '-' || sum(CAST('0x' || substr(m, 17, 15) AS HUGEINT)) tree FROM h GROUP BY 1) SELECT tree, min(step) first_step, count(*) n_steps FROM d GROUP BY 1""",
    "known_context": f"SELECT DISTINCT claim_entity entity, {_ATT} AS \"attribute\", {_UNIT} unit FROM (SELECT *, lower(trim(claim_unit)) u FROM {STORED}) WHERE claim_entity IS NOT NULL AND claim_attribute IS NOT NULL AND expired_at IS NULL",
    "implicit_documents": f"SELECT DISTINCT id, {_SOURCE} AS \"source\" FROM (SELECT document_id id FROM stored_fact UNION SELECT document_id FROM documents) WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM document_registry WHERE reg_id IS NOT NULL AND id IS NOT NULL)",
    "retracted_citations": f"SELECT base_id, n n_left, n = 0 expires FROM (SELECT base_id, count(DISTINCT document_id) FILTER (document_id NOT LIKE 'ticket/%') n FROM {STORED} WHERE base_id IS NOT NULL AND document_id IS NOT NULL GROUP BY 1)",
    "entity_upsert": f"""WITH k AS (SELECT id, kind, {_FOLD} folded, name, aliases FROM entity WHERE id IS NOT NULL AND name IS NOT NULL AND kind IS NOT NULL),
      a AS (SELECT kind, folded, count(DISTINCT lower(x)) n FROM (SELECT kind, folded, unnest(aliases) x FROM k) WHERE x IS NOT NULL GROUP BY 1, 2)
      SELECT h.*, coalesce(a.n, 0) n_aliases FROM (SELECT kind, folded, min(id) id, count(DISTINCT name) n_names FROM k GROUP BY 1, 2) h LEFT JOIN a USING (kind, folded)""",
    "snapshot_counts": f"SELECT CAST(s.range AS INTEGER) step, tier, count(*) n FROM {STORED} f JOIN range(4) s ON created_at <= make_timestamp(1704067200000000 + s.range * 182 * 86400000000) AND (expired_at IS NULL OR expired_at > make_timestamp(1704067200000000 + s.range * 182 * 86400000000)) GROUP BY 1, 2",
    "symmetric_difference": f"""WITH a AS (SELECT DISTINCT node FROM {RUNS} WHERE step = 1), b AS (SELECT DISTINCT node FROM {RUNS} WHERE step = 2)
      SELECT node, 'before' side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT node, 'after' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "flaky_inherits": f"SELECT node, step, last_value(CASE WHEN NOT flaky THEN outcome END IGNORE NULLS) OVER (PARTITION BY node ORDER BY step) outcome FROM {_BY_STEP}",
    "replaced_test": """WITH g AS (SELECT p_partkey k, p_brand, p_type, list_distinct(string_split(p_name, ' ')) w FROM part WHERE p_size <= 10), n AS (SELECT p_partkey k, p_brand, p_type, list_distinct(string_split(p_name, ' ')) w FROM part WHERE p_size > 10),
      j AS (SELECT g.k gone, n.k nk, round(len(list_intersect(g.w, n.w)) / least(len(g.w), len(n.w)), 6) score FROM g JOIN n USING (p_brand, p_type))
      SELECT gone, nk AS "new", score FROM (SELECT *, row_number() OVER (PARTITION BY gone ORDER BY score DESC, nk) r FROM j WHERE score >= 0.6) WHERE r = 1""",
    "pair_either_order": f"SELECT least(id, superseded_by) a, greatest(id, superseded_by) b, count(*) FILTER (id < superseded_by) n_forward, count(*) FILTER (id > superseded_by) n_back FROM {STORED} WHERE superseded_by IS NOT NULL AND superseded_by <> id GROUP BY 1, 2",
    "prior_version_diff": f"""SELECT CASE WHEN n AND b THEN 'restated' WHEN n THEN 'new' ELSE 'retracted' END AS "state", count(*) n FROM (SELECT document_id, base_id, bool_or(created_at >= TIMESTAMP '2025-06-01') n, bool_or(created_at < TIMESTAMP '2025-06-01') b
      FROM {STORED} WHERE document_id IS NOT NULL AND base_id IS NOT NULL AND created_at IS NOT NULL GROUP BY 1, 2) GROUP BY 1""",
    "cost_estimate": "SELECT source, t tokens, round(t * 3.0::DOUBLE / 1000000, 6) price FROM (SELECT source, CAST(sum(length(text) // 4) AS BIGINT) t FROM documents WHERE text IS NOT NULL GROUP BY 1)",
    "tier_totals": f"SELECT category, count(*) FILTER (tier = 'executed') executed, count(*) FILTER (tier = 'code') code, count(*) FILTER (tier = 'documented') documented FROM {STORED} GROUP BY 1",
    "claim_checks": f"""WITH r AS (SELECT id, unnest([CASE WHEN (claim_entity IS NULL) <> (claim_attribute IS NULL) THEN 'half_claim' END, CASE WHEN invalid_at <= valid_at THEN 'empty_period' END,
      CASE WHEN expired_at < created_at THEN 'expired_before_stored' END, CASE WHEN {RANK.format('tier')} = 0 THEN 'unknown_tier' END, CASE WHEN superseded_by = id THEN 'supersedes_itself' END]) rule FROM {STORED})
      SELECT rule, count(*) n, min(id) first_id FROM r WHERE rule IS NOT NULL GROUP BY 1""",
    "carrier_scope": rf"SELECT CASE WHEN coalesce(source_key, '') LIKE 'test:%' THEN 'test' WHEN document_id LIKE 'code/%' THEN 'code' ELSE 'page' END scope, count(*) n, count(DISTINCT document_id) n_documents FROM {STORED} WHERE document_id IS NOT NULL AND NOT regexp_matches(document_id, '\.(toml|json|yaml)$') GROUP BY 1",
    "term_contradictions": f"""WITH c AS (SELECT claim_entity e, claim_attribute k, {_NORM} t, min(id) n, count(*) m FROM {STORED} WHERE statement IS NOT NULL AND claim_entity IS NOT NULL AND claim_attribute IS NOT NULL GROUP BY 1, 2, 3),
      w AS (SELECT *, {_terms('t')} w FROM c WHERE t <> ''), p AS (SELECT x.n a, y.n b, x.m n_a, y.m n_b, x.t ta, y.t tb, round(len(list_intersect(x.w, y.w)) / least(len(x.w), len(y.w)), 6) overlap
        FROM w x JOIN w y ON x.e = y.e AND x.k = y.k AND x.n < y.n AND len(x.w) > 0 AND len(y.w) > 0)
      SELECT a, b, n_a, n_b, overlap FROM p WHERE overlap >= 0.35 AND ({_NEG.format('ta')} <> {_NEG.format('tb')} OR (len({_NUMS.format('ta')}) > 0 AND len({_NUMS.format('tb')}) > 0 AND {_NUMS.format('ta')} <> {_NUMS.format('tb')}))""",
    "recency": f"SELECT base_id, max(epoch_us(seen_at)) latest_us FROM {STORED} JOIN (SELECT id document_id, max(ingested_at) seen_at FROM {REGISTRY} GROUP BY 1) USING (document_id) WHERE base_id IS NOT NULL GROUP BY 1",
    "supersession_rank": f"SELECT id, CAST(coalesce(count(invalid_us) OVER (PARTITION BY entity, attribute ORDER BY valid_us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) closed_before FROM {FACT}",
}
