"""Queries over facts: filters, ranking, identity, merging, contradictions, staleness; and the SQL of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import identity, norm
from factloom.operators import contradict, facts
from factloom.plans.views import FACT, RANK, REGISTRY, STORED, fact, registry, stored
from factloom.session import table

_AS_OF, _SINCE = "2025-03-01", "2025-06-01"


def _at(day: str):
    return F.lit(f"{day} 00:00:00").cast("timestamp_ntz")


def facts_as_of(spark: SparkSession, sf: str) -> DataFrame:
    return facts.live(stored(spark, sf, "created_at", "expired_at", "tier"), _at(_AS_OF)).select("id", "tier")


def facts_current(spark: SparkSession, sf: str) -> DataFrame:
    return facts.live(stored(spark, sf, "expired_at", "tier")).select("id", "tier")


def facts_since(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts.since(stored(spark, sf, "valid_at"), _at(_SINCE))
    return rows.select("id", F.unix_micros(F.col("valid_at").cast("timestamp")).alias("valid_us"))


def facts_held_after(spark: SparkSession, sf: str) -> DataFrame:
    return facts.held_after(stored(spark, sf, "invalid_at", "valid_at"), _at(_SINCE)).select("id")


def facts_by_source(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored(spark, sf, "source_key", "expired_at", "invalid_at").where("source_key IS NOT NULL")
    current = F.col("expired_at").isNull() & F.col("invalid_at").isNull()
    return rows.groupBy("source_key").agg(F.count("*").alias("n_facts"), F.count_if(current).alias("n_current"))


def facts_by_claim_key(spark: SparkSession, sf: str) -> DataFrame:
    rows = facts.live(stored(spark, sf, "claim_entity", "claim_attribute", "expired_at")).where("claim_entity IS NOT NULL AND claim_attribute IS NOT NULL")
    return rows.groupBy(F.col("claim_entity").alias("entity"), norm.attribute(F.col("claim_attribute")).alias("attribute")).agg(
        F.count("*").alias("n_facts"), F.min("id").alias("first_id")
    )


def facts_citing(spark: SparkSession, sf: str) -> DataFrame:
    wiki = registry(spark, sf, "id", "kind", once=False).where("kind = 'wiki'").select("id")
    return facts.citing(stored(spark, sf, "document_id"), wiki).select("id", "document_id")


def explain_rank(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored(spark, sf, "claim_entity", "tier", "valid_at", once=False)
    return facts.rank_within(rows, "claim_entity", 5).select(F.col("claim_entity").alias("entity"), "rank", "id")


def explain_page(spark: SparkSession, sf: str) -> DataFrame:
    return facts.page(stored(spark, sf, "tier", "valid_at"), offset=20, limit=20).select("id", "tier")


def episodes_latest(spark: SparkSession, sf: str) -> DataFrame:
    return facts.latest_episode(stored(spark, sf, "base_id", "episode", once=False))


def fact_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored(spark, sf, "base_id", "created_at", "tier", "valid_at", "confidence", "document_id", "source_key")
    out = facts.merge(rows)
    return out.withColumns({"valid_us": F.unix_micros(F.col("valid_at").cast("timestamp")), "confidence": F.round(F.col("confidence").cast("double"), 4)}).drop("valid_at")


def winner_by_tier(spark: SparkSession, sf: str) -> DataFrame:
    return facts.winners(fact(spark, sf), ["entity", "attribute"], "valid_us", "created_us")


def winner_by_fidelity(spark: SparkSession, sf: str) -> DataFrame:
    """As by tier, but an executed fact counts above code only at a fidelity (its confidence) of 0.7 or more."""
    real = F.coalesce(F.col("confidence") >= 0.7, F.lit(False))
    grade = F.when((F.col("tier") == "executed") & real, 4).when(F.col("tier") == "code", 3).when(F.col("tier") == "executed", 2).otherwise(1)
    best = F.max(F.struct(grade.alias("grade"), F.coalesce("valid_us", F.lit(-(2**62))).alias("v"), "id"))
    return fact(spark, sf).groupBy("entity", "attribute").agg(best.alias("w")).select("entity", "attribute", "w.grade", "w.id")


def supersede_fold(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored(spark, sf, "superseded_by", "created_at", once=False).where("superseded_by IS NOT NULL")
    return facts.superseded(rows.select(F.col("id").alias("old"), F.col("superseded_by").alias("new"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("at")))


def supersede_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Connector facts of a claim, each closed at the first later start of one with another value, whatever lies between."""
    return facts.closed_by_conflict(fact(spark, sf).where(F.col("tier").isin(*norm.CONNECTOR_TIERS)), ["entity", "attribute"])


def supersede_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of any tier, each closed at the first later start of a fact of its claim with another value."""
    return facts.closed_by_conflict(fact(spark, sf), ["entity", "attribute"])


def supersede_same_source(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of one source about one claim, each closed at the first later start of another value from that source."""
    rows = fact(spark, sf).where("source_key IS NOT NULL")
    return facts.closed_by_conflict(rows, ["source_key", "entity", "attribute"])


def fact_identity(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored(spark, sf, "statement", "claim_entity", "claim_attribute", "claim_number", "episode")
    c = F.col
    value = F.coalesce(norm.number_text(c("claim_number")), F.lit(""))
    base = identity.base_fact_id(c("statement"), c("claim_entity"), norm.attribute(c("claim_attribute")), value, F.lit(None).cast("string"))
    return rows.where("claim_entity IS NOT NULL AND claim_attribute IS NOT NULL AND NOT isnan(coalesce(claim_number, 0))").select("id", identity.episode_id(base, c("episode")).alias("fact_id"))


def entity_identity(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "entity_catalog")
    return rows.select("id", norm.fold(F.col("name")).alias("folded"), identity.entity_id(F.col("name"), F.col("kind")).alias("entity_id"))


def claim_contradictions(spark: SparkSession, sf: str) -> DataFrame:
    return contradict.claim_contradictions(fact(spark, sf)).drop("entity", "attribute")


def contradiction_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The facts that each side of :func:`claim_contradictions` stands for."""
    return contradict.claim_classes(fact(spark, sf))


def contradictions_by_entity(spark: SparkSession, sf: str) -> DataFrame:
    return contradict.claim_contradictions(fact(spark, sf)).groupBy("entity").agg(F.count("*").alias("n_pairs"), F.max("opened_us").alias("last_opened_us"))


def contradictions_resolved(spark: SparkSession, sf: str) -> DataFrame:
    """Contradictions among facts stored by the start of June 2025 that a later pass over all facts with closed ones removed no longer makes."""
    rows = fact(spark, sf)
    cut = F.lit(1_748_736_000_000_000)
    before = contradict.claim_contradictions(rows.where(F.col("created_us") <= cut))
    now = contradict.claim_contradictions(rows.where("invalid_us IS NULL"))
    return before.join(now.select("id"), "id", "left_anti").select("id", "a", "b")


def contradictions_open_first(spark: SparkSession, sf: str) -> DataFrame:
    """The first twenty contradictions: open ones (no fact that names a side is closed) first, then by id."""
    rows = fact(spark, sf)
    closed = rows.where("invalid_us IS NOT NULL").select("id")
    pairs = contradict.claim_contradictions(rows)
    sides = pairs.select("id", F.explode(F.array("a", "b")).alias("fact")).join(closed.withColumnRenamed("id", "fact"), "fact").select("id").distinct()
    marked = pairs.join(sides.withColumn("closed", F.lit(1)), "id", "left")
    return marked.orderBy(F.coalesce("closed", F.lit(0)), "id").limit(20).select("id", F.coalesce("closed", F.lit(0)).alias("closed"))


def stale_claims(spark: SparkSession, sf: str) -> DataFrame:
    return contradict.stale_claims(fact(spark, sf))


def stale_since(spark: SparkSession, sf: str) -> DataFrame:
    return contradict.stale_claims(fact(spark, sf)).where(F.col("changed_us") > 1_748_736_000_000_000).select("id")


def stale_lastmodified(spark: SparkSession, sf: str) -> DataFrame:
    """Pages registered before the latest code change that states another number about the same entity."""
    seen = registry(spark, sf, "id", "ingested_at", once=False).groupBy("id").agg(F.max(F.unix_micros(F.col("ingested_at").cast("timestamp"))).alias("us")).withColumnRenamed("id", "document_id")
    rows = stored(spark, sf, "claim_entity", "claim_number", "tier", "document_id", "invalid_at").where("claim_entity IS NOT NULL AND claim_number IS NOT NULL AND NOT isnan(claim_number)")
    rows = rows.join(seen, "document_id").select("id", F.col("claim_entity").alias("entity"), F.col("claim_number").alias("number"), "tier", "us", "invalid_at")
    documented = rows.where("tier = 'documented' AND invalid_at IS NULL").withColumnRenamed("us", "page_us")
    code = rows.where(F.col("tier").isin(*norm.CONNECTOR_TIERS) & F.col("invalid_at").isNull()).withColumnRenamed("us", "code_us")
    return contradict.stale_pages(documented, code)


def contradiction_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Facts in scope at each of seven steps of 120 days: stored by its start and not ended by then."""
    rows = fact(spark, sf).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(6))))
    at = (F.col("step").cast("bigint") * 120 + 19723) * 86_400_000_000
    hit = rows.where((F.col("valid_us") <= at) & (F.col("invalid_us").isNull() | (F.col("invalid_us") > at)))
    return hit.groupBy("step", "tier").agg(F.count("*").alias("n"))


def validity_steps(spark: SparkSession, sf: str) -> DataFrame:
    """The step (calendar year from 2020) in which each fact begins and ends; open ends are null."""
    year = lambda c: (F.year(F.timestamp_micros(c)) - 2020).cast("int")
    return fact(spark, sf).select("id", year("valid_us").alias("from_step"), year("invalid_us").alias("to_step"))


QUERIES = {
    f.__name__: f
    for f in (
        facts_as_of, facts_current, facts_since, facts_held_after, facts_by_source, facts_by_claim_key, facts_citing, explain_rank, explain_page, episodes_latest,
        fact_merge, winner_by_tier, winner_by_fidelity, supersede_fold, supersede_chain, supersede_conflicts, supersede_same_source, fact_identity, entity_identity,
        claim_contradictions, contradiction_classes, contradictions_by_entity, contradictions_resolved, contradictions_open_first, stale_claims, stale_since, stale_lastmodified,
        contradiction_scope, validity_steps,
    )
}

_UNITS_OK = "(a.unit IS NULL OR b.unit IS NULL OR a.unit = b.unit)"

def _pairs(source: str, more: str = "") -> str:
    """Every pair of facts by the rule, then by class."""
    return f"""(WITH f AS (SELECT *, {RANK.format('tier')} rk FROM {source} WHERE expired_us IS NULL AND "value" IS NOT NULL {more}),
  c AS (SELECT entity, "attribute", "value", unit, min(id) n, arg_max(id, row(rk, coalesce(valid_us, -{2**62}), coalesce(created_us, -{2**62}))) w FROM f GROUP BY ALL),
  m AS (SELECT f.*, n, w FROM f JOIN c ON f.entity = c.entity AND f."attribute" = c."attribute" AND f."value" = c."value" AND f.unit IS NOT DISTINCT FROM c.unit),
  p AS (SELECT least(a.n, b.n) a, greatest(a.n, b.n) b, a.entity, a."attribute", min(greatest(coalesce(a.valid_us, -{2**62}), coalesce(b.valid_us, -{2**62}))) o
    FROM m a JOIN m b ON a.entity = b.entity AND a."attribute" = b."attribute" AND a.n < b.n
    WHERE a."value" <> b."value" AND {_UNITS_OK} AND coalesce(a.invalid_us, {2**62}) > coalesce(a.valid_us, -{2**62}) AND coalesce(b.invalid_us, {2**62}) > coalesce(b.valid_us, -{2**62})
      AND coalesce(a.invalid_us, {2**62}) > coalesce(b.valid_us, -{2**62}) AND coalesce(b.invalid_us, {2**62}) > coalesce(a.valid_us, -{2**62}) GROUP BY 1, 2, 3, 4),
  r AS (SELECT n, max(row(rk, coalesce(valid_us, -{2**62}), coalesce(created_us, -{2**62}))) best FROM m GROUP BY 1)
  SELECT 'x-' || substr(sha1(a || '|' || b), 1, 16) id, a, b, entity, "attribute", CASE WHEN x.best > y.best THEN a ELSE b END winner, CASE WHEN o > -{2**62} THEN o END opened_us
  FROM p JOIN r x ON x.n = p.a JOIN r y ON y.n = p.b)"""


_STALE = f"""(SELECT id, min(because) because, changed_us FROM (SELECT a.id, b.id because, b.valid_us changed_us, max(b.valid_us) OVER (PARTITION BY a.id) last FROM {FACT} a JOIN {FACT} b ON a.entity = b.entity AND a.attribute = b.attribute
  WHERE a.tier = 'documented' AND b.tier IN ('executed', 'code') AND a.invalid_us IS NULL AND b.invalid_us IS NULL AND a.expired_us IS NULL AND b.expired_us IS NULL
    AND {_UNITS_OK} AND a."value" <> b."value" AND (a.valid_us IS NULL OR b.valid_us > a.valid_us) AND b.valid_us IS NOT NULL) WHERE changed_us = last GROUP BY 1, 3)"""


def _closed(source: str, *key: str) -> str:
    on = " AND ".join(f'a."{k}" = b."{k}"' for k in key)
    return f"""WITH c AS (SELECT * FROM {source} WHERE "value" IS NOT NULL AND valid_us IS NOT NULL), p AS (SELECT a.id, b.id n, b.valid_us u FROM c a JOIN c b ON {on} AND b.valid_us > a.valid_us AND a."value" <> b."value"),
      m AS (SELECT id, min(u) u FROM p GROUP BY 1) SELECT id, min(n) superseded_by, u closed_us FROM p JOIN m USING (id, u) GROUP BY id, u"""


_ATT = "trim(regexp_replace(lower(claim_attribute), '[^a-z0-9]+', '_', 'g'), '_')"

ORACLE = {
    "facts_as_of": f"SELECT id, tier FROM {STORED} WHERE (created_at IS NULL OR created_at <= TIMESTAMP '{_AS_OF}') AND (expired_at IS NULL OR expired_at > TIMESTAMP '{_AS_OF}')",
    "facts_current": f"SELECT id, tier FROM {STORED} WHERE expired_at IS NULL",
    "facts_since": f"SELECT id, epoch_us(valid_at) valid_us FROM {STORED} WHERE valid_at >= TIMESTAMP '{_SINCE}'",
    "facts_held_after": f"SELECT id FROM {STORED} WHERE invalid_at IS NULL OR invalid_at > TIMESTAMP '{_SINCE}'",
    "facts_by_source": f"SELECT source_key, count(*) n_facts, count(*) FILTER (expired_at IS NULL AND invalid_at IS NULL) n_current FROM {STORED} WHERE source_key IS NOT NULL GROUP BY 1",
    "facts_by_claim_key": f"SELECT claim_entity entity, {_ATT} \"attribute\", count(*) n_facts, min(id) first_id FROM {STORED} WHERE expired_at IS NULL AND claim_entity IS NOT NULL AND claim_attribute IS NOT NULL GROUP BY 1, 2",
    "facts_citing": f"SELECT id, document_id FROM {STORED} WHERE document_id IN (SELECT id FROM document_registry WHERE kind = 'wiki' AND reg_id IS NOT NULL)",
    "explain_rank": f"SELECT entity, rank, id FROM (SELECT claim_entity entity, id, CAST(row_number() OVER (PARTITION BY claim_entity ORDER BY {RANK.format('tier')} DESC, valid_at DESC NULLS LAST, id) AS INTEGER) rank FROM {STORED} WHERE claim_entity IS NOT NULL) WHERE rank <= 5",
    "explain_page": f"SELECT id, tier FROM {STORED} ORDER BY {RANK.format('tier')} DESC, valid_at DESC NULLS LAST, id LIMIT 20 OFFSET 20",
    "episodes_latest": f"SELECT base_id, CAST(split_part(m, '|', 1) AS INTEGER) episode, split_part(m, '|', 2) id FROM (SELECT base_id, max(lpad(CAST(coalesce(episode, 0) AS VARCHAR), 9, '0') || '|' || id) m FROM {STORED} WHERE base_id IS NOT NULL GROUP BY 1)",
    "fact_merge": f"""
WITH r AS (SELECT base_id, row_number() OVER (PARTITION BY base_id ORDER BY coalesce(created_at, TIMESTAMP '0001-01-01'), id) ord, {RANK.format('tier')} rk, valid_at, confidence, document_id, source_key,
             coalesce(source_key LIKE 'test:%', false) test FROM {STORED} WHERE base_id IS NOT NULL),
s AS (SELECT base_id, coalesce(max(ord) FILTER (test AND rk >= 2), 1) start FROM r GROUP BY 1),
t AS (SELECT r.base_id, max(rk) m FROM r JOIN s USING (base_id) WHERE ord = start OR (ord > start AND rk >= 2 AND NOT test) GROUP BY 1)
SELECT r.base_id, CASE t.m WHEN 3 THEN 'executed' WHEN 2 THEN 'code' WHEN 1 THEN 'documented' END tier,
       round(CAST(max(confidence) FILTER (NOT isnan(confidence)) AS DOUBLE), 4) confidence, count(DISTINCT document_id) n_documents,
       arg_min(source_key, ord) FILTER (source_key IS NOT NULL) source_key, count(*) n, epoch_us(min(valid_at)) valid_us
FROM r JOIN t USING (base_id) GROUP BY r.base_id, t.m""",
    "winner_by_tier": f"SELECT entity, attribute, id, tier FROM (SELECT *, row_number() OVER (PARTITION BY entity, attribute ORDER BY {RANK.format('tier')} DESC, coalesce(valid_us, -{2**62}) DESC, coalesce(created_us, -{2**62}) DESC, id DESC) r FROM {FACT}) WHERE r = 1",
    "winner_by_fidelity": f"""SELECT entity, "attribute", grade, id FROM (SELECT *, row_number() OVER (PARTITION BY entity, "attribute" ORDER BY grade DESC, coalesce(valid_us, -{2**62}) DESC, id DESC) r FROM
      (SELECT *, CASE WHEN tier = 'executed' AND confidence >= 0.7 THEN 4 WHEN tier = 'code' THEN 3 WHEN tier = 'executed' THEN 2 ELSE 1 END grade FROM {FACT})) WHERE r = 1""",
    "supersede_fold": f"SELECT id AS \"old\", epoch_us(min(created_at)) invalid_us, min(superseded_by) superseded_by FROM {STORED} WHERE superseded_by IS NOT NULL AND superseded_by <> id GROUP BY id",
    "supersede_chain": _closed(f"(SELECT * FROM {FACT} WHERE tier IN ('executed', 'code'))", "entity", "attribute"),
    "supersede_conflicts": _closed(FACT, "entity", "attribute"),
    "supersede_same_source": _closed(FACT, "source_key", "entity", "attribute"),
    "fact_identity": f"""SELECT id, 'f-' || substr(sha1('claim|' || claim_entity || '|' || {_ATT} || '|' ||
      coalesce(regexp_replace(regexp_replace(CAST(CAST(claim_number AS DECIMAL(28,6)) AS VARCHAR), '0+$', ''), '\\.$', ''), '') || '|'), 1, 16) ||
      CASE WHEN coalesce(episode, 0) = 0 THEN '' ELSE '.' || episode END fact_id
      FROM {STORED} WHERE claim_entity IS NOT NULL AND claim_attribute IS NOT NULL AND NOT isnan(coalesce(claim_number, 0))""",
    "entity_identity": r"SELECT id, f folded, 'e-' || substr(sha1(kind || ':' || f), 1, 12) entity_id FROM (SELECT id, kind, regexp_replace(lower(trim(name)), '[\s\-_./]+', '', 'g') f FROM entity_catalog)",
    "claim_contradictions": f"SELECT id, a, b, winner, opened_us FROM {_pairs(FACT)}",
    "contradiction_classes": f"""SELECT id, min(id) OVER (PARTITION BY entity, "attribute", "value", coalesce(unit, '')) AS "class" FROM {FACT} WHERE expired_us IS NULL AND "value" IS NOT NULL""",
    "contradictions_by_entity": f"SELECT entity, count(*) n_pairs, max(opened_us) last_opened_us FROM {_pairs(FACT)} GROUP BY 1",
    "contradictions_resolved": f"SELECT id, a, b FROM {_pairs(FACT, 'AND created_us <= 1748736000000000')} WHERE id NOT IN (SELECT id FROM {_pairs(FACT, 'AND invalid_us IS NULL')})",
    "contradictions_open_first": f"SELECT id, closed FROM (SELECT p.id, CASE WHEN p.a IN (SELECT id FROM {FACT} WHERE invalid_us IS NOT NULL) OR p.b IN (SELECT id FROM {FACT} WHERE invalid_us IS NOT NULL) THEN 1 ELSE 0 END closed FROM {_pairs(FACT)} p) ORDER BY closed, id LIMIT 20",
    "stale_claims": f"SELECT id, because, changed_us FROM {_STALE}",
    "stale_since": f"SELECT id FROM {_STALE} WHERE changed_us > 1748736000000000",
    "stale_lastmodified": f"""
WITH seen AS (SELECT id document_id, max(epoch_us(ingested_at)) us FROM {REGISTRY} GROUP BY 1),
r AS (SELECT f.id, claim_entity e, claim_number n, tier, us FROM {STORED} f JOIN seen USING (document_id)
      WHERE claim_entity IS NOT NULL AND claim_number IS NOT NULL AND NOT isnan(claim_number) AND invalid_at IS NULL)
SELECT d.id, max(c.us) changed_us FROM r d JOIN r c ON d.e = c.e AND d.n <> c.n WHERE d.tier = 'documented' AND c.tier IN ('executed', 'code') GROUP BY d.id, d.us HAVING max(c.us) > d.us""",
    "contradiction_scope": f"SELECT CAST(s.step AS INTEGER) step, tier, count(*) n FROM {FACT} f JOIN (SELECT range step, (range * 120 + 19723) * 86400000000 at_us FROM range(7)) s ON f.valid_us <= s.at_us AND (f.invalid_us IS NULL OR f.invalid_us > s.at_us) GROUP BY 1, 2",
    "validity_steps": f"SELECT id, CAST(year(make_timestamp(valid_us)) - 2020 AS INTEGER) from_step, CAST(year(make_timestamp(invalid_us)) - 2020 AS INTEGER) to_step FROM {FACT}",
}
