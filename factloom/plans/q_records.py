"""Queries over records as a user sees them: merged citations, displays, payloads, lookups, prose conflicts, plans of an ingest; and the SQL of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import norm
from factloom.operators import contradict, evaluate, match, search, temporal
from factloom.plans.q_eval import _BOUND, _NEG, _NORM, _NUMS, _OUT, _terms
from factloom.plans.q_facts import _pairs
from factloom.plans.q_temporal import _STATES, _states
from factloom.plans.q_text import _HYBRID, hybrid_rrf
from factloom.plans.views import FACT, RANK, REGISTRY, RUNS, STORED, fact, registry, runs as run_view, stored
from factloom.session import table

_CUT = "2025-06-01"


def fact_citations(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that observations of a base fact cite, each once, in the order in which they were first seen, as one text."""
    rows = stored(spark, sf, "base_id", "document_id", "created_at", once=False).where("base_id IS NOT NULL AND document_id IS NOT NULL")
    order = F.struct(F.coalesce("created_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("at"), "id")
    first = rows.groupBy("base_id", "document_id").agg(F.min(order).alias("first"))
    listed = F.array_sort(F.collect_list(F.struct("first", "document_id")))
    return first.groupBy("base_id").agg(F.array_join(F.transform(listed, lambda x: x["document_id"]), "|").alias("documents"), F.count("*").alias("n"))


def _names(spark: SparkSession, sf: str) -> DataFrame:
    """``entity, name``: what an id of entity or catalog is called."""
    both = table(spark, sf, "entity_catalog").select("id", "name").unionByName(table(spark, sf, "entity").select("id", "name"))
    return both.where("id IS NOT NULL AND name IS NOT NULL").groupBy(F.col("id").alias("entity")).agg(F.min("name").alias("name"))


def fact_display(spark: SparkSession, sf: str) -> DataFrame:
    """Every claim as shown: the entity's name (its id if it has none), the value in plain digits or words, the unit."""
    rows = fact(spark, sf).where("value IS NOT NULL").join(_names(spark, sf), "entity", "left")
    return rows.select("id", F.coalesce("name", "entity").alias("name"), "attribute", F.concat_ws(" ", "value", "unit").alias("shown"))


def test_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Facts per test: the node that a test's source names, without local path prefixes."""
    rows = stored(spark, sf, "source_key").where("source_key LIKE 'test:%'")
    node = F.regexp_replace(F.substring("source_key", 6, 1_000_000), "^(/[^:]*)?(?=tests/)", "")
    return rows.groupBy(node.alias("node")).agg(F.count("*").alias("n_facts"), F.min("id").alias("first_id"))


def claim_payload(spark: SparkSession, sf: str) -> DataFrame:
    """Claims with value and unit as JSON."""
    rows = fact(spark, sf).where("value IS NOT NULL AND unit IS NOT NULL")
    return rows.select("id", F.to_json(F.struct("entity", "attribute", "value", "unit")).alias("payload"))


def money_text(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts of money with two digits, as a text would show them."""
    rows = stored(spark, sf, "claim_number", "claim_attribute").where("claim_number IS NOT NULL AND NOT isnan(claim_number)")
    money = norm.infer_unit(F.col("claim_attribute")) == "usd"
    return rows.where(money).select("id", F.format_string("$%.2f", F.round("claim_number", 2)).alias("text"))


def facts_by_category(spark: SparkSession, sf: str) -> DataFrame:
    """Business facts, current ones, per tier."""
    return stored(spark, sf, "category", "tier", "expired_at").where("category = 'business-logic' AND expired_at IS NULL").groupBy("tier").agg(F.count("*").alias("n"))


def never_skipped(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of which no attempt was skipped at any step, with the number of their attempts."""
    skipped = F.max((F.col("outcome") == "skipped").cast("int"))
    return run_view(spark, sf).groupBy("node").agg(F.count("*").alias("n"), skipped.alias("s")).where("s = 0").select("node", "n")


def contradictions_in_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Contradictions that had opened by each of seven steps of 120 days."""
    pairs = contradict.claim_contradictions(fact(spark, sf)).select("opened_us", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("step"))
    at = (F.col("step").cast("bigint") * 120 + 19723) * 86_400_000_000
    return pairs.where(F.col("opened_us").isNull() | (F.col("opened_us") <= at)).groupBy("step").agg(F.count("*").alias("n"))


def contradictions_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Contradictions known from the facts stored by June 2025, brought up to date with all facts: state and the earlier of both openings."""
    rows = fact(spark, sf)
    cut = F.unix_micros(F.lit(f"{_CUT} 00:00:00").cast("timestamp_ntz").cast("timestamp"))
    old = contradict.claim_contradictions(rows.where(F.col("created_us") <= cut)).select("id", F.col("opened_us").alias("before_us"), F.lit(1).alias("old"))
    new = contradict.claim_contradictions(rows).select("id", "opened_us", F.lit(1).alias("new"))
    both = old.join(new, "id", "full_outer")
    state = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "resolved").otherwise("kept")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.min(F.least("before_us", "opened_us")).alias("first_us"))


def _prose(spark: SparkSession, sf: str) -> DataFrame:
    """``entity, name, text, n, documented``: what facts without a claim say about the entity of the text that they cite (a team or service is no subject), by statement."""
    facts = stored(spark, sf, "statement", "claim_entity", "tier", "expired_at", "document_id").where("claim_entity IS NULL AND expired_at IS NULL AND statement IS NOT NULL AND document_id IS NOT NULL")
    hubs = table(spark, sf, "entity_catalog").where("kind IN ('service', 'team')").select(F.col("id").alias("entity"))
    about = table(spark, sf, "documents").where("document_id IS NOT NULL AND entity_id IS NOT NULL").select("document_id", F.col("entity_id").alias("entity")).distinct()
    rows = facts.join(about, "document_id").join(hubs, "entity", "left_anti")
    return rows.groupBy("entity", norm.statement(F.col("statement")).alias("text")).agg(F.min("id").alias("name"), F.count("*").alias("n"), F.max((F.col("tier") == "documented").cast("int")).alias("documented"))


def prose_contradictions(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates among statements without a claim: about one entity, one of them from a page, a third of the terms shared, and another denial or other numbers."""
    texts = _prose(spark, sf)
    pairs = match.term_pairs(texts, ["entity"], 0.35)
    side = lambda c: texts.select("entity", F.col("name").alias(c), F.col("text").alias(f"t_{c}"), F.col("documented").alias(f"d_{c}"))
    wide = pairs.join(side("a"), ["entity", "a"]).join(side("b"), ["entity", "b"]).where("d_a + d_b > 0")
    na, nb = norm.numbers(F.col("t_a")), norm.numbers(F.col("t_b"))
    differ = (match.negated(F.col("t_a")) != match.negated(F.col("t_b"))) | ((F.size(na) > 0) & (F.size(nb) > 0) & (na != nb))
    return wide.where(differ).select("a", "b").distinct()


def document_facts(spark: SparkSession, sf: str) -> DataFrame:
    """The three first facts of every document, by tier, then the later start."""
    rows = stored(spark, sf, "document_id", "tier", "valid_at", once=False)
    order = W.partitionBy("document_id").orderBy(norm.tier_rank("tier").desc(), F.col("valid_at").desc_nulls_last(), "id")
    top = rows.where("document_id IS NOT NULL").withColumn("place", F.dense_rank().over(order)).where("place <= 3")
    return top.select("document_id", "place", "id").distinct()


def matcher_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """The matcher against base facts: pairs of statements of one entity and attribute that share a third of their terms, by whether they match and whether they state one value."""
    key = ["claim_entity", "claim_attribute"]
    rows = stored(spark, sf, "statement", "base_id", *key).where("base_id IS NOT NULL")
    texts = match.statement_classes(rows, key)
    bases = rows.select(*key, norm.statement(F.col("statement")).alias("text"), "base_id").groupBy(*key, "text").agg(F.min("base_id").alias("base"))
    side = lambda c: texts.join(bases, [*key, "text"]).select(*key, F.col("name").alias(c), F.col("text").alias(f"t_{c}"), F.col("base").alias(f"b_{c}"))
    wide = match.term_pairs(texts, key, 0.35).join(side("a"), [*key, "a"]).join(side("b"), [*key, "b"])
    judged = wide.select(match.statements_match(F.col("t_a"), F.col("t_b")).alias("found"), (F.col("b_a") == F.col("b_b")).alias("right"))
    n = lambda c: F.count_if(c)
    f, r = F.col("found"), F.col("right")
    return judged.agg(n(f & r).alias("tp"), n(f & ~r).alias("fp"), n(~f & r).alias("fn"), n(~f & ~r).alias("tn"))


def recall_at_10(spark: SparkSession, sf: str) -> DataFrame:
    """Share of each source's expected documents (English ones) among its ten first answers (by length, then id)."""
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars", F.coalesce(F.col("lang") == "en", F.lit(False)).alias("ok"))
    w = W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    top = d.where("n_chars IS NOT NULL").withColumn("r", F.row_number().over(w)).where("r <= 10").groupBy("source").agg(F.count_if("ok").alias("hit"))
    return d.groupBy("source").agg(F.count_if("ok").alias("want")).join(top, "source", "left").select("source", evaluate.ratio(F.coalesce("hit", F.lit(0)), F.col("want")).alias("r10"))


def word_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Overlap of any two statements of a base fact, with repeated words counted as often as both have them."""
    texts = match.statement_classes(stored(spark, sf, "base_id", "statement"), ["base_id"])
    side = lambda c: texts.select("base_id", F.col("name").alias(c), match.words(F.col("text")).alias(f"w_{c}"))
    wide = side("a").join(side("b"), "base_id").where("a < b")
    return wide.select("a", "b", match.multiset_overlap(F.col("w_a"), F.col("w_b")).alias("overlap")).where("overlap >= 0.6")


def number_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """How often documents state numbers of each kind (money, percent, time, plain); status codes, code classes and ordinals are no numbers."""
    docs = table(spark, sf, "documents").where("text IS NOT NULL")
    tokens = docs.select("doc_id", F.explode(match.number_tokens(F.col("text"))).alias("token"))
    return tokens.groupBy(match.number_kind(F.col("token")).alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("token").alias("n_tokens"), F.min("token").alias("first"))


def entity_norms(spark: SparkSession, sf: str) -> DataFrame:
    """Names of entities without a kind before a colon, in lower case with their marks (camel case apart), and without separators."""
    kinds = [r[0] for r in table(spark, sf, "entity_catalog").where("kind IS NOT NULL").select(F.lower("kind")).distinct().limit(1_000).collect()]
    rows = table(spark, sf, "entity").where("id IS NOT NULL AND name IS NOT NULL").select("id", "name").distinct()
    bare = norm.without_kind(F.col("name"), kinds)
    return rows.select("id", F.md5(norm.entity_name(norm.split_camel(bare))).alias("name_digest"), F.md5(norm.fold(bare)).alias("fold_digest"))


def run_documents(spark: SparkSession, sf: str) -> DataFrame:
    """One document per run (step and attempt): its id, its version, its outcomes, and the time of the step."""
    r = run_view(spark, sf).groupBy("step", "attempt").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("passed", "failed", "skipped")])
    date = F.make_date(F.col("step") + 1995, F.lit(1), F.lit(1)).cast("timestamp_ntz")
    return r.select(F.concat_ws("-", F.lit("run/step"), "step", "attempt").alias("id"), F.concat(F.lit("c"), "step").alias("version"), F.unix_micros(date.cast("timestamp")).alias("at_us"), "passed", "failed", "skipped")


def code_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Code at step 5: every path with its content there and the step of its last change, which is its version."""
    s = temporal.last_change(_states(spark, sf).where("step <= 5"), "path", "step", "blob")
    return s.where("step = 5").select(F.concat(F.lit("code/"), F.col("path").cast("string")).alias("id"), "blob", F.concat(F.lit("c"), F.col("changed_step").cast("string")).alias("version"))


def document_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """All documents with a text, by source: how many, their characters and bytes; texts with NUL characters are binaries and left out."""
    d = table(spark, sf, "documents").where("text IS NOT NULL").where(~F.col("text").contains("\x00"))
    return d.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text").cast("bigint")).alias("bytes"))


def service_names(spark: SparkSession, sf: str) -> DataFrame:
    """Top directories of code without those of tests and documents."""
    rows = registry(spark, sf, "id", once=False).where("id LIKE 'code/%'").select(F.split_part("id", F.lit("/"), F.lit(2)).alias("name"))
    return rows.where(~F.col("name").isin("tests", "test", "docs", "doc", "") & ~F.col("name").contains(".")).distinct()


def value_to_step(spark: SparkSession, sf: str) -> DataFrame:
    """Facts whose start is, to a second, the instant of a registration of the page that they cite: an equi-join on seconds, the neighbours included."""
    reg = registry(spark, sf, "id", "ingested_at", once=False).where("ingested_at IS NOT NULL").select(F.col("id").alias("document_id"), F.unix_micros(F.col("ingested_at").cast("timestamp")).alias("r")).distinct()
    facts = stored(spark, sf, "document_id", "valid_at").where("valid_at IS NOT NULL").select("id", "document_id", F.unix_micros(F.col("valid_at").cast("timestamp")).alias("v"))
    second = lambda c: F.floor(F.col(c) / 1_000_000)
    near = reg.withColumn("s", F.explode(F.array(second("r") - 1, second("r"), second("r") + 1)))
    hit = facts.withColumn("s", second("v")).join(near, ["document_id", "s"]).where(F.abs(F.col("v") - F.col("r")) <= 1_000_000)
    all_ = facts.join(reg.select("document_id").distinct(), "document_id").agg(F.count("*").alias("n_facts"))
    return hit.agg(F.countDistinct("id").alias("n_at_step")).join(F.broadcast(all_))  # one row beside one row


def store_clock(spark: SparkSession, sf: str) -> DataFrame:
    """Storing times made strictly increasing within a source: never before, and at least a microsecond after, the one before."""
    rows = stored(spark, sf, "source_key", "created_at").where("source_key IS NOT NULL AND created_at IS NOT NULL")
    w = W.partitionBy("source_key").orderBy("us", "id")
    rows = rows.select("id", "source_key", F.unix_micros(F.col("created_at").cast("timestamp")).alias("us")).withColumn("n", F.row_number().over(w))
    return rows.select("id", (F.max(F.col("us") - F.col("n")).over(w.rowsBetween(W.unboundedPreceding, 0)) + F.col("n")).alias("clock_us"))


def unknown_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Runs at steps that no overlay of any path knows."""
    known = table(spark, sf, "orders").select((F.col("o_orderkey") % 4).cast("int").alias("step")).distinct()
    return run_view(spark, sf).join(known, "step", "left_anti").groupBy("step").agg(F.count("*").alias("n"))


def entities_found(spark: SparkSession, sf: str) -> DataFrame:
    """For every question the entities that the facts found for it are about."""
    hits = hybrid_rrf(spark, sf).join(stored(spark, sf, "claim_entity").where("claim_entity IS NOT NULL"), "id")
    return hits.select("q", F.col("claim_entity").alias("entity")).distinct().join(_names(spark, sf), "entity", "left").select("q", "entity", F.coalesce("name", "entity").alias("name"))


def ingest_report(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of an ingest: rows, facts, claims, entities, documents cited, tiers."""
    rows = stored(spark, sf, "base_id", "claim_entity", "document_id", "tier")
    return rows.agg(
        F.count("*").alias("rows"), F.countDistinct("base_id").alias("facts"), F.count("claim_entity").alias("claims"), F.countDistinct("claim_entity").alias("entities"),
        F.countDistinct("document_id").alias("documents"), *[F.count_if(F.col("tier") == t).alias(t) for t in norm.TIER_RANK],
    )


def nearest_in_kind(spark: SparkSession, sf: str) -> DataFrame:
    """For every entity whose id (a hexadecimal number) is divisible by 20 the closest other entity of its kind, at a cosine of 0.8 or more."""
    e = table(spark, sf, "entity").where("id IS NOT NULL AND kind IS NOT NULL").select("id", "kind", "embedding").distinct()
    asked = e.where("cast(conv(substring(id, 3), 16, 10) as bigint) % 20 = 0").select(F.col("id").alias("q"), "kind", "embedding")
    near = search.vector_search(e, asked, "id", "embedding", limit=2, floor=0.8, within="kind").where("q <> id")
    return near.groupBy("q").agg(F.max(F.struct("score", "id")).alias("m"), F.max("score").alias("score")).select("q", "score")


def upsert_plan(spark: SparkSession, sf: str) -> DataFrame:
    """What an ingest does with each observation stored after June 2025, seen by itself against the facts before: rejected without a citation, a new fact, the next episode, or merged."""
    rows = stored(spark, sf, "base_id", "document_id", "tier", "valid_at", "invalid_at", "created_at", "expired_at").where("base_id IS NOT NULL")
    cut = F.lit(f"{_CUT} 00:00:00").cast("timestamp_ntz")
    key = F.struct(F.coalesce("valid_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("v"), F.col("id").alias("i"), "invalid_at", "expired_at")
    latest = rows.where(F.col("created_at") < cut).groupBy("base_id").agg(F.max(key).alias("m"))
    new = rows.where(F.col("created_at") >= cut).join(latest, "base_id", "left")
    ended = F.col("m.invalid_at").isNotNull() & (
        (F.col("valid_at").isNotNull() & (F.col("valid_at") >= F.col("m.invalid_at"))) | ((F.col("tier") == "documented") & F.col("invalid_at").isNull())
    )
    plan = (
        F.when(F.col("document_id").isNull(), "rejected").when(F.col("m").isNull(), "new")
        .when(F.col("m.expired_at").isNotNull() | F.coalesce(ended, F.lit(False)), "next episode").otherwise("merged")
    )
    return new.select("id", plan.alias("plan"))


def value_on_page(spark: SparkSession, sf: str) -> DataFrame:
    """Facts by whether all numbers that they state stand in a text of the document that they cite."""
    facts = stored(spark, sf, "document_id", "statement").where("document_id IS NOT NULL AND statement IS NOT NULL")
    facts = facts.select("id", "document_id", norm.numbers(F.col("statement")).alias("ns")).where(F.size("ns") > 0)
    pages = table(spark, sf, "documents").where("document_id IS NOT NULL AND text IS NOT NULL").select("document_id", norm.numbers(F.col("text")).alias("ps")).distinct()
    hit = facts.join(pages, "document_id").groupBy("id").agg(F.max((F.size(F.array_except("ns", "ps")) == 0).cast("int")).alias("there"))
    return hit.groupBy("there").agg(F.count("*").alias("n"))


def version_cited(spark: SparkSession, sf: str) -> DataFrame:
    """Facts whose document has a registration with a version that the fact's detail or source names."""
    reg = registry(spark, sf, "id", "version", once=False).where("version IS NOT NULL AND version <> ''").select(F.col("id").alias("document_id"), "version").distinct()
    facts = stored(spark, sf, "document_id", "detail", "source_key").where("document_id IS NOT NULL")
    hit = facts.join(reg, "document_id").withColumn("named", F.concat_ws(" ", "detail", "source_key").contains(F.col("version")))
    return hit.groupBy("id").agg(F.max("named").alias("named")).groupBy("named").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        fact_citations, fact_display, test_nodes, claim_payload, money_text, facts_by_category, never_skipped, contradictions_in_scope, contradictions_upsert, prose_contradictions,
        document_facts, matcher_calibration, recall_at_10, word_overlap, number_kinds, entity_norms, run_documents, code_documents, document_manifest, service_names, value_to_step,
        store_clock, unknown_steps, entities_found, ingest_report, nearest_in_kind, upsert_plan, value_on_page, version_cited,
    )
}

_NAMES = "(SELECT id entity, min(name) AS name FROM (SELECT id, name FROM entity_catalog UNION ALL SELECT id, name FROM entity) WHERE id IS NOT NULL AND name IS NOT NULL GROUP BY 1)"
_STATEMENTS = f"(SELECT base_id k, {_NORM} t, min(id) n FROM {STORED} WHERE base_id IS NOT NULL AND statement IS NOT NULL GROUP BY 1, 2)"
_WORDS = r"list_transform(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(regexp_replace({0}, '[-_]+', ' ', 'g')), '[^a-z0-9_\s]', '', 'g'), '\s+', ' ', 'g')), ' '), lambda w: w <> ''), lambda w: CASE WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END)"
_MATCHED = f"""(NOT ({_NEG.format('ta')} <> {_NEG.format('tb')} OR coalesce({_OUT.format('ta')} <> {_OUT.format('tb')}, false)
      OR len(list_filter(list_concat(list_filter({_BOUND.format('ta')}, lambda y: NOT list_contains({_BOUND.format('tb')}, y)), list_filter({_BOUND.format('tb')}, lambda y: NOT list_contains({_BOUND.format('ta')}, y))),
        lambda e: list_contains(list_transform({_BOUND.format('ta')}, lambda z: substr(z, 8)), substr(e, 8)) AND list_contains(list_transform({_BOUND.format('tb')}, lambda z: substr(z, 8)), substr(e, 8)))) > 0
      OR NOT CASE WHEN len({_NUMS.format('ta')}) = 0 THEN len({_NUMS.format('tb')}) = 0 ELSE len(list_filter({_NUMS.format('ta')}, lambda y: NOT list_contains({_NUMS.format('tb')}, y))) = 0 END) AND overlap >= 0.6)"""
_OVER = "round(len(list_intersect(x.w, y.w)) / least(len(x.w), len(y.w)), 6)"

ORACLE = {
    "fact_citations": f"""SELECT base_id, string_agg(document_id, '|' ORDER BY f, i) documents, count(*) n FROM (SELECT base_id, document_id, min(coalesce(created_at, TIMESTAMP '0001-01-01')) f, arg_min(id, row(coalesce(created_at, TIMESTAMP '0001-01-01'), id)) i
      FROM {STORED} WHERE base_id IS NOT NULL AND document_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1""",
    "fact_display": f"""SELECT id, coalesce(name, f.entity) AS name, "attribute", concat_ws(' ', "value", unit) shown FROM {FACT} f LEFT JOIN {_NAMES} n ON n.entity = f.entity WHERE "value" IS NOT NULL""",
    "test_nodes": f"SELECT CASE WHEN contains(k, 'tests/') AND (starts_with(k, '/') OR starts_with(k, 'tests/')) THEN regexp_replace(k, '^(/[^:]*/)?tests/', 'tests/') ELSE k END node, count(*) n_facts, min(id) first_id FROM (SELECT id, substr(source_key, 6) k FROM {STORED} WHERE source_key LIKE 'test:%') GROUP BY 1",
    "claim_payload": f"""SELECT id, CAST(json_object('entity', entity, 'attribute', "attribute", 'value', "value", 'unit', unit) AS VARCHAR) payload FROM {FACT} WHERE "value" IS NOT NULL AND unit IS NOT NULL""",
    "money_text": f"SELECT id, printf('$%.2f', round(claim_number, 2)) AS \"text\" FROM {STORED} WHERE claim_number IS NOT NULL AND NOT isnan(claim_number) AND regexp_matches(lower(claim_attribute), 'fee|price|amount|rate|cost') AND NOT regexp_matches(lower(claim_attribute), '(minute|day|hour|second)s?([^a-z]|$)')",
    "facts_by_category": f"SELECT tier, count(*) n FROM {STORED} WHERE category = 'business-logic' AND expired_at IS NULL GROUP BY 1",
    "never_skipped": f"SELECT node, count(*) n FROM {RUNS} GROUP BY 1 HAVING count(*) FILTER (outcome = 'skipped') = 0",
    "contradictions_in_scope": f"SELECT CAST(s.range AS INTEGER) step, count(*) n FROM {_pairs(FACT)} p JOIN range(7) s ON opened_us IS NULL OR opened_us <= (s.range * 120 + 19723) * 86400000000 GROUP BY 1",
    "contradictions_upsert": f"""SELECT CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'resolved' ELSE 'kept' END AS "state", count(*) n, min(least(o.opened_us, n.opened_us)) first_us
      FROM {_pairs(FACT, 'AND created_us <= 1748736000000000')} o FULL OUTER JOIN {_pairs(FACT)} n ON o.id = n.id GROUP BY 1""",
    "prose_contradictions": rf"""WITH m AS (SELECT DISTINCT document_id, entity_id e FROM documents WHERE document_id IS NOT NULL AND entity_id IS NOT NULL AND entity_id NOT IN (SELECT id FROM entity_catalog WHERE kind IN ('service', 'team'))),
      s AS (SELECT id, tier, document_id, {_NORM} t FROM {STORED} WHERE claim_entity IS NULL AND expired_at IS NULL AND statement IS NOT NULL),
      c AS (SELECT e, t, min(id) n, max(tier = 'documented') d, {_terms('t')} w FROM s JOIN m USING (document_id) GROUP BY e, t),
      p AS (SELECT x.n a, y.n b, x.t ta, y.t tb, {_OVER} o FROM c x JOIN c y ON x.e = y.e AND x.n < y.n AND len(x.w) > 0 AND len(y.w) > 0 WHERE x.d OR y.d)
      SELECT DISTINCT a, b FROM p WHERE o >= 0.35 AND ({_NEG.format('ta')} <> {_NEG.format('tb')} OR (len({_NUMS.format('ta')}) > 0 AND len({_NUMS.format('tb')}) > 0 AND list_sort({_NUMS.format('ta')}) <> list_sort({_NUMS.format('tb')})))""",
    "document_facts": f"SELECT document_id, CAST(r AS INTEGER) place, id FROM (SELECT document_id, id, row_number() OVER (PARTITION BY document_id ORDER BY {RANK.format('tier')} DESC, valid_at DESC NULLS LAST, id) r FROM {STORED} WHERE document_id IS NOT NULL) WHERE r <= 3",
    "matcher_calibration": f"""WITH c AS (SELECT claim_entity e, claim_attribute k, {_NORM} t, min(id) n, min(base_id) b FROM {STORED} WHERE base_id IS NOT NULL AND statement IS NOT NULL AND claim_entity IS NOT NULL AND claim_attribute IS NOT NULL GROUP BY 1, 2, 3),
      w AS (SELECT *, {_terms('t')} w FROM c WHERE t <> ''), p AS (SELECT x.t ta, y.t tb, x.b = y.b same, {_OVER} overlap FROM w x JOIN w y ON x.e = y.e AND x.k = y.k AND x.n < y.n AND len(x.w) > 0 AND len(y.w) > 0),
      j AS (SELECT same, {_MATCHED} found FROM p WHERE overlap >= 0.35)
      SELECT count(*) FILTER (found AND same) tp, count(*) FILTER (found AND NOT same) fp, count(*) FILTER (NOT found AND same) fn, count(*) FILTER (NOT found AND NOT same) tn FROM j""",
    "recall_at_10": """SELECT source, round(count(*) FILTER (ok AND r <= 10 AND n_chars IS NOT NULL) / nullif(count(*) FILTER (ok), 0), 6) r10 FROM (SELECT source, n_chars, coalesce(lang = 'en', false) ok,
      row_number() OVER (PARTITION BY source, n_chars IS NULL ORDER BY n_chars DESC, doc_id) r FROM documents) GROUP BY 1""",
    "word_overlap": f"""WITH c AS (SELECT k, n, {_WORDS.format('t')} w FROM {_STATEMENTS} WHERE t <> ''), p AS (SELECT x.n a, y.n b, x.w wa, y.w wb FROM c x JOIN c y ON x.k = y.k AND x.n < y.n WHERE len(x.w) > 0 AND len(y.w) > 0)
      SELECT a, b, overlap FROM (SELECT a, b, round(list_sum(list_transform(list_distinct(wa), lambda v: least(len(list_filter(wa, lambda z: z = v)), len(list_filter(wb, lambda z: z = v))))) / least(len(wa), len(wb)), 6) overlap FROM p) WHERE overlap >= 0.6""",
    "number_kinds": rf"""WITH t AS (SELECT unnest(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(lower(text), '{match.HTTP_CODE}', ' ', 'g'), '{match.CODE_CLASS}', ' ', 'g'), '{match.ORDINAL}', ' ', 'g'), '{match.NUMBER}')) x FROM documents WHERE text IS NOT NULL),
      n AS (SELECT CASE WHEN contains(replace(x, ',', ''), '.') AND NOT contains(x, ':') THEN regexp_replace(regexp_replace(replace(x, ',', ''), '0+(%?)$', '\1'), '\.(%?)$', '\1') ELSE replace(x, ',', '') END x FROM t)
      SELECT CASE WHEN x LIKE '$%' THEN 'money' WHEN x LIKE '%\%' ESCAPE '\' THEN 'percent' WHEN contains(x, ':') THEN 'time' ELSE 'plain' END kind, count(*) n, count(DISTINCT x) n_tokens, min(x) AS "first" FROM n GROUP BY 1""",
    "entity_norms": r"""WITH e AS (SELECT DISTINCT id, name FROM entity WHERE id IS NOT NULL AND name IS NOT NULL), b AS (SELECT id, CASE WHEN contains(name, ':') AND lower(trim(split_part(name, ':', 1))) IN (SELECT lower(kind) FROM entity_catalog) AND trim(substr(name, instr(name, ':') + 1)) <> ''
        THEN trim(substr(name, instr(name, ':') + 1)) ELSE name END n FROM e)
      SELECT id, md5(trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(n, '([a-z0-9])([A-Z])', '\1 \2', 'g'))), '[^a-z0-9_\s-]', '', 'g'), '\s+', ' ', 'g'))) name_digest, md5(regexp_replace(lower(trim(n)), '[\s\-_./]+', '', 'g')) fold_digest FROM b""",
    "run_documents": f"""SELECT 'run/step-' || step || '-' || attempt id, 'c' || step version, epoch_us(make_date(step + 1995, 1, 1)::TIMESTAMP) at_us, count(*) FILTER (outcome = 'passed') passed, count(*) FILTER (outcome = 'failed') failed, count(*) FILTER (outcome = 'skipped') skipped FROM {RUNS} GROUP BY step, attempt""",
    "code_documents": f"""WITH f AS (SELECT path, step, blob, CASE WHEN row_number() OVER w = 1 OR lag(blob) OVER w IS DISTINCT FROM blob THEN step END c FROM {_STATES} WHERE step <= 5 WINDOW w AS (PARTITION BY path ORDER BY step)),
      g AS (SELECT path, step, blob, max(c) OVER (PARTITION BY path ORDER BY step) v FROM f) SELECT 'code/' || path id, blob, 'c' || v version FROM g WHERE step = 5""",
    "document_manifest": "SELECT source, count(*) n, CAST(sum(length(text)) AS BIGINT) chars, CAST(sum(strlen(text)) AS BIGINT) bytes FROM documents WHERE text IS NOT NULL AND NOT contains(text, chr(0)) GROUP BY 1",
    "service_names": f"SELECT DISTINCT n AS name FROM (SELECT split_part(id, '/', 2) n FROM {REGISTRY} WHERE id LIKE 'code/%') WHERE n NOT IN ('tests', 'test', 'docs', 'doc', '') AND NOT contains(n, '.')",
    "value_to_step": f"""WITH r AS (SELECT DISTINCT id document_id, epoch_us(ingested_at) r FROM {REGISTRY} WHERE ingested_at IS NOT NULL AND id IS NOT NULL), f AS (SELECT id, document_id, epoch_us(valid_at) v FROM {STORED} WHERE valid_at IS NOT NULL)
      SELECT (SELECT count(DISTINCT f.id) FROM f JOIN r USING (document_id) WHERE abs(v - r) <= 1000000) n_at_step, (SELECT count(*) FROM f WHERE document_id IN (SELECT document_id FROM r)) n_facts""",
    "store_clock": f"""SELECT id, max(us - n) OVER (PARTITION BY source_key ORDER BY us, id ROWS UNBOUNDED PRECEDING) + n clock_us FROM (SELECT id, source_key, epoch_us(created_at) us, row_number() OVER (PARTITION BY source_key ORDER BY created_at, id) n
      FROM {STORED} WHERE source_key IS NOT NULL AND created_at IS NOT NULL)""",
    "unknown_steps": f"SELECT step, count(*) n FROM {RUNS} WHERE step NOT IN (SELECT CAST(o_orderkey % 4 AS INTEGER) FROM orders) GROUP BY 1",
    "entities_found": f"SELECT DISTINCT q, s.claim_entity entity, coalesce(n.name, s.claim_entity) AS name FROM ({_HYBRID}) h JOIN {STORED} s ON s.id = h.id LEFT JOIN {_NAMES} n ON n.entity = s.claim_entity WHERE s.claim_entity IS NOT NULL",
    "ingest_report": f"""SELECT count(*) AS "rows", count(DISTINCT base_id) facts, count(claim_entity) claims, count(DISTINCT claim_entity) entities, count(DISTINCT document_id) documents, count(*) FILTER (tier = 'executed') executed,
      count(*) FILTER (tier = 'code') code, count(*) FILTER (tier = 'documented') documented FROM {STORED}""",
    "nearest_in_kind": """WITH e AS (SELECT id, kind, any_value(CAST(embedding AS DOUBLE[])) v FROM entity WHERE id IS NOT NULL AND kind IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL)) = 0 GROUP BY 1, 2)
      SELECT q.id q, max(round(CASE WHEN isnan(list_cosine_similarity(q.v, e.v)) THEN 0 ELSE list_cosine_similarity(q.v, e.v) END, 6)) score FROM e q JOIN e ON q.kind = e.kind AND q.id <> e.id AND len(q.v) = len(e.v) WHERE CAST('0x' || substr(q.id, 3) AS BIGINT) % 20 = 0
        AND round(CASE WHEN isnan(list_cosine_similarity(q.v, e.v)) THEN 0 ELSE list_cosine_similarity(q.v, e.v) END, 6) >= 0.8 GROUP BY 1""",
    "upsert_plan": f"""WITH r AS (SELECT * FROM {STORED} WHERE base_id IS NOT NULL), l AS (SELECT * FROM (SELECT base_id, invalid_at i, expired_at x, row_number() OVER (PARTITION BY base_id ORDER BY coalesce(valid_at, TIMESTAMP '0001-01-01') DESC, id DESC) n FROM r WHERE created_at < TIMESTAMP '{_CUT}') WHERE n = 1)
      SELECT id, CASE WHEN document_id IS NULL THEN 'rejected' WHEN l.base_id IS NULL THEN 'new' WHEN x IS NOT NULL OR coalesce(i IS NOT NULL AND ((valid_at IS NOT NULL AND valid_at >= i) OR (tier = 'documented' AND invalid_at IS NULL)), false) THEN 'next episode' ELSE 'merged' END plan
      FROM r LEFT JOIN l USING (base_id) WHERE created_at >= TIMESTAMP '{_CUT}'""",
    "value_on_page": f"""WITH f AS (SELECT id, document_id, {_NUMS.format('statement')} ns FROM {STORED} WHERE document_id IS NOT NULL AND statement IS NOT NULL), p AS (SELECT document_id, {_NUMS.format('text')} ps FROM documents WHERE document_id IS NOT NULL AND text IS NOT NULL)
      SELECT there, count(*) n FROM (SELECT id, max(CASE WHEN len(list_filter(ns, lambda x: NOT list_contains(ps, x))) = 0 THEN 1 ELSE 0 END) there FROM f JOIN p USING (document_id) WHERE len(ns) > 0 GROUP BY 1) GROUP BY 1""",
    "version_cited": f"""WITH r AS (SELECT DISTINCT id document_id, version FROM {REGISTRY} WHERE version IS NOT NULL AND version <> '' AND id IS NOT NULL)
      SELECT named, count(*) n FROM (SELECT id, bool_or(contains(concat_ws(' ', detail, source_key), version)) named FROM {STORED} JOIN r USING (document_id) GROUP BY 1) GROUP BY 1""",
}
