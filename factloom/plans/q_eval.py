"""Queries that measure: evaluation, matching, leaks of eval items by their first words, streams; and the SQL of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import norm
from factloom.operators import evaluate, match
from factloom.plans.views import STORED, UNIT, stored
from factloom.scratch import Scratch
from factloom.session import ntz, table
from factloom.streaming import incremental


def _eval(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as answers: expected where the label is English, returned where the text is long enough."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return d.select(
        "doc_id", "source", F.coalesce(F.col("lang"), F.lit("none")).alias("category"),
        F.coalesce(F.col("lang") == "en", F.lit(False)).alias("expected"), F.coalesce(F.col("n_chars") > 400, F.lit(False)).alias("returned"),
    )


_EVAL = "(SELECT doc_id, source, coalesce(lang, 'none') category, coalesce(lang = 'en', false) expected, coalesce(n_chars > 400, false) returned FROM documents)"


def prf_by_surface(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.precision_recall(_eval(spark, sf), ["source"])


def prf_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Counts per source, per source and category, and in all, from one aggregate."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    rows = _eval(spark, sf).groupingSets([["source"], ["source", "category"], []], "source", "category")
    return rows.agg(n(F.col("expected") & F.col("returned")).alias("hit"), n(F.col("returned")).alias("got"), F.count("*").alias("n"))


def tier_confusion(spark: SparkSession, sf: str) -> DataFrame:
    """Tier as observed against the highest tier of the base fact."""
    rows = stored(spark, sf, "base_id", "tier").where("base_id IS NOT NULL")
    best = rows.groupBy("base_id").agg(F.max(F.struct(norm.tier_rank("tier").alias("r"), "tier")).alias("m")).select("base_id", F.col("m.tier").alias("best"))
    return rows.join(best, "base_id").groupBy("tier").pivot("best", ["executed", "code", "documented"]).count().na.fill(0)


def category_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored(spark, sf, "statement", "category", "tier").where("statement IS NOT NULL AND category IS NOT NULL")
    right = norm.category(F.col("statement")) == F.col("category")
    return rows.groupBy("tier").agg(F.count("*").alias("n"), evaluate.ratio(F.count_if(right), F.count("*")).alias("accuracy"))


def wilson_bound(spark: SparkSession, sf: str) -> DataFrame:
    rows = _eval(spark, sf).groupBy("source").agg(F.count_if(F.col("expected")).alias("hits"), F.count("*").alias("total"))
    return rows.withColumn("lower", evaluate.wilson_lower(F.col("hits"), F.col("total")))


def precision_at_5(spark: SparkSession, sf: str) -> DataFrame:
    """Precision among the five first answers (by length, then id) of every source; the denominator is at most what was returned."""
    from pyspark.sql import Window as W

    d = table(spark, sf, "documents").where("n_chars IS NOT NULL").select("doc_id", "source", "n_chars", F.coalesce(F.col("lang") == "en", F.lit(False)).alias("ok"))
    w = W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    top = d.withColumn("r", F.row_number().over(w)).where("r <= 5")
    return top.groupBy("source").agg(evaluate.ratio(F.count_if(F.col("ok")), F.count("*")).alias("p5"))


def duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Statements stored more than once for one document: surplus rows per tier."""
    rows = stored(spark, sf, "statement", "document_id", "tier").where("statement IS NOT NULL AND document_id IS NOT NULL")
    groups = rows.groupBy("tier", F.md5(norm.statement(F.col("statement"))).alias("s"), "document_id").agg(F.count("*").alias("n"))
    return groups.groupBy("tier").agg(F.sum(F.col("n") - 1).alias("surplus"))


def distinct_claims(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored(spark, sf, "claim_entity", "claim_attribute", "claim_number", "tier").where("claim_entity IS NOT NULL AND claim_attribute IS NOT NULL")
    return rows.groupBy("tier").agg(F.countDistinct("claim_entity", norm.attribute(F.col("claim_attribute"))).alias("n_claims"), F.countDistinct("claim_entity").alias("n_entities"))


def fidelity_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Facts at or above, and below, the fidelity 0.7 per tier; without a confidence they are unqualified."""
    c = F.col("confidence").cast("double")
    band = F.when(c.isNull() | F.isnan(c), "unqualified").when(c >= 0.7, "real").otherwise("below")
    return stored(spark, sf, "confidence", "tier").groupBy("tier", band.alias("band")).agg(F.count("*").alias("n"))


def headline(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted mean of F1 over sources, wiki and docs counting double, beside the plain mean."""
    f = prf_by_surface(spark, sf)
    w = F.when(F.col("source").isin("wiki", "docs"), 2.0).otherwise(1.0)
    return f.agg(F.round(F.sum(w * F.col("f1")) / F.sum(w), 6).alias("weighted"), F.round(F.avg("f1"), 6).alias("plain"))


def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where("value IS NOT NULL")
    q = lambda p: F.round(F.percentile("value", F.lit(p)), 6)
    return e.groupBy("event_type").agg(q(0.5).alias("p50"), q(0.95).alias("p95"), F.count("*").alias("n"))


def multi_run_median(spark: SparkSession, sf: str) -> DataFrame:
    """Median, least and greatest over users of each type's mean value."""
    e = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("m"))
    return e.groupBy("event_type").agg(F.round(F.median("m"), 6).alias("median"), F.round(F.min("m"), 6).alias("least"), F.round(F.max("m"), 6).alias("most"))


def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    """Interval of the mean difference between two types' number of events per user."""
    e = table(spark, sf, "events").where("user_id IS NOT NULL")
    kinds = e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").cast("double").alias("a"), F.count_if(F.col("event_type") == "view").cast("double").alias("b"))
    return evaluate.bootstrap(kinds, "user_id", "a", "b")


def statement_vetoes(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored(spark, sf, "statement").where("statement IS NOT NULL")
    s = F.col("statement")
    return rows.groupBy(match.negated(s).alias("negated"), match.allowed(s).alias("outcome")).agg(F.count("*").alias("n"))


def bound_directions(spark: SparkSession, sf: str) -> DataFrame:
    """Every bound of time that a document sets, one row each."""
    docs = table(spark, sf, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.explode(match.bounds(F.col("text"))).alias("bound"))


def _statements(spark: SparkSession, sf: str) -> DataFrame:
    """The different statements of every base fact."""
    return match.statement_classes(stored(spark, sf, "base_id", "statement"), ["base_id"])


def overlap_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Overlap of any two different statements of a base fact that share half of their terms, each named by its smallest fact."""
    return match.term_pairs(_statements(spark, sf), ["base_id"], 0.5).select("a", "b", "overlap")


def statement_members(spark: SparkSession, sf: str) -> DataFrame:
    """Every fact with the smallest one of its base fact and statement, which stands for it in pairs."""
    rows = stored(spark, sf, "base_id", "statement").where("base_id IS NOT NULL AND statement IS NOT NULL")
    said = rows.select("id", "base_id", norm.statement(F.col("statement")).alias("text")).where("text <> ''")
    return said.join(said.groupBy("base_id", "text").agg(F.min("id").alias("class")), ["base_id", "text"]).select("id", "class")


def claim_match(spark: SparkSession, sf: str) -> DataFrame:
    """How many pairs of observations of an entity's attributes there are, and how many agree in value and unit; counted by value and unit, not pair by pair."""
    rows = stored(spark, sf, "claim_entity", "claim_attribute", "claim_value", "claim_unit").where("claim_entity IS NOT NULL AND claim_attribute IS NOT NULL AND claim_value IS NOT NULL")
    value = F.coalesce(norm.number_text(norm.value_number(F.col("claim_value"))), norm.value_text(F.col("claim_value")))
    key = ["claim_entity", "att"]
    classes = rows.groupBy("claim_entity", norm.attribute(F.col("claim_attribute")).alias("att"), value.alias("value"), norm.unit(F.col("claim_unit")).alias("unit")).agg(F.count("*").alias("n"))
    # A missing unit agrees with any, two stated ones only if equal.
    values = classes.groupBy(*key, "value").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("unit").isNotNull(), F.col("n") * F.col("n"))).alias("same"), F.sum(F.when(F.col("unit").isNotNull(), F.col("n"))).alias("stated"))
    bare = F.col("n") - F.coalesce("stated", F.lit(0))
    ordered = F.coalesce("same", F.lit(0)) + bare * bare + 2 * bare * F.coalesce("stated", F.lit(0))
    keys = values.groupBy(*key).agg(F.sum("n").alias("n"), F.sum((ordered - F.col("n")) / 2).cast("bigint").alias("agree"))
    return keys.groupBy("claim_entity").agg(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("bigint")).alias("n_pairs"), F.sum("agree").alias("n_agree"))


def statement_match(spark: SparkSession, sf: str) -> DataFrame:
    """Any two different statements of a base fact that match: no veto, and 0.6 of the terms shared."""
    texts = _statements(spark, sf)
    pairs = match.term_pairs(texts, ["base_id"], 0.6)
    text = lambda c: texts.select("base_id", F.col("name").alias(c), F.col("text").alias(f"t_{c}"))
    wide = pairs.join(text("a"), ["base_id", "a"]).join(text("b"), ["base_id", "b"])
    return wide.where(match.statements_match(F.col("t_a"), F.col("t_b"))).select("a", "b", "overlap")


def greedy_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """Executed facts of an entity, the latest first, assigned one to one to its documented ones whose statements match: the same, or no veto and 0.6 of the terms shared."""
    rows = stored(spark, sf, "claim_entity", "statement", "tier", "valid_at").where("claim_entity IS NOT NULL AND statement IS NOT NULL")
    said = rows.select("id", "claim_entity", "tier", "valid_at", norm.statement(F.col("statement")).alias("text"))
    names = match.statement_classes(stored(spark, sf, "claim_entity", "statement"), ["claim_entity"])
    facts = said.join(names.select("claim_entity", "text", F.col("name").alias("side")), ["claim_entity", "text"]).withColumnRenamed("claim_entity", "grp")
    ordinal = -F.coalesce(F.unix_micros(F.col("valid_at").cast("timestamp")), F.lit(-(2**62)))
    got = facts.where("tier = 'executed'").select("grp", F.col("id").alias("returned"), "side", ordinal.alias("ordinal"))
    want = facts.where("tier = 'documented'").select("grp", F.col("id").alias("expected"), "side")
    near = match.term_pairs(names, ["claim_entity"], 0.6)
    text = lambda c: names.select("claim_entity", F.col("name").alias(c), F.col("text").alias(f"t_{c}"))
    near = near.join(text("a"), ["claim_entity", "a"]).join(text("b"), ["claim_entity", "b"]).where(match.statements_match(F.col("t_a"), F.col("t_b")))
    ends = F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    same = names.select("claim_entity", F.col("name").alias("a"), F.col("name").alias("b"), F.lit(1.0).alias("score"))
    pairs = near.select("claim_entity", F.col("overlap").alias("score"), ends).select("claim_entity", "a", "b", "score").unionByName(same).withColumnRenamed("claim_entity", "grp")
    wanted = want.select("grp", F.col("side").alias("b")).distinct()
    asking = got.select("grp", F.col("side").alias("a")).distinct()
    return match.assign(got, want, pairs.join(wanted, ["grp", "b"], "left_semi").join(asking, ["grp", "a"], "left_semi")).withColumnRenamed("grp", "claim_entity")


def leak_prefix8(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold the first eight words of an eval item, compared without case and marks: an equi-join of eight-word runs."""
    d, i = table(spark, sf, "documents"), table(spark, sf, "eval_item")
    words = lambda c: F.split(norm.plain(F.col(c)), " ")
    runs = d.where("text IS NOT NULL").select("doc_id", words("text").alias("w")).where(F.size("w") >= 8)
    runs = runs.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda n: F.array_join(F.slice("w", n, 8), " ")))).alias("run"))
    heads = i.where("text IS NOT NULL").select("item_id", F.array_join(F.slice(words("text"), 1, 8), " ").alias("run"), F.size(words("text")).alias("n")).where("n >= 8")
    return runs.join(heads, "run").select("doc_id", "item_id").distinct()


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.read_events(spark, f"{sf}/events.parquet")


def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """Daily counts per event type of all windows that the watermark has closed."""
    stream = incremental.tumbling(_events(spark, sf)).drop("total")
    return ntz(incremental.drain(stream, stream.schema, Scratch(spark, "stream"), "tumbling"))


def stream_session(spark: SparkSession, sf: str) -> DataFrame:
    stream = incremental.sessions(_events(spark, sf))
    return ntz(incremental.drain(stream, stream.schema, Scratch(spark, "stream"), "sessions"))


def stream_incremental_facts(spark: SparkSession, sf: str) -> DataFrame:
    """The latest event of every user, upserted batch by batch."""
    rows = _events(spark, sf).where("user_id IS NOT NULL").select("user_id", "ts", "event_id", "event_type")
    out = incremental.latest_by_key(rows, f"{Scratch(spark, 'stream').root}/latest", ["user_id"], ["ts", "event_id"])
    return out.select("user_id", "event_id", "event_type")


QUERIES = {
    f.__name__: f
    for f in (
        prf_by_surface, prf_grouping_sets, tier_confusion, category_accuracy, wilson_bound, precision_at_5, duplicates, distinct_claims, fidelity_bands, headline,
        latency_percentiles, multi_run_median, bootstrap_ci, statement_vetoes, bound_directions, overlap_similarity, statement_members, claim_match, statement_match, greedy_assignment,
        leak_prefix8, stream_tumbling, stream_session, stream_incremental_facts,
    )
}

_PRF = f"""(SELECT source, hit, got, want, round(hit / nullif(got, 0), 6) AS "precision", round(hit / nullif(want, 0), 6) recall FROM (SELECT source, CAST(count(*) FILTER (expected AND returned) AS BIGINT) hit,
  CAST(count(*) FILTER (returned) AS BIGINT) got, CAST(count(*) FILTER (expected) AS BIGINT) want FROM {_EVAL} GROUP BY 1))"""
_F1 = """round(CASE WHEN "precision" IS NULL THEN recall WHEN recall IS NULL THEN "precision" WHEN "precision" + recall > 0 THEN 2 * "precision" * recall / ("precision" + recall) ELSE 0 END, 6)"""
_STOP = ", ".join(f"'{w}'" for w in norm.STOPWORDS)


def _terms(text: str) -> str:
    words = f"list_filter(list_transform(regexp_extract_all(lower({text}), '[a-z0-9$%.]+'), lambda w: trim(w, '.')), lambda w: w <> '' AND w NOT IN ({_STOP}))"
    return f"list_distinct(list_transform({words}, lambda w: CASE WHEN length(w) > 4 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END))"


_NEG = r"regexp_matches(lower({0}), '(^|[^a-z])(not|never|no|none|without|off|cannot|can''t|isn''t|doesn''t|no longer)([^a-z]|$)')"
_OUT = "CASE WHEN regexp_matches(lower({0}), 'reject|refus|den(y|ied)|must not|fails?([^a-z]|$)') THEN 'refused' WHEN regexp_matches(lower({0}), 'accept|allow|grant|succeed|still returns') THEN 'allowed' END"
_SIDES = "(" + "|".join((*match.INSIDE, *match.BEYOND)) + ")"
_PAT = rf"'(^|[^a-z0-9_]){_SIDES}\s+([0-9]+(?:\.[0-9]+)?)\s+({'|'.join(match.TIMES)})s?([^a-z0-9_]|$)'"
_T = rf"regexp_replace(lower({{0}}), '(^|[^a-z0-9_])the\s+{_SIDES}\s', '\1', 'g')"
_SIDE = ", ".join(f"'{w}'" for w in match.INSIDE)
_BOUND = (
    f"list_sort(list_distinct(list_transform(list_zip(regexp_extract_all({_T}, {_PAT}, 2), regexp_extract_all({_T}, {_PAT}, 3), regexp_extract_all({_T}, {_PAT}, 4)), "
    rf"lambda x: CASE WHEN x[1] IN ({_SIDE}) THEN 'inside ' ELSE 'beyond ' END || CASE WHEN contains(x[2], '.') THEN rtrim(rtrim(x[2], '0'), '.') ELSE x[2] END || ' ' || x[3])))"
)
_NUMS = r"list_distinct(list_transform(regexp_extract_all({0}, '[0-9]+(?:\.[0-9]+)?'), lambda x: CASE WHEN contains(x, '.') THEN rtrim(rtrim(x, '0'), '.') ELSE x END))"
_NORM = r"regexp_replace(regexp_replace(trim(lower(statement)), '\s+', ' ', 'g'), '[ .]+$', '')"


def _classes(key: str) -> str:
    return f"(SELECT {key} k, {_NORM} t, min(id) n FROM {STORED} WHERE {key} IS NOT NULL AND statement IS NOT NULL GROUP BY 1, 2 HAVING {_NORM.replace('statement', 'any_value(statement)')} <> '')"


def _overlaps(key: str) -> str:
    """Any two statements of a key with their overlap."""
    w = f"(SELECT k, n, t, {_terms('t')} w FROM {_classes(key)})"
    return f"(SELECT x.k, x.n a, y.n b, x.t ta, y.t tb, round(len(list_intersect(x.w, y.w)) / least(len(x.w), len(y.w)), 6) overlap FROM {w} x JOIN {w} y ON x.k = y.k AND x.n < y.n AND len(x.w) > 0 AND len(y.w) > 0)"


_VALUE = "replace(lower(trim(claim_value)), ',', '')"
_NUM = r"'^\$?\s*(-?[0-9]+(?:\.[0-9]+)?)\s*(?:%|usd)?$'"
_UNIT = UNIT

ORACLE = {
    "prf_by_surface": f"SELECT *, {_F1} f1 FROM {_PRF}",
    "prf_grouping_sets": f"SELECT source, category, CAST(count(*) FILTER (expected AND returned) AS BIGINT) hit, CAST(count(*) FILTER (returned) AS BIGINT) got, count(*) n FROM {_EVAL} GROUP BY GROUPING SETS ((source), (source, category), ())",
    "tier_confusion": f"""WITH b AS (SELECT base_id, max(CASE tier WHEN 'executed' THEN 3 WHEN 'code' THEN 2 WHEN 'documented' THEN 1 ELSE 0 END) m FROM {STORED} WHERE base_id IS NOT NULL GROUP BY 1)
      SELECT tier, count(*) FILTER (m = 3) executed, count(*) FILTER (m = 2) code, count(*) FILTER (m = 1) documented FROM {STORED} JOIN b USING (base_id) GROUP BY 1""",
    "category_accuracy": f"""SELECT tier, count(*) n, round(count(*) FILTER (category = CASE WHEN regexp_matches(lower(statement), '(^|[^0-9])[1-5][0-9]{{2}}([^0-9]|$)') OR regexp_matches(lower(statement), '(^|[^a-z])publish')
      OR regexp_matches(lower(statement), '[a-z_]+/[a-z_]+') THEN 'technical-implementation' ELSE 'business-logic' END) / count(*), 6) accuracy FROM {STORED} WHERE statement IS NOT NULL AND category IS NOT NULL GROUP BY 1""",
    "wilson_bound": f"""SELECT source, hits, total, round((p + 3.8416 / (2 * n) - 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n), 6) AS "lower" FROM
      (SELECT source, count(*) FILTER (expected) hits, count(*) total, CAST(count(*) AS DOUBLE) n, count(*) FILTER (expected) / CAST(count(*) AS DOUBLE) p FROM {_EVAL} GROUP BY 1)""",
    "precision_at_5": "SELECT source, round(count(*) FILTER (ok) / count(*), 6) p5 FROM (SELECT source, coalesce(lang = 'en', false) ok, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) r FROM documents WHERE n_chars IS NOT NULL) WHERE r <= 5 GROUP BY 1",
    "duplicates": rf"SELECT tier, CAST(sum(n - 1) AS BIGINT) surplus FROM (SELECT tier, regexp_replace(regexp_replace(trim(lower(statement)), '\s+', ' ', 'g'), '[ .]+$', '') s, document_id, count(*) n FROM {STORED} WHERE statement IS NOT NULL AND document_id IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1",
    "distinct_claims": f"SELECT tier, count(DISTINCT claim_entity || chr(1) || trim(regexp_replace(lower(claim_attribute), '[^a-z0-9]+', '_', 'g'), '_')) n_claims, count(DISTINCT claim_entity) n_entities FROM {STORED} WHERE claim_entity IS NOT NULL AND claim_attribute IS NOT NULL GROUP BY 1",
    "fidelity_bands": f"SELECT tier, CASE WHEN confidence IS NULL OR isnan(confidence) THEN 'unqualified' WHEN CAST(confidence AS DOUBLE) >= 0.7 THEN 'real' ELSE 'below' END band, count(*) n FROM {STORED} GROUP BY 1, 2",
    "headline": f"SELECT round(sum(w * f1) / sum(w), 6) weighted, round(avg(f1), 6) plain FROM (SELECT {_F1} f1, CASE WHEN source IN ('wiki', 'docs') THEN 2.0 ELSE 1.0 END w FROM {_PRF})",
    "latency_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) p50, round(quantile_cont(value, 0.95), 6) p95, count(*) n FROM events WHERE value IS NOT NULL GROUP BY 1",
    "multi_run_median": "SELECT event_type, round(median(m), 6) median, round(min(m), 6) least, round(max(m), 6) most FROM (SELECT event_type, user_id, avg(value) m FROM events GROUP BY 1, 2) GROUP BY 1",
    "bootstrap_ci": """WITH k AS (SELECT user_id, CAST(count(*) FILTER (event_type = 'click') AS DOUBLE) - CAST(count(*) FILTER (event_type = 'view') AS DOUBLE) d FROM events WHERE user_id IS NOT NULL GROUP BY 1),
      x AS (SELECT r, d, CAST('0x' || substr(md5('17|' || r || '|' || user_id), 1, 8) AS BIGINT) / 4294967296.0 u FROM k, (SELECT range r FROM range(200))),
      w AS (SELECT r, d, CASE WHEN u < 0.367879 THEN 0 WHEN u < 0.735759 THEN 1 WHEN u < 0.919699 THEN 2 WHEN u < 0.981012 THEN 3 WHEN u < 0.99634 THEN 4 WHEN u < 0.999406 THEN 5 WHEN u < 0.999917 THEN 6 ELSE 7 END w FROM x),
      m AS (SELECT r, sum(w * d) / sum(w) m FROM w GROUP BY 1)
      SELECT count(*) rounds, round(quantile_cont(m, 0.025), 6) lo, round(quantile_cont(m, 0.975), 6) hi FROM m""",
    "statement_vetoes": f"SELECT {_NEG.format('statement')} negated, {_OUT.format('statement')} outcome, count(*) n FROM {STORED} WHERE statement IS NOT NULL GROUP BY 1, 2",
    "bound_directions": f"SELECT doc_id, unnest({_BOUND.format('text')}) bound FROM documents WHERE text IS NOT NULL",
    "overlap_similarity": f"SELECT a, b, overlap FROM {_overlaps('base_id')} WHERE overlap >= 0.5",
    "statement_members": f"SELECT id, n AS \"class\" FROM (SELECT *, {_NORM} t FROM {STORED}) f JOIN {_classes('base_id')} c ON f.base_id = c.k AND f.t = c.t",
    "claim_match": rf"""WITH r AS (SELECT id, claim_entity e, trim(regexp_replace(lower(claim_attribute), '[^a-z0-9]+', '_', 'g'), '_') a, {_VALUE} v, lower(trim(claim_unit)) u FROM {STORED} WHERE claim_entity IS NOT NULL AND claim_attribute IS NOT NULL AND claim_value IS NOT NULL),
      k AS (SELECT id, e, a, CASE WHEN regexp_matches(v, {_NUM}) THEN CAST(CAST(CAST(regexp_extract(v, {_NUM}, 1) AS DOUBLE) AS DECIMAL(28,6)) AS VARCHAR) ELSE v END v, {_UNIT} unit FROM r)
      SELECT x.e claim_entity, count(y.id) n_pairs, count(*) FILTER (x.v = y.v AND (x.unit IS NULL OR y.unit IS NULL OR x.unit = y.unit)) n_agree
      FROM k x LEFT JOIN k y ON x.e = y.e AND x.a = y.a AND x.id < y.id GROUP BY 1""",
    "statement_match": f"""SELECT a, b, overlap FROM {_overlaps('base_id')} WHERE overlap >= 0.6 AND NOT ({_NEG.format('ta')} <> {_NEG.format('tb')} OR coalesce({_OUT.format('ta')} <> {_OUT.format('tb')}, false)
      OR len(list_filter(list_concat(list_filter({_BOUND.format('ta')}, lambda y: NOT list_contains({_BOUND.format('tb')}, y)), list_filter({_BOUND.format('tb')}, lambda y: NOT list_contains({_BOUND.format('ta')}, y))),
        lambda e: list_contains(list_transform({_BOUND.format('ta')}, lambda z: substr(z, 8)), substr(e, 8)) AND list_contains(list_transform({_BOUND.format('tb')}, lambda z: substr(z, 8)), substr(e, 8)))) > 0
      OR NOT CASE WHEN len({_NUMS.format('ta')}) = 0 THEN len({_NUMS.format('tb')}) = 0 ELSE len(list_filter({_NUMS.format('ta')}, lambda y: NOT list_contains({_NUMS.format('tb')}, y))) = 0 END)""",
    "leak_prefix8": r"""WITH p AS (SELECT doc_id, ' ' || trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9_\s]', '', 'g'), '\s+', ' ', 'g')) || ' ' t FROM documents WHERE text IS NOT NULL),
      w AS (SELECT item_id, string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9_\s]', '', 'g'), '\s+', ' ', 'g')), ' ') w FROM eval_item WHERE text IS NOT NULL)
      SELECT DISTINCT doc_id, item_id FROM p JOIN w ON len(w) >= 8 AND contains(t, ' ' || array_to_string(w[1:8], ' ') || ' ')""",
    "stream_tumbling": """SELECT time_bucket(INTERVAL '1 day', ts) AS "start", event_type, count(*) n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2
      HAVING time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)""",
    "stream_session": """WITH s AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '6 hours' THEN 0 ELSE 1 END f FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      i AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM s)
      SELECT min(ts) AS "start", user_id, count(*) n FROM i GROUP BY user_id, k HAVING max(ts) + INTERVAL '6 hours' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)""",
    "stream_incremental_facts": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC, event_type DESC) r FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL) WHERE r = 1",
}
