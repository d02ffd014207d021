"""Queries over ordered steps, runs, registrations and streams; and the SQL of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.operators import runs, temporal
from factloom.plans.views import REGISTRY, RUNS, registry, runs as run_view
from factloom.session import table


_OVERLAY = "(SELECT o_custkey path, CAST(o_orderkey % 7 AS INTEGER) step, max(o_orderkey) content FROM orders GROUP BY 1, 2)"


def content_at_step(spark: SparkSession, sf: str) -> DataFrame:
    """Forward as-of: the content of every path at every step is that of its next overlay."""
    overlay = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("path"), (F.col("o_orderkey") % 7).cast("int").alias("step")).agg(F.max("o_orderkey").alias("content"))
    return temporal.forward_asof(overlay, list(range(7)), "path", "step", "content")


def active_paths(spark: SparkSession, sf: str) -> DataFrame:
    return content_at_step(spark, sf).where("content IS NOT NULL").groupBy("step").agg(F.count("*").alias("n_paths"))


def _states(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("path"), (F.year("l_shipdate") - 1995).cast("int").alias("step")).agg((F.count("*") % 3).cast("int").alias("blob"))


_STATES = "(SELECT l_suppkey path, CAST(year(l_shipdate) - 1995 AS INTEGER) step, CAST(count(*) % 3 AS INTEGER) blob FROM lineitem GROUP BY 1, 2)"


def last_change(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.last_change(_states(spark, sf), "path", "step", "blob")


def changed_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Paths whose content differs between steps 2 and 5, those that came or went included."""
    s = _states(spark, sf)
    a, b = s.where("step = 2").select("path", F.col("blob").alias("before")), s.where("step = 5").select("path", F.col("blob").alias("after"))
    return a.join(b, "path", "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


def constant_change_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Constants (here the prices asked for a part in a year, as text) whose text differs between two steps or that only one step has."""
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("name"), "l_discount", "l_quantity", (F.year("l_shipdate") - 1995).cast("int").alias("step")).where("step IN (1, 4)")
    text = F.concat_ws("@", F.max(F.struct("l_quantity", "l_discount"))["l_quantity"].cast("int").cast("string"), F.round(F.max(F.struct("l_quantity", "l_discount"))["l_discount"] * 100).cast("int").cast("string"))
    const = li.groupBy("name", "step").agg(text.alias("value"))
    both = const.groupBy("name").agg(F.max(F.when(F.col("step") == 1, F.col("value"))).alias("before"), F.max(F.when(F.col("step") == 4, F.col("value"))).alias("after"))
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def run_flaky(spark: SparkSession, sf: str) -> DataFrame:
    return runs.by_step(run_view(spark, sf)).where("flaky").select("node", "step")


def run_latest_attempt(spark: SparkSession, sf: str) -> DataFrame:
    return runs.by_step(run_view(spark, sf)).select("node", "step", "outcome")


def demotion_state(spark: SparkSession, sf: str) -> DataFrame:
    return runs.demotion(run_view(spark, sf))


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    steps = F.explode(F.sequence(F.lit(0), F.lit(6))).alias("step")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("node"), steps).where("(node + step) % 5 = 0")


_CHANGES = "(SELECT p_partkey node, CAST(range AS INTEGER) step FROM part, range(7) WHERE (p_partkey + range) % 5 = 0)"


def tier_lift(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes executed at step 5: the latest pass counts unless the node's path changed after it."""
    return runs.lifted(run_view(spark, sf), _changes(spark, sf), 5)


def lift_invalidated_by_change(spark: SparkSession, sf: str) -> DataFrame:
    all_runs = run_view(spark, sf)
    passed = all_runs.where("outcome = 'passed' AND step <= 5").groupBy("node").agg(F.max("step").alias("pass_step"))
    return passed.join(tier_lift(spark, sf).select("node"), "node", "left_anti")


def unexpected_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Every node is expected to pass at steps 2 and 4."""
    steps = F.explode(F.array(F.lit(2), F.lit(4))).alias("step")
    expected = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), steps).withColumn("expected", F.lit("passed"))
    return runs.unexpected(expected, run_view(spark, sf))


def rerun_failed(spark: SparkSession, sf: str) -> DataFrame:
    """Failed first attempts and what their second attempt gave."""
    r = run_view(spark, sf)
    first = r.where("attempt = 1 AND outcome = 'failed'").select("node", "step")
    return first.join(r.where("attempt = 2").select("node", "step", F.col("outcome").alias("second")), ["node", "step"], "left")


def documents_changed(spark: SparkSession, sf: str) -> DataFrame:
    """Registrations that differ in version or hash from the registration of the document before."""
    w = W.partitionBy("id").orderBy("ingested_at", "reg_id")
    rows = registry(spark, sf, "id", "version", "content_hash", "ingested_at")
    known = rows.withColumns({"n": F.row_number().over(w), "v": F.lag("version").over(w), "h": F.lag("content_hash").over(w)})
    changed = (F.col("n") == 1) | ~F.col("v").eqNullSafe(F.col("version")) | ~F.col("h").eqNullSafe(F.col("content_hash"))
    return known.where(changed).select("reg_id", "id")


def documents_pending(spark: SparkSession, sf: str) -> DataFrame:
    """Registered documents that no stored fact cites."""
    cited = table(spark, sf, "stored_fact").where("document_id IS NOT NULL").select(F.col("document_id").alias("id")).distinct()
    return registry(spark, sf, "id", once=False).select("id").distinct().join(cited, "id", "left_anti")


def document_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The current row of every document after all registrations: the latest one, with the first title seen kept if it has none."""
    at = F.struct("ingested_at", "reg_id")
    latest = registry(spark, sf, "id", "ingested_at", "version", "visibility", "title", once=False).groupBy("id").agg(
        F.max(F.struct("ingested_at", "reg_id", "version", "visibility")).alias("m"), F.min(F.when(F.col("title").isNotNull(), F.struct(at.alias("at"), "title"))).alias("t")
    )
    return latest.select("id", "m.reg_id", "m.version", "m.visibility", F.col("t.title").alias("title"))


def failure_streaks(spark: SparkSession, sf: str) -> DataFrame:
    """Users with three or more of one kind of event in a row."""
    e = table(spark, sf, "events").where("user_id IS NOT NULL AND ts IS NOT NULL")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = e.withColumn("same", F.coalesce(F.lag("event_type").over(w) == F.col("event_type"), F.lit(False)))
    runs_ = rows.withColumn("island", F.sum(F.when(F.col("same"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs_.groupBy("user_id", "island", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event")).where("n >= 3").drop("island")


def budget_running_total(spark: SparkSession, sf: str) -> DataFrame:
    """The first event of every user at which the running total of values passes 80 % of the user's total."""
    e = table(spark, sf, "events").where("user_id IS NOT NULL").select("user_id", "ts", "event_id", F.coalesce("value", F.lit(0.0)).cast("decimal(18,4)").alias("value"))
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    whole = e.groupBy("user_id").agg(F.sum("value").alias("whole"))
    run = e.withColumn("spent", F.sum("value").over(w)).join(whole, "user_id").where(F.col("spent") * 5 > F.col("whole") * 4)
    return run.groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("m")).select("user_id", F.col("m.event_id").alias("event_id"))


QUERIES = {
    f.__name__: f
    for f in (
        content_at_step, active_paths, last_change, changed_paths, constant_change_diff, run_flaky, run_latest_attempt, demotion_state, tier_lift,
        lift_invalidated_by_change, unexpected_outcomes, rerun_failed, documents_changed, documents_pending, document_upsert, failure_streaks, budget_running_total,
    )
}

_BY_STEP = f"(SELECT node, step, arg_max(outcome, attempt) outcome, bool_or(outcome = 'passed') AND bool_or(outcome = 'failed') flaky FROM {RUNS} GROUP BY 1, 2)"
_CONTENT = f"(SELECT p.path, CAST(s.range AS INTEGER) step, arg_min(o.content, o.step) content FROM (SELECT DISTINCT path FROM {_OVERLAY}) p CROSS JOIN range(7) s LEFT JOIN {_OVERLAY} o ON o.path = p.path AND o.step >= s.range GROUP BY 1, 2)"
_LIFT = f"""(SELECT l.node, pass_step FROM (SELECT node, max(step) pass_step FROM {RUNS} WHERE outcome = 'passed' AND step <= 5 GROUP BY 1) l
  LEFT JOIN (SELECT node, max(step) changed FROM {_CHANGES} WHERE step <= 5 GROUP BY 1) c ON l.node = c.node WHERE changed IS NULL OR changed <= pass_step)"""

ORACLE = {
    "content_at_step": f"SELECT path, step, content FROM {_CONTENT}",
    "active_paths": f"SELECT step, count(*) n_paths FROM {_CONTENT} WHERE content IS NOT NULL GROUP BY 1",
    "last_change": f"""WITH f AS (SELECT path, step, blob, CASE WHEN row_number() OVER w = 1 OR lag(blob) OVER w IS DISTINCT FROM blob THEN step END c FROM {_STATES} WINDOW w AS (PARTITION BY path ORDER BY step))
      SELECT path, step, blob, max(c) OVER (PARTITION BY path ORDER BY step) changed_step FROM f""",
    "changed_paths": f"SELECT coalesce(a.path, b.path) path, a.blob AS \"before\", b.blob AS \"after\" FROM (SELECT * FROM {_STATES} WHERE step = 2) a FULL OUTER JOIN (SELECT * FROM {_STATES} WHERE step = 5) b ON a.path = b.path WHERE a.blob IS DISTINCT FROM b.blob",
    "constant_change_diff": """WITH c AS (SELECT l_partkey n, CAST(year(l_shipdate) - 1995 AS INTEGER) step, max(row(l_quantity, l_discount)) m FROM lineitem GROUP BY 1, 2),
      v AS (SELECT n, step, CAST(CAST(m[1] AS INTEGER) AS VARCHAR) || '@' || CAST(CAST(round(m[2] * 100) AS INTEGER) AS VARCHAR) v FROM c)
      SELECT coalesce(a.n, b.n) AS "name", a.v AS "before", b.v AS "after" FROM (SELECT * FROM v WHERE step = 1) a FULL OUTER JOIN (SELECT * FROM v WHERE step = 4) b ON a.n = b.n WHERE a.v IS DISTINCT FROM b.v""",
    "run_flaky": f"SELECT node, step FROM {_BY_STEP} WHERE flaky",
    "run_latest_attempt": f"SELECT node, step, outcome FROM {_BY_STEP}",
    "demotion_state": f"""WITH v AS (SELECT node, step, CASE WHEN NOT flaky AND outcome IN ('passed', 'failed') THEN outcome END verdict FROM {_BY_STEP}),
      s AS (SELECT *, count(*) FILTER (verdict = 'passed') OVER (PARTITION BY node ORDER BY step) island, last_value(verdict IGNORE NULLS) OVER (PARTITION BY node ORDER BY step) state FROM v)
      SELECT node, step, opened_step FROM (SELECT node, step, state, min(step) FILTER (verdict = 'failed') OVER (PARTITION BY node, island) opened_step FROM s) WHERE state = 'failed'""",
    "tier_lift": f"SELECT node, pass_step FROM {_LIFT}",
    "lift_invalidated_by_change": f"SELECT node, max(step) pass_step FROM {RUNS} WHERE outcome = 'passed' AND step <= 5 AND node NOT IN (SELECT node FROM {_LIFT}) GROUP BY 1",
    "unexpected_outcomes": f"SELECT e.node, e.step, 'passed' expected, r.outcome FROM (SELECT p_partkey node, s step FROM part, (SELECT CAST(unnest([2, 4]) AS INTEGER) s)) e LEFT JOIN {_BY_STEP} r ON e.node = r.node AND e.step = r.step WHERE r.outcome IS DISTINCT FROM 'passed'",
    "rerun_failed": f"SELECT a.node, a.step, b.outcome AS \"second\" FROM {RUNS} a LEFT JOIN (SELECT * FROM {RUNS} WHERE attempt = 2) b ON a.node = b.node AND a.step = b.step WHERE a.attempt = 1 AND a.outcome = 'failed'",
    "documents_changed": f"""SELECT reg_id, id FROM (SELECT reg_id, id, version, content_hash, row_number() OVER w n, lag(version) OVER w v, lag(content_hash) OVER w h FROM {REGISTRY} WINDOW w AS (PARTITION BY id ORDER BY ingested_at, reg_id))
      WHERE n = 1 OR v IS DISTINCT FROM version OR h IS DISTINCT FROM content_hash""",
    "documents_pending": "SELECT DISTINCT id FROM document_registry WHERE reg_id IS NOT NULL AND id NOT IN (SELECT document_id FROM stored_fact WHERE document_id IS NOT NULL)",
    "document_upsert": f"""SELECT l.id, reg_id, version, visibility, t.title FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC, reg_id DESC) r FROM {REGISTRY}) l
      LEFT JOIN (SELECT id, title FROM (SELECT id, title, row_number() OVER (PARTITION BY id ORDER BY ingested_at, reg_id) r FROM {REGISTRY} WHERE title IS NOT NULL) WHERE r = 1) t ON l.id = t.id WHERE r = 1""",
    "failure_streaks": """WITH s AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END f FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      i AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) island FROM s)
      SELECT user_id, event_type, count(*) n, min(event_id) first_event FROM i GROUP BY user_id, island, event_type HAVING count(*) >= 3""",
    "budget_running_total": """WITH e AS (SELECT user_id, ts, event_id, CAST(coalesce(value, 0) AS DECIMAL(18,4)) v FROM events WHERE user_id IS NOT NULL),
      r AS (SELECT *, sum(v) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) spent, sum(v) OVER (PARTITION BY user_id) whole FROM e)
      SELECT user_id, arg_min(event_id, row(ts, event_id)) event_id FROM r WHERE spent * 5 > whole * 4 GROUP BY 1""",
}
