"""Queries of the general data problems (hierarchies, histories, instants) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.operators import hierarchy, history, instants
from factloom.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root, depth, path and nodes below of every node of entity_relation; loops and what hangs below them marked."""
    return hierarchy.hierarchy(hierarchy.part_edges(table(spark, sf_dir, "entity_relation")))


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of entity_relation with each node below it and how far below."""
    return hierarchy.descendants(hierarchy.part_edges(table(spark, sf_dir, "entity_relation")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of every claim of stored_fact with their validity and successor."""
    return history.versions(table(spark, sf_dir, "stored_fact"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTC instants that document_registry states, by the zone and date order of its site where the text is silent."""
    return instants.registry_instants(table(spark, sf_dir, "document_registry"), table(spark, sf_dir, "source_site"))


QUERIES = {"p3_found": p3_found, "p3_descendants": p3_descendants, "p4_found": p4_found, "p5_found": p5_found}

_PARTS = r"""
WITH RECURSIVE raw AS (
  SELECT lower(regexp_replace(src, '\s+', '', 'g')) s, lower(regexp_replace(dst, '\s+', '', 'g')) d,
         regexp_replace(lower(kind), '[^a-z]', '', 'g') k
  FROM entity_relation WHERE src IS NOT NULL AND dst IS NOT NULL
), edge AS (
  SELECT id, min(parent) parent FROM (
    SELECT CASE WHEN k = 'partof' THEN s ELSE d END id, CASE WHEN k = 'partof' THEN d ELSE s END parent
    FROM raw WHERE k IN ('partof', 'haspart') AND s <> d AND s <> '' AND d <> '')
  GROUP BY id
), node AS (SELECT id FROM edge UNION SELECT parent FROM edge),
up AS (
  SELECT id, id AS anc, [id] AS path FROM node
  UNION ALL SELECT up.id, edge.parent, list_append(up.path, edge.parent) FROM up JOIN edge ON edge.id = up.anc WHERE NOT list_contains(up.path, edge.parent)
), pair AS (SELECT id, anc, len(path) - 1 AS steps FROM up),
onloop AS (SELECT DISTINCT e.id FROM edge e JOIN pair p ON p.id = e.parent AND p.anc = e.id),
"""

ORACLE = {
    "p3_found": _PARTS
    + r"""below AS (SELECT anc id, count(*) - 1 n FROM pair GROUP BY 1),
looproot AS (SELECT p.id, min(p.anc) root FROM pair p JOIN onloop o ON o.id = p.anc GROUP BY 1),
treeroot AS (SELECT p.id, p.anc root, p.steps depth FROM pair p JOIN node n ON n.id = p.anc WHERE p.anc NOT IN (SELECT id FROM edge)),
paths AS (SELECT id, string_agg(anc, '>' ORDER BY steps DESC) path FROM pair GROUP BY 1)
SELECT n.id node_id, coalesce(l.root, t.root) root_id,
       CAST(CASE WHEN n.id IN (SELECT id FROM onloop) THEN -1 WHEN l.root IS NOT NULL THEN -2 ELSE t.depth END AS INTEGER) depth,
       CASE WHEN l.root IS NOT NULL THEN '' ELSE p.path END path, CAST(b.n AS INTEGER) n_below
FROM node n LEFT JOIN looproot l USING (id) LEFT JOIN treeroot t USING (id) JOIN below b USING (id) JOIN paths p USING (id)
""",
    "p3_descendants": _PARTS
    + "x AS (SELECT 1) SELECT anc AS node_id, id AS below_id, CAST(steps AS INTEGER) AS distance FROM pair WHERE steps > 0 AND anc NOT IN (SELECT id FROM onloop)",
    "p4_found": """
WITH c AS (
  SELECT claim_entity e, claim_attribute a, base_id b, epoch_us(valid_at) v,
         coalesce(epoch_us(invalid_at), 9223372036854775807) i,
         row_number() OVER (PARTITION BY claim_entity, claim_attribute, valid_at ORDER BY created_at DESC NULLS LAST, id DESC) r
  FROM stored_fact
  WHERE id IS NOT NULL AND base_id IS NOT NULL AND claim_entity IS NOT NULL AND claim_attribute IS NOT NULL AND valid_at IS NOT NULL
    AND expired_at IS NULL AND (invalid_at IS NULL OR invalid_at > valid_at)
), p AS (
  SELECT e, a, b, v, least(i, coalesce(lead(v) OVER w, 9223372036854775807)) i FROM c WHERE r = 1 WINDOW w AS (PARTITION BY e, a ORDER BY v)
), f AS (
  SELECT *, CASE WHEN lag(b) OVER w = b AND lag(i) OVER w = v THEN 0 ELSE 1 END fresh FROM p WINDOW w AS (PARTITION BY e, a ORDER BY v)
), g AS (SELECT *, sum(fresh) OVER (PARTITION BY e, a ORDER BY v) island FROM f),
x AS (SELECT e, a, island, min(v) v, max(i) i, min(b) b FROM g GROUP BY 1, 2, 3),
n AS (SELECT *, row_number() OVER (PARTITION BY e, a, b ORDER BY v) - 1 k FROM x),
y AS (SELECT *, CASE WHEN k = 0 THEN b ELSE b || '.' || k END version_id FROM n)
SELECT version_id, v valid_us, CASE WHEN i = 9223372036854775807 THEN -1 ELSE i END invalid_us,
       coalesce(CASE WHEN lead(v) OVER w = i THEN lead(version_id) OVER w END, '') superseded_by
FROM y WINDOW w AS (PARTITION BY e, a ORDER BY v)
""",
}
