"""Queries over texts, vectors, names and relations: normalisers, search, traversal, resolution; and the SQL of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import norm
from factloom.operators import graph, resolve, search
from factloom.plans.views import STORED, stored
from factloom.session import table


def normalize_statements(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored(spark, sf, "statement").where("statement IS NOT NULL")
    return rows.select("id", F.md5(norm.statement(F.col("statement"))).alias("digest"))


def normalize_units(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored(spark, sf, "claim_unit").where("claim_unit IS NOT NULL")
    return rows.groupBy(norm.unit(F.col("claim_unit")).alias("unit")).agg(F.count("*").alias("n"))


def normalize_values(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored(spark, sf, "claim_value").where("claim_value IS NOT NULL")
    return rows.select("id", norm.value_number(F.col("claim_value")).alias("number"), norm.value_text(F.col("claim_value")).alias("text"))


def normalize_attributes(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored(spark, sf, "claim_attribute").where("claim_attribute IS NOT NULL")
    return rows.groupBy(norm.attribute(F.col("claim_attribute")).alias("attribute")).agg(F.count("*").alias("n"))


def number_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored(spark, sf, "statement").where("statement IS NOT NULL")
    return rows.select("id", F.array_join(norm.numbers(F.col("statement")), " ").alias("numbers"))


def term_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored(spark, sf, "statement").where("statement IS NOT NULL")
    words = rows.select("id", F.explode(norm.terms(F.col("statement"))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_facts"))


def document_kinds(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "document_registry").where("reg_id IS NOT NULL").select("reg_id", "id").distinct()
    return rows.groupBy(norm.document_kind(F.col("id")).alias("kind"), norm.source_of(F.col("id")).alias("source")).agg(F.count("*").alias("n"))


def infer_kind(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "entity_catalog")
    return rows.groupBy("kind", norm.infer_kind(F.col("name")).alias("guess")).agg(F.count("*").alias("n"))


def infer_unit(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored(spark, sf, "claim_attribute").where("claim_attribute IS NOT NULL")
    return rows.groupBy(norm.infer_unit(F.col("claim_attribute")).alias("unit")).agg(F.count("*").alias("n"))


def category_heuristic(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored(spark, sf, "statement", "category").where("statement IS NOT NULL")
    return rows.groupBy("category", norm.category(F.col("statement")).alias("guess")).agg(F.count("*").alias("n"))


def _lines(text: str):
    """A text with one kind of line end."""
    return F.regexp_replace(text, "\r\n?", "\n")


def heading_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Headings of every page with their anchors, in order, whatever its line ends."""
    docs = table(spark, sf, "documents").where("text IS NOT NULL")
    lines = docs.select("doc_id", F.posexplode(F.split(_lines("text"), "\n")).alias("line_no", "line")).where(F.col("line").rlike("^#{1,6} +[^ ]"))
    return lines.select("doc_id", "line_no", norm.slug(F.regexp_replace(F.regexp_replace("line", "^#{1,6} +", ""), r"\s+$", "")).alias("anchor"))


def heading_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Every page cut at its headings: number, anchor ('' before the first), and length and digest of each part's text."""
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.concat(F.lit("\n"), _lines("text")).alias("t"))
    # A mark goes before every heading line; the parts between marks are the chunks.
    parts = docs.select("doc_id", F.posexplode(F.split(F.regexp_replace("t", "\n(#{1,6} +[^ \n])", "\u0001$1"), "\u0001")).alias("chunk", "body"))
    head = F.regexp_extract("body", "^#{1,6} +([^\n]*)", 1)
    body = F.trim(F.regexp_replace("body", "^#{1,6} +[^\n]*", ""))
    out = parts.where((F.col("chunk") > 0) | (F.regexp_replace("body", r"\s", "") != ""))
    return out.select("doc_id", "chunk", norm.slug(F.regexp_replace(head, r"\s+$", "")).alias("anchor"), F.length(F.regexp_replace(body, r"^\s+|\s+$", "")).alias("n_chars"))


def front_matter(spark: SparkSession, sf: str) -> DataFrame:
    """Key and value lines of front matter, whatever the line ends and the case of the keys."""
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", _lines("text").alias("t")).where(F.col("t").startswith("---\n"))
    head = F.split_part(F.substring("t", 5, 1_000_000_000), F.lit("\n---"), F.lit(1))
    lines = docs.select("doc_id", F.explode(F.split(head, "\n")).alias("line")).where(F.col("line").rlike("^[A-Za-z][A-Za-z0-9_-]*: "))
    return lines.select("doc_id", F.split_part("line", F.lit(": "), F.lit(1)).alias("key"), F.trim(F.regexp_replace("line", "^[A-Za-z][A-Za-z0-9_-]*: ", "")).alias("value"))


def ticket_json(spark: SparkSession, sf: str) -> DataFrame:
    """Tickets delivered as JSON: key, reporter and number of comments."""
    schema = "key string, reporter string, description string, comments array<struct<author string, body string>>"
    docs = table(spark, sf, "documents").where(F.col("text").startswith("{"))
    parsed = docs.select("doc_id", F.from_json("text", schema).alias("t"))
    return parsed.where("t.key IS NOT NULL").select("doc_id", "t.key", "t.reporter", F.size(F.coalesce("t.comments", F.array().cast("array<struct<author:string,body:string>>"))).alias("n_comments"))


def json_props(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


def corpus_size(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.floor(F.length("text") / 4)).cast("bigint").alias("tokens"))


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    """The held-out questions and statements as queries."""
    return table(spark, sf, "eval_item").where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").alias("q"), "text").distinct()


def _said(spark: SparkSession, sf: str) -> DataFrame:
    """What facts say: statement and detail."""
    rows = stored(spark, sf, "statement", "detail", "category", "tier", "invalid_at").where("statement IS NOT NULL")
    return rows.withColumn("said", F.concat_ws(" ", "statement", "detail"))


def text_search(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty best facts of every question by shared terms of statement and detail."""
    return search.text_search(_said(spark, sf), _questions(spark, sf), "id", "said").drop("rank")


def text_search_idf(spark: SparkSession, sf: str) -> DataFrame:
    return search.text_search(_said(spark, sf), _questions(spark, sf), "id", "said", idf=True).drop("rank")


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector whose id is divisible by 20, as a query."""
    return table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), "embedding")


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return search.vector_search(table(spark, sf, "embeddings"), _asked(spark, sf), "vec_id", "embedding").drop("rank")


def vector_nearest_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    """The vector of every label that is closest to each asked one."""
    return search.vector_search(table(spark, sf, "embeddings"), _asked(spark, sf), "vec_id", "embedding", group="label")


def _embedded(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Hash embeddings of the facts and of the questions."""
    return search.hash_embedding(_said(spark, sf), "id", "said"), search.hash_embedding(_questions(spark, sf), "q", "text")


def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best facts of every question: the ranking by text and the one by vector (cosine 0.3 or more) of the same facts, fused."""
    facts, asked = _embedded(spark, sf)
    near = search.sparse_search(facts, asked, "id", floor=0.3)
    return search.fuse([search.text_search(_said(spark, sf), _questions(spark, sf), "id", "said"), near], "id")


def search_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """As :func:`hybrid_rrf`, among the business facts that held after June 2025."""
    rows = _said(spark, sf).where("category = 'business-logic' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP_NTZ '2025-06-01 00:00:00')")
    _, asked = _embedded(spark, sf)
    near = search.sparse_search(search.hash_embedding(rows, "id", "said"), asked, "id", floor=0.3)
    return search.fuse([search.text_search(rows, _questions(spark, sf), "id", "said"), near], "id")


def ask_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Five facts for every question: by term overlap, half the weight where superseded, then tier, then id."""
    from pyspark.sql import Window as W

    rows = _said(spark, sf)
    terms = rows.select("id", "tier", "invalid_at", F.explode(F.array_distinct(norm.terms(F.col("said")))).alias("term"))
    asked = search._asked_terms(_questions(spark, sf))
    hits = terms.join(asked, "term").groupBy("q", "id").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.max(norm.tier_rank("tier")).alias("rank"), F.max(F.col("invalid_at").isNull()).alias("open"))
    score = F.round(F.col("n") / F.col("size") * F.when(F.col("open"), 1.0).otherwise(0.5), 6)
    order = W.partitionBy("q").orderBy(F.desc("score"), F.desc("rank"), "id")
    return hits.withColumn("score", score).withColumn("place", F.row_number().over(order)).where("place <= 5").select("q", "id", "score", "place")


def best_citations(spark: SparkSession, sf: str) -> DataFrame:
    """The three best citations of every base fact."""
    rows = stored(spark, sf, "base_id", "tier", "document_id", "created_at").where("base_id IS NOT NULL AND document_id IS NOT NULL")
    tiers = rows.groupBy("base_id").agg(F.max(F.struct(norm.tier_rank("tier").alias("r"), "tier")).alias("m")).select("base_id", "m.tier")
    cited = rows.select("base_id", F.col("document_id").alias("document"), F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(0)).alias("position"))
    return search.best_citations(cited.distinct().join(tiers, "base_id").withColumnRenamed("base_id", "fact_id"))


def hash_embedding(spark: SparkSession, sf: str) -> DataFrame:
    return search.hash_embedding(stored(spark, sf, "statement").where("statement IS NOT NULL"), "id", "statement")


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    li, s = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    n = table(spark, sf, "nation")
    tag = lambda t, c: F.concat(F.lit(t), F.col(c).cast("string"))
    return (
        li.select(tag("p", "l_partkey").alias("src"), tag("s", "l_suppkey").alias("dst"))
        .unionByName(s.select(tag("s", "s_suppkey").alias("src"), tag("n", "s_nationkey").alias("dst")))
        .unionByName(n.select(tag("n", "n_nationkey").alias("src"), tag("r", "n_regionkey").alias("dst")))
    )


_EDGES = """(SELECT 'p' || l_partkey src, 's' || l_suppkey dst FROM lineitem UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""


def graph_reach(spark: SparkSession, sf: str) -> DataFrame:
    return graph.reach(_edges(spark, sf), spark.range(1).select(F.lit("p1").alias("id")), 2)


def graph_reach_no_hubs(spark: SparkSession, sf: str) -> DataFrame:
    e = _edges(spark, sf)
    hubs = e.select(F.explode(F.array("src", "dst")).alias("id")).where("id LIKE 'n%' OR id LIKE 'r%'").distinct()
    return graph.reach(e, spark.range(1).select(F.lit("p1").alias("id")), 2, hubs)


def entity_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Facts' entities stand for orders' parts and suppliers: suppliers are hubs."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    members = li.select(F.col("l_orderkey").alias("fact_id"), F.concat(F.lit("p"), "l_partkey").alias("entity"), F.lit("rule").alias("kind"), (F.col("l_linenumber").cast("bigint") * 1_000_000_000 + F.col("l_partkey")).alias("position"))
    hubs = li.select(F.col("l_orderkey").alias("fact_id"), F.concat(F.lit("s"), "l_suppkey").alias("entity"), F.lit("service").alias("kind"), F.lit(0).cast("bigint").alias("position"))
    return graph.relations(members.unionByName(hubs).distinct())


def resolve_cascade(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "entity").select("name", "kind")
    return resolve.resolve(names, table(spark, sf, "entity_catalog"))


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog entries named in stored statements."""
    c = table(spark, sf, "entity_catalog")
    labels = c.select("id", F.col("name").alias("label")).unionByName(c.select("id", F.explode("aliases").alias("label")))
    rows = stored(spark, sf, "statement").where("statement IS NOT NULL")
    found = resolve.mentions(rows.withColumnRenamed("id", "fact_id"), labels, "fact_id", "statement")
    return found.groupBy("entity_id").agg(F.count("*").alias("n_facts"), F.min("fact_id").alias("first_fact"))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_statements, normalize_units, normalize_values, normalize_attributes, number_tokens, term_vectors, document_kinds, infer_kind, infer_unit, category_heuristic,
        heading_anchors, heading_chunks, front_matter, ticket_json, json_props, corpus_size, text_search, text_search_idf, vector_topk, vector_nearest_by_kind, hybrid_rrf, search_filtered, ask_candidates,
        best_citations, hash_embedding, graph_reach, graph_reach_no_hubs, entity_relations, resolve_cascade, mentions,
    )
}

_STOP = ", ".join(f"'{w}'" for w in norm.STOPWORDS)
_FOLD = r"regexp_replace(lower(trim({0})), '[\s\-_./]+', '', 'g')"
_RANK = "CASE tier WHEN 'executed' THEN 3 WHEN 'code' THEN 2 WHEN 'documented' THEN 1 ELSE 0 END"


def _terms(text: str) -> str:
    words = f"list_filter(list_transform(regexp_extract_all(lower({text}), '[a-z0-9$%.]+'), lambda w: trim(w, '.')), lambda w: w <> '' AND w NOT IN ({_STOP}))"
    return f"list_transform({words}, lambda w: CASE WHEN length(w) > 4 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END)"


_VALUE = r"replace(lower(trim(claim_value)), ',', '')"
_NUM = r"'^\$?\s*(-?[0-9]+(?:\.[0-9]+)?)\s*(?:%|usd)?$'"
_UNIT = "CASE u {0} ELSE u END".format(" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in norm.UNITS.items()))
_COS = "round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6)"
_ASKED = "(SELECT vec_id q, embedding FROM embeddings WHERE vec_id % 20 = 0)"
_REACH = """WITH RECURSIVE b AS MATERIALIZED (SELECT DISTINCT s, d FROM (SELECT src s, dst d FROM {edges} UNION ALL SELECT dst, src FROM {edges}) WHERE s <> d {hubs}),
  w AS (SELECT 'p1' id, 0 distance UNION SELECT b.d, w.distance + 1 FROM w JOIN b ON b.s = w.id WHERE w.distance < 2) SELECT id, CAST(min(distance) AS INTEGER) distance FROM w GROUP BY 1"""
_SAID = f"(SELECT id, concat_ws(' ', statement, detail) said, category, tier, invalid_at FROM {STORED} WHERE statement IS NOT NULL)"
_QT = f"(SELECT DISTINCT q, size, unnest(ts) term FROM (SELECT DISTINCT item_id q, list_distinct({_terms('text')}) ts, len(list_distinct({_terms('text')})) size FROM eval_item WHERE item_id IS NOT NULL AND text IS NOT NULL))"


def _hits(source: str) -> str:
    return f"(SELECT q, id, round(count(*) / max(size), 6) score FROM (SELECT id, unnest(list_distinct({_terms('said')})) term FROM {source}) JOIN {_QT} USING (term) GROUP BY 1, 2)"


def _best(scored: str, limit: int) -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) rank FROM {scored}) WHERE rank <= {limit})"


def _hashed(source: str, id: str, text: str) -> str:
    return f"""(SELECT {id}, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY {id})), 6) weight FROM (SELECT {id}, CAST(CAST('0x' || substr(m, 1, 8) AS BIGINT) % 384 AS INTEGER) bucket,
      sum(CASE WHEN substr(m, 9, 1) IN ('1','3','5','7','9','b','d','f') THEN 1 ELSE -1 END) v FROM (SELECT {id}, md5(unnest({_terms(text)})) m FROM {source}) GROUP BY 1, 2 HAVING v <> 0))"""


_QUESTIONS = "(SELECT DISTINCT item_id q, text FROM eval_item WHERE item_id IS NOT NULL AND text IS NOT NULL)"


def _fused(source: str) -> str:
    near = f"(SELECT q, id, round(sum(f.weight * a.weight), 5) score FROM {_hashed(source, 'id', 'said')} f JOIN {_hashed(_QUESTIONS, 'q', 'text')} a USING (bucket) GROUP BY 1, 2 HAVING round(sum(f.weight * a.weight), 5) >= 0.3)"
    both = f"(SELECT q, id, rank FROM {_best(_hits(source), 20)} UNION ALL SELECT q, id, rank FROM {_best(near, 20)})"
    return f"SELECT q, id, score FROM {_best(f'(SELECT q, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) score FROM {both} GROUP BY 1, 2)', 10)}"


_HYBRID = _fused(_SAID)

ORACLE = {
    "normalize_statements": rf"SELECT id, md5(regexp_replace(regexp_replace(trim(lower(statement)), '\s+', ' ', 'g'), '[ .]+$', '')) digest FROM {STORED} WHERE statement IS NOT NULL",
    "normalize_units": f"SELECT CASE WHEN u NOT IN ('', 'none', 'null') THEN {_UNIT} END unit, count(*) n FROM (SELECT lower(trim(claim_unit)) u FROM {STORED} WHERE claim_unit IS NOT NULL) GROUP BY 1",
    "normalize_values": rf"SELECT id, CASE WHEN regexp_matches(v, {_NUM}) THEN CAST(regexp_extract(v, {_NUM}, 1) AS DOUBLE) END number, CASE WHEN NOT regexp_matches(v, {_NUM}) THEN v END \"text\" FROM (SELECT id, {_VALUE} v FROM {STORED} WHERE claim_value IS NOT NULL)".replace('\\"', '"'),
    "normalize_attributes": f"SELECT trim(regexp_replace(lower(claim_attribute), '[^a-z0-9]+', '_', 'g'), '_') \"attribute\", count(*) n FROM {STORED} WHERE claim_attribute IS NOT NULL GROUP BY 1",
    "number_tokens": rf"SELECT id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(statement, '[0-9]+(?:\.[0-9]+)?'), lambda x: CASE WHEN contains(x, '.') THEN rtrim(rtrim(x, '0'), '.') ELSE x END))), ' ') numbers FROM {STORED} WHERE statement IS NOT NULL",
    "term_vectors": f"SELECT term, count(*) n, count(DISTINCT id) n_facts FROM (SELECT id, unnest({_terms('statement')}) term FROM {STORED} WHERE statement IS NOT NULL) GROUP BY 1",
    "document_kinds": "SELECT k kind, CASE k WHEN 'wiki' THEN 'wiki' WHEN 'doc' THEN 'docs' WHEN 'ticket' THEN 'tickets' WHEN 'pull' THEN 'pulls' WHEN 'code' THEN 'repo' WHEN 'run' THEN 'runs' ELSE 'other' END source, count(DISTINCT reg_id) n FROM (SELECT reg_id, split_part(id, '/', 1) k FROM document_registry WHERE reg_id IS NOT NULL) GROUP BY 1, 2",
    "infer_kind": r"""SELECT kind, CASE WHEN regexp_matches(t, '^(GET|POST|PUT|PATCH|DELETE)\s+/') THEN 'endpoint' WHEN regexp_matches(t, '^[a-z]+(\.[a-z_]+)+$') THEN 'queue'
      WHEN regexp_matches(t, 'Client$| [Cc]lient$') THEN 'integration' WHEN regexp_matches(t, '^[a-z]+([A-Z][a-z0-9]*)+$') THEN 'job' WHEN regexp_matches(t, '^[a-z]+(_[a-z]+)+$') THEN 'table' ELSE 'rule' END guess, count(*) n
      FROM (SELECT kind, trim(name) t FROM entity_catalog) GROUP BY 1, 2""",
    "infer_unit": f"""SELECT CASE WHEN regexp_matches(a, 'minutes?([^a-z]|$)') THEN 'minute' WHEN regexp_matches(a, 'days?([^a-z]|$)') THEN 'day' WHEN regexp_matches(a, 'hours?([^a-z]|$)') THEN 'hour'
      WHEN regexp_matches(a, 'seconds?([^a-z]|$)') THEN 'second' WHEN regexp_matches(a, 'fee|price|amount|rate|cost') THEN 'usd' WHEN regexp_matches(a, 'count|max|limit|size|copies|attempts') THEN 'count' END unit, count(*) n
      FROM (SELECT lower(claim_attribute) a FROM {STORED} WHERE claim_attribute IS NOT NULL) GROUP BY 1""",
    "category_heuristic": f"""SELECT category, CASE WHEN regexp_matches(t, '(^|[^0-9])[1-5][0-9]{{2}}([^0-9]|$)') OR regexp_matches(t, '(^|[^a-z])publish') OR regexp_matches(t, '[a-z_]+/[a-z_]+') THEN 'technical-implementation' ELSE 'business-logic' END guess, count(*) n
      FROM (SELECT category, lower(statement) t FROM {STORED} WHERE statement IS NOT NULL) GROUP BY 1, 2""",
    "heading_anchors": r"""SELECT doc_id, CAST(n - 1 AS INTEGER) line_no, regexp_replace(regexp_replace(lower(trim(regexp_replace(regexp_replace(line, '^#{1,6} +', ''), '\s+$', ''))), '[^a-z0-9_\s-]', '', 'g'), '\s', '-', 'g') anchor
      FROM (SELECT doc_id, unnest(string_split(t, chr(10))) line, generate_subscripts(string_split(t, chr(10)), 1) n FROM (SELECT doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') t FROM documents WHERE text IS NOT NULL)) WHERE regexp_matches(line, '^#{1,6} +[^ ]')""",
    "heading_chunks": r"""WITH l AS (SELECT doc_id, unnest(string_split(t, chr(10))) line, generate_subscripts(string_split(t, chr(10)), 1) n FROM (SELECT doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') t FROM documents WHERE text IS NOT NULL)),
      h AS (SELECT *, regexp_matches(line, '^#{1,6} +[^ ]') head FROM l), c AS (SELECT *, count(*) FILTER (head) OVER (PARTITION BY doc_id ORDER BY n) chunk FROM h),
      g AS (SELECT doc_id, chunk, max(CASE WHEN head THEN line END) head, coalesce(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY n), '') body FROM c GROUP BY 1, 2)
      SELECT doc_id, CAST(chunk AS INTEGER) chunk, coalesce(regexp_replace(regexp_replace(lower(trim(regexp_replace(regexp_replace(head, '^#{1,6} +', ''), '\s+$', ''))), '[^a-z0-9_\s-]', '', 'g'), '\s', '-', 'g'), '') anchor,
        CAST(length(regexp_replace(regexp_replace(trim(body), '^\s+', ''), '\s+$', '')) AS INTEGER) n_chars FROM g WHERE chunk > 0 OR regexp_replace(body, '\s', '', 'g') <> ''""",
    "front_matter": r"""SELECT doc_id, split_part(line, ': ', 1) "key", trim(regexp_replace(line, '^[A-Za-z][A-Za-z0-9_-]*: ', '')) "value" FROM (SELECT doc_id, unnest(string_split(split_part(substr(t, 5), chr(10) || '---', 1), chr(10))) line
      FROM (SELECT doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') t FROM documents) WHERE starts_with(t, '---' || chr(10))) WHERE regexp_matches(line, '^[A-Za-z][A-Za-z0-9_-]*: ')""",
    "ticket_json": """SELECT doc_id, json_extract_string(text, '$.key') "key", json_extract_string(text, '$.reporter') reporter, CAST(coalesce(json_array_length(text, '$.comments'), 0) AS INTEGER) n_comments
      FROM (SELECT * FROM documents WHERE starts_with(text, '{') AND json_valid(text)) WHERE json_extract_string(text, '$.key') IS NOT NULL""",
    "json_props": "SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) k, count(*) n FROM events GROUP BY 1, 2",
    "corpus_size": "SELECT source, count(*) n_docs, CAST(sum(length(text) // 4) AS BIGINT) tokens FROM documents GROUP BY 1",
    "text_search": f"SELECT q, id, score FROM {_best(_hits(_SAID), 20)}",
    "text_search_idf": f"""WITH h AS (SELECT q, id, term FROM (SELECT id, unnest(list_distinct({_terms('said')})) term FROM {_SAID}) JOIN {_QT} USING (term)),
      w AS (SELECT term, ln(((SELECT count(*) FROM {_SAID}) + 1) / count(DISTINCT id)) w FROM h GROUP BY 1), s AS (SELECT q, id, round(sum(w), 6) score FROM h JOIN w USING (term) GROUP BY 1, 2) SELECT q, id, score FROM {_best('s', 20)}""",
    "vector_topk": f"SELECT q, vec_id, score FROM (SELECT q.q, vec_id, {_COS} score, row_number() OVER (PARTITION BY q.q ORDER BY {_COS} DESC, vec_id) r FROM embeddings e, {_ASKED} q) WHERE r <= 20",
    "vector_nearest_by_kind": f"SELECT q, label, vec_id, score FROM (SELECT q.q, label, vec_id, {_COS} score, row_number() OVER (PARTITION BY q.q, label ORDER BY {_COS} DESC, vec_id) r FROM embeddings e, {_ASKED} q) WHERE r = 1",
    "hybrid_rrf": _HYBRID,
    "search_filtered": _fused(f"(SELECT * FROM {_SAID} WHERE category = 'business-logic' AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '2025-06-01'))"),
    "ask_candidates": f"""WITH t AS (SELECT id, tier, invalid_at, unnest(list_distinct({_terms('said')})) term FROM {_SAID}),
      s AS (SELECT q, id, tier, round(count(*) / max(size) * CASE WHEN invalid_at IS NULL THEN 1.0 ELSE 0.5 END, 6) score FROM t JOIN {_QT} USING (term) GROUP BY q, id, tier, invalid_at)
      SELECT q, id, score, CAST(place AS INTEGER) place FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, {_RANK} DESC, id) place FROM s) WHERE place <= 5""",
    "best_citations": f"""WITH r AS (SELECT DISTINCT base_id, document_id d, coalesce(epoch_us(created_at), 0) p FROM {STORED} WHERE base_id IS NOT NULL AND document_id IS NOT NULL),
      t AS (SELECT base_id, max({_RANK}) m FROM {STORED} WHERE base_id IS NOT NULL AND document_id IS NOT NULL GROUP BY 1),
      g AS (SELECT r.*, split_part(d, '/', 1) k, m, CASE WHEN row_number() OVER (PARTITION BY r.base_id, d ORDER BY p DESC) = 1 THEN 0 ELSE 1 END again FROM r JOIN t USING (base_id)),
      x AS (SELECT *, CASE WHEN m = 3 THEN CASE k WHEN 'run' THEN 0 WHEN 'code' THEN 1 ELSE 0.5 END WHEN m = 2 THEN CASE k WHEN 'code' THEN 0 WHEN 'run' THEN 2 ELSE 0.5 END WHEN m = 1 THEN CASE k WHEN 'code' THEN 1 WHEN 'run' THEN 2 ELSE 0.5 END ELSE 0.5 END grade FROM g)
      SELECT base_id fact_id, place, d document FROM (SELECT base_id, d, CAST(row_number() OVER (PARTITION BY base_id ORDER BY again, grade, p DESC, d) AS INTEGER) place FROM x) WHERE place <= 3""",
    "hash_embedding": f"""WITH w AS (SELECT id, md5(unnest({_terms('statement')})) m FROM {STORED} WHERE statement IS NOT NULL),
      s AS (SELECT id, CAST(CAST('0x' || substr(m, 1, 8) AS BIGINT) % 384 AS INTEGER) bucket, sum(CASE WHEN substr(m, 9, 1) IN ('1','3','5','7','9','b','d','f') THEN 1 ELSE -1 END) v FROM w GROUP BY 1, 2 HAVING v <> 0)
      SELECT id, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY id)), 6) weight FROM s""",
    "graph_reach": _REACH.format(edges=_EDGES, hubs=""),
    "graph_reach_no_hubs": _REACH.format(edges=_EDGES, hubs="AND d NOT LIKE 'n%' AND d NOT LIKE 'r%'"),
    "entity_relations": """WITH m AS (SELECT l_orderkey f, 'p' || l_partkey e, min(CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey) p FROM lineitem GROUP BY 1, 2), h AS (SELECT DISTINCT l_orderkey f, 's' || l_suppkey e FROM lineitem)
      SELECT DISTINCT m.e src, h.e dst, 'part_of' kind FROM m JOIN h USING (f) UNION
      SELECT DISTINCT x.e, y.e, 'related' FROM m x JOIN m y ON x.f = y.f AND (x.p < y.p OR (x.p = y.p AND x.e < y.e))""",
    "resolve_cascade": f"""WITH n AS (SELECT DISTINCT name, kind FROM entity WHERE name IS NOT NULL AND trim(name) <> ''), a AS (SELECT id, kind, unnest(aliases) alias FROM entity_catalog),
      f AS (SELECT id, kind, {_FOLD.format('name')} f FROM entity_catalog UNION ALL SELECT id, kind, {_FOLD.format('alias')} FROM a WHERE alias IS NOT NULL),
      x AS (SELECT name, kind, (SELECT min(id) FROM entity_catalog c WHERE lower(c.name) = lower(trim(n.name))) b1, (SELECT min(id) FROM a WHERE lower(alias) = lower(trim(n.name))) b2,
        (SELECT min(id) FROM f WHERE f.f = {_FOLD.format('n.name')} AND f.kind = n.kind) b3, (SELECT min(id) FROM f WHERE f.f = {_FOLD.format('n.name')}) b4 FROM n)
      SELECT name, kind, coalesce(b1, b2, b3, b4) entity_id, CASE WHEN b1 IS NOT NULL THEN 'name' WHEN b2 IS NOT NULL THEN 'alias' WHEN b4 IS NOT NULL THEN 'folded' ELSE 'new' END how FROM x""",
    "mentions": rf"""WITH l AS (SELECT DISTINCT id e, {_FOLD.format('label')} f FROM (SELECT id, name label FROM entity_catalog UNION ALL SELECT id, unnest(aliases) FROM entity_catalog) WHERE label IS NOT NULL),
      w AS (SELECT id, regexp_extract_all(lower(statement), '[a-z0-9_./\-]+') w FROM {STORED} WHERE statement IS NOT NULL),
      r AS (SELECT id, {_FOLD.format("array_to_string(w[i:i + n - 1], '')")} f FROM (SELECT id, w, n, unnest(range(1, greatest(len(w) - n + 1, 1) + 1)) i FROM w, (SELECT unnest([1, 2, 3, 4]) n) WHERE len(w) > 0))
      SELECT e entity_id, count(*) n_facts, min(id) first_fact FROM (SELECT DISTINCT r.id, l.e FROM r JOIN l ON r.f = l.f WHERE length(l.f) >= 4) GROUP BY 1""",
}
