"""Readers of pages, tickets and pull threads: one row per document with id, source, version, time, title, text and anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import norm

COLUMNS = ["id", "source", "kind", "version", "lastmodified", "title", "content_hash", "text", "anchors"]
_COMMENT = "id string, author string, created string, body string"
TICKET = f"id string, key string, summary string, status string, type string, updated string, labels array<string>, description string, comments array<struct<{_COMMENT.replace(' string', ':string')}>>"
PULL = f"id string, number int, title string, state string, opened string, closed string, body string, files array<string>, comments array<struct<{_COMMENT.replace(' string', ':string')}>>"


def _stem() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.[^.]*$", 1)


def _instant(text: Column) -> Column:
    return F.try_to_timestamp(text)


def split_front_matter(text: Column) -> tuple[Column, Column]:
    """(header, body) of a text that begins with ``---``; without a header '' and the text itself."""
    has = text.startswith("---") & (F.locate("\n---", F.substring(text, 4, 2_000_000_000)) > 0)
    rest = F.substring(text, 4, 2_000_000_000)
    header = F.when(has, F.split_part(rest, F.lit("\n---"), F.lit(1))).otherwise(F.lit(""))
    body = F.when(has, F.ltrim(F.regexp_replace(F.substring(rest, F.length(header) + 5, F.lit(2_000_000_000)), r"^\s+", ""))).otherwise(text)
    return header, body


def _field(header: Column, *names: str) -> Column:
    found = [F.regexp_extract(header, rf"(?m)^{n}:\s*['\"]?(.*?)['\"]?\s*$", 1) for n in names]
    return F.coalesce(*[F.when(f != "", f) for f in found])


def read_pages(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Markdown pages with front matter; anchors are the slugs of their headings. A page without an id is named by its file."""
    raw = spark.read.text(path, wholetext=True).select("value", _stem().alias("stem"))
    header, body = split_front_matter(F.col("value"))
    rows = raw.select("value", "stem", header.alias("h"), body.alias("text"))
    h = F.col("h")
    heads = F.regexp_extract_all("text", F.lit(r"(?m)^#{1,6} +(.+?)\s*$"), F.lit(1))
    return rows.select(
        F.coalesce(_field(h, "id"), F.concat(F.lit(f"{kind}/"), "stem")).alias("id"), F.lit(norm.SOURCES.get(kind, "other")).alias("source"), F.lit(kind).alias("kind"),
        _field(h, "version", "headRevisionId").alias("version"), _instant(_field(h, "lastmodified", "modifiedTime")).alias("lastmodified"), _field(h, "title").alias("title"),
        F.sha1("value").alias("content_hash"), "text", F.transform(heads, norm.slug).alias("anchors"),
    )


def thread_text(title: Column, label: str, lead: Column, comments: Column) -> Column:
    """A thread as one text: title, labelled lead ('(empty)' if there is none), then every comment under its id, author and time."""
    # The marks and stand-ins of a thread's text.
    mark = lambda c: F.concat(
        F.lit("\n["), F.coalesce(c["id"], F.lit("None")), F.lit("] "), F.coalesce(c["author"], F.lit("?")), F.lit(" at "), F.coalesce(c["created"], F.lit("?")), F.lit(":\n"), F.coalesce(c["body"], F.lit(""))
    )
    start = F.concat(F.lit("# "), title, F.lit(f"\n\n[{label}]\n"), F.when(F.coalesce(lead, F.lit("")) == "", "(empty)").otherwise(lead))
    return F.concat_ws("\n", start, F.transform(F.coalesce(comments, F.array()), mark))


def read_tickets(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per file; version and time are ``updated``."""
    raw = spark.read.text(path, wholetext=True).select("value", _stem().alias("stem"))
    t = raw.select("value", "stem", F.from_json("value", TICKET).alias("t")).select("value", "stem", "t.*")
    title = F.concat(
        "key", F.lit(": "), F.coalesce("summary", F.lit("")), F.lit(" (status "), F.coalesce("status", F.lit("None")), F.lit(", type "), F.coalesce("type", F.lit("None")),
        F.lit(", labels "), F.array_join(F.coalesce("labels", F.array().cast("array<string>")), ", "), F.lit(")"),
    )
    return t.select(
        F.coalesce("id", F.concat(F.lit("ticket/"), F.coalesce("key", "stem"))).alias("id"), F.lit("tickets").alias("source"), F.lit("ticket").alias("kind"),
        F.coalesce("updated", F.lit("")).alias("version"), _instant(F.col("updated")).alias("lastmodified"), F.col("summary").alias("title"), F.sha1("value").alias("content_hash"),
        thread_text(title, "description", F.col("description"), F.col("comments")).alias("text"),
        F.concat(F.array(F.lit("description")), F.transform(F.coalesce("comments", F.array()), lambda c: c["id"])).alias("anchors"),
    )


def read_pulls(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per file; the time is the latest of opened, closed and the comments."""
    raw = spark.read.text(path, wholetext=True).select("value", _stem().alias("stem"))
    t = raw.select("value", "stem", F.from_json("value", PULL).alias("t")).select("value", "stem", "t.*")
    comments = F.coalesce("comments", F.array())
    latest = F.array_max(F.concat(F.array(_instant(F.col("closed")), _instant(F.col("opened"))), F.transform(comments, lambda c: F.try_to_timestamp(c["created"]))))
    title = F.concat(
        F.lit("Pull request #"), F.col("number").cast("string"), F.lit(": "), F.coalesce("title", F.lit("")), F.lit(" ("), F.coalesce("state", F.lit("None")), F.lit("; files: "),
        F.array_join(F.coalesce("files", F.array().cast("array<string>")), ", "), F.lit(")"),
    )
    return t.select(
        F.coalesce("id", F.concat(F.lit("pull/"), F.coalesce(F.col("number").cast("string"), "stem"))).alias("id"), F.lit("pulls").alias("source"), F.lit("pull").alias("kind"),
        F.date_format(latest, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("version"), latest.alias("lastmodified"), "title", F.sha1("value").alias("content_hash"),
        thread_text(title, "body", F.col("body"), F.col("comments")).alias("text"),
        F.concat(F.array(F.lit("body")), F.transform(comments, lambda c: c["id"])).alias("anchors"),
    )


def read_all(spark: SparkSession, root: str, wiki: str = "wiki/*.md", docs: str = "docs/*.md", tickets: str = "tickets/*.json", pulls: str = "pulls/*.json") -> DataFrame:
    """All text sources under a folder as one table."""
    parts = [read_pages(spark, f"{root}/{wiki}", "wiki"), read_pages(spark, f"{root}/{docs}", "doc"), read_tickets(spark, f"{root}/{tickets}"), read_pulls(spark, f"{root}/{pulls}")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
