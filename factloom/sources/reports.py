"""Readers of test reports: ``node_id, outcome, step, commit, attempt, run_id``, one row per reported test."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.scratch import Scratch

_META = "metadata struct<commit:string,step:string>"


def _run() -> list:
    run = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.[^.]*$", 1)
    return [run.alias("run_id"), F.when(run.endswith("-rerun"), 2).otherwise(1).alias("attempt")]


def _shape(df: DataFrame) -> DataFrame:
    return df.select("node_id", "outcome", "step", "commit", "attempt", "run_id")


def read_pytest_json(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(f"tests array<struct<nodeid:string,outcome:string>>, {_META}").json(path, multiLine=True)
    rows = raw.select(F.explode("tests").alias("t"), "metadata.*", *_run())
    return _shape(rows.select(F.col("t.nodeid").alias("node_id"), F.col("t.outcome").alias("outcome"), "step", "commit", "attempt", "run_id"))


def read_vitest_json(spark: SparkSession, path: str) -> DataFrame:
    """A test is named by its ancestors' titles and its own, joined by ' > '."""
    one = "struct<ancestorTitles:array<string>,title:string,status:string>"
    raw = spark.read.schema(f"testResults array<struct<assertionResults:array<{one}>>>, {_META}").json(path, multiLine=True)
    rows = raw.select(F.explode("testResults").alias("s"), "metadata.*", *_run()).withColumn("a", F.explode("s.assertionResults"))
    name = F.array_join(F.concat(F.coalesce("a.ancestorTitles", F.array().cast("array<string>")), F.array(F.coalesce("a.title", F.lit("")))), " > ")
    return _shape(rows.select(name.alias("node_id"), F.col("a.status").alias("outcome"), "step", "commit", "attempt", "run_id"))


def read_reportlog(spark: SparkSession, path: str, step: str | None = None, commit: str | None = None) -> DataFrame:
    """JSON lines; the call's outcome counts (the last one), a skip at setup only where no call is reported."""
    raw = spark.read.schema("`$report_type` string, nodeid string, `when` string, outcome string").json(path)
    rows = raw.select("*", *_run(), F.monotonically_increasing_id().alias("n")).where("`$report_type` = 'TestReport' AND nodeid IS NOT NULL AND outcome IS NOT NULL")
    called = F.max(F.when(F.col("when") == "call", F.struct("n", "outcome")))["outcome"]
    skipped = F.max(F.when((F.col("when") == "setup") & (F.col("outcome") == "skipped"), F.lit("skipped")))
    out = rows.groupBy(F.col("nodeid").alias("node_id"), "run_id", "attempt").agg(F.coalesce(called, skipped).alias("outcome")).where("outcome IS NOT NULL")
    return _shape(out.withColumns({"step": F.lit(step), "commit": F.lit(commit)}))


def read_junit(spark: SparkSession, path: str, commit: str | None = None) -> DataFrame:
    """JUnit XML: a failure, error or skipped child names the outcome, none means passed."""
    child = T.StructType([T.StructField("_message", T.StringType()), T.StructField("_VALUE", T.StringType())])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("_name", "_classname")] + [T.StructField(n, child) for n in ("failure", "error", "skipped")])
    raw = spark.read.format("xml").option("rowTag", "testcase").schema(schema).load(path).select("*", *_run())
    outcome = F.when(F.col("skipped").isNotNull(), "skipped").when(F.col("error").isNotNull(), "error").when(F.col("failure").isNotNull(), "failed").otherwise("passed")
    named = F.when(F.coalesce("_classname", F.lit("")) != "", F.concat("_classname", F.lit("::"), F.coalesce("_name", F.lit("")))).otherwise(F.coalesce("_name", F.lit("")))
    return _shape(raw.select(named.alias("node_id"), outcome.alias("outcome"), F.lit(None).cast("string").alias("step"), F.lit(commit).alias("commit"), "attempt", "run_id"))


def read_playwright_json(spark: SparkSession, path: str) -> DataFrame:
    """Nested suites unrolled level by level, as deep as they go; the last result of a test counts.

    A test is named by the titles of the suites below its file's own one and its own title, joined by ' › ', the project before them.
    """
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"), *_run())
    suites = F.expr("try_variant_get(v, '$.suites', 'array<variant>')")
    scratch = Scratch(spark, "suites")
    level = scratch.save(raw.select("run_id", "attempt", F.explode(suites).alias("s")).select("run_id", "attempt", F.expr("to_json(s)").alias("s"), F.array().cast("array<string>").alias("path")), "level")
    found: list[DataFrame] = []
    while not level.isEmpty():
        parsed = level.withColumn("s", F.parse_json("s"))
        specs = parsed.select("run_id", "attempt", "path", F.explode(F.expr("try_variant_get(s, '$.specs', 'array<variant>')")).alias("spec"))
        tests = specs.select("run_id", "attempt", "path", F.expr("coalesce(try_variant_get(spec, '$.title', 'string'), '')").alias("title"), F.explode(F.expr("try_variant_get(spec, '$.tests', 'array<variant>')")).alias("t"))
        status = F.expr("try_element_at(try_variant_get(t, '$.results', 'array<variant>'), -1)")
        rows = tests.select("run_id", "attempt", F.array_join(F.concat("path", F.array("title")), " › ").alias("name"), F.expr("try_variant_get(t, '$.projectName', 'string')").alias("project"), status.alias("r"))
        rows = rows.select(
            F.concat_ws(" › ", F.concat(F.lit("["), "project", F.lit("]")), "name").alias("node_id"), F.expr("try_variant_get(r, '$.status', 'string')").alias("outcome"),
            F.lit(None).cast("string").alias("step"), F.lit(None).cast("string").alias("commit"), "attempt", "run_id",
        )
        found.append(scratch.save(rows, "tests"))
        below = parsed.select("run_id", "attempt", F.explode(F.expr("try_variant_get(s, '$.suites', 'array<variant>')")).alias("s"), "path")
        titled = F.concat("path", F.array(F.expr("coalesce(try_variant_get(s, '$.title', 'string'), '')")))
        level = scratch.save(below.select("run_id", "attempt", F.expr("to_json(s)").alias("s"), titled.alias("path")), "level")
    if not found:
        return _shape(spark.createDataFrame([], "node_id string, outcome string, step string, commit string, attempt int, run_id string"))
    return _shape(scratch.together(found))


#: The shape of a report, by what it holds at its top.
_SHAPES = {"tests": "pytest", "testResults": "vitest", "suites": "playwright"}


def report_shapes(spark: SparkSession, path: str) -> DataFrame:
    """``path, shape`` of every JSON report of a folder: pytest, vitest, playwright or unknown, by what it holds and not by its name."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v"))
    held = F.coalesce(*[F.when(F.expr(f"variant_get(v, '$.{k}', 'variant') IS NOT NULL"), F.lit(shape)) for k, shape in _SHAPES.items()], F.lit("unknown"))
    return raw.select("path", held.alias("shape"))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All JSON reports of a folder, each by the reader of its shape; only the list of files reaches the driver."""
    readers = {"pytest": read_pytest_json, "vitest": read_vitest_json, "playwright": read_playwright_json}
    by: dict[str, list[str]] = {}
    for row in report_shapes(spark, path).collect():
        by.setdefault(row["shape"], []).append(row["path"])
    parts = [readers[shape](spark, files) for shape, files in sorted(by.items()) if shape in readers]
    empty = spark.createDataFrame([], "node_id string, outcome string, step string, commit string, attempt int, run_id string")
    return reduce(DataFrame.unionByName, parts, empty)


def cross_check(collected: DataFrame, reported: DataFrame) -> DataFrame:
    """``node_id, side`` of tests that only one of the two tables has."""
    a, b = collected.select("node_id").distinct(), reported.select("node_id").distinct()
    return a.exceptAll(b).withColumn("side", F.lit("collected")).unionByName(b.exceptAll(a).withColumn("side", F.lit("reported")))
