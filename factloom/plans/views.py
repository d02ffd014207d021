"""Relations of the evidence model over the test tables. Each view is a lazy plan; the SQL of the same view is kept beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import norm
from factloom.session import table


def stored(spark: SparkSession, sf: str, *columns: str, once: bool = True) -> DataFrame:
    """stored_fact with every row once; only the asked columns are read.

    A row delivered twice is repeated whole, so the distinct rows are the facts, and conditions on any column pass to the scan. Aggregates
    that do not mind repeated rows (least, greatest, distinct counts) leave them in (``once`` false) and save the shuffle.
    """
    rows = table(spark, sf, "stored_fact").select("id", *columns).where("id IS NOT NULL")
    return rows.distinct() if once else rows


STORED = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at) rn_ FROM stored_fact WHERE id IS NOT NULL) WHERE rn_ = 1)"


def fact(spark: SparkSession, sf: str) -> DataFrame:
    """Facts with a claim: entity, attribute, value (a number's plain digits, else the text), unit, tier, period and source."""
    rows = stored(spark, sf, "claim_entity", "claim_attribute", "claim_value", "claim_number", "claim_unit", "tier", "valid_at", "invalid_at", "created_at", "expired_at", "source_key", "confidence")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    number = F.nanvl(F.col("claim_number"), F.lit(None).cast("double"))
    said = F.col("claim_value")
    value = F.coalesce(norm.number_text(number), norm.number_text(norm.value_number(said)), norm.value_text(said))
    return rows.where("claim_entity IS NOT NULL AND claim_attribute IS NOT NULL").select(
        "id", F.col("claim_entity").alias("entity"), norm.attribute(F.col("claim_attribute")).alias("attribute"), value.alias("value"), norm.unit(F.col("claim_unit")).alias("unit"), "tier",
        us("valid_at").alias("valid_us"), us("invalid_at").alias("invalid_us"), us("created_at").alias("created_us"), us("expired_at").alias("expired_us"), "source_key",
        F.nanvl(F.col("confidence").cast("double"), F.lit(None).cast("double")).alias("confidence"),
    )


_SAID = r"replace(lower(trim(claim_value)), ',', '')"
_NUM = r"'^\$?\s*(-?[0-9]+(?:\.[0-9]+)?)\s*(?:%|usd)?$'"
_DIGITS = r"regexp_replace(regexp_replace(CAST(CAST({0} AS DECIMAL(28,6)) AS VARCHAR), '0+$', ''), '\.$', '')"
UNIT = "CASE WHEN u NOT IN ('', 'none', 'null') THEN CASE u {0} ELSE u END END".format(" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in norm.UNITS.items()))
FACT = f"""(SELECT id, claim_entity entity, trim(regexp_replace(lower(claim_attribute), '[^a-z0-9]+', '_', 'g'), '_') AS "attribute",
  coalesce({_DIGITS.format("CASE WHEN NOT isnan(claim_number) THEN claim_number END")}, {_DIGITS.format(f"CASE WHEN regexp_matches({_SAID}, {_NUM}) THEN CAST(regexp_extract({_SAID}, {_NUM}, 1) AS DOUBLE) END")},
    CASE WHEN NOT regexp_matches({_SAID}, {_NUM}) THEN {_SAID} END) AS "value", {UNIT} unit, tier,
  epoch_us(valid_at) valid_us, epoch_us(invalid_at) invalid_us, epoch_us(created_at) created_us, epoch_us(expired_at) expired_us, source_key, CASE WHEN NOT isnan(confidence) THEN CAST(confidence AS DOUBLE) END confidence
  FROM (SELECT *, lower(trim(claim_unit)) u FROM {STORED}) WHERE claim_entity IS NOT NULL AND claim_attribute IS NOT NULL)"""
RANK = "CASE {0} WHEN 'executed' THEN 3 WHEN 'code' THEN 2 WHEN 'documented' THEN 1 ELSE 0 END"


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Test outcomes from lineitem: one row per node, step and attempt."""
    li = table(spark, sf, "lineitem")
    order = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag")
    return li.groupBy(
        F.col("l_partkey").alias("node"), (F.year("l_shipdate") - 1995).cast("int").alias("step"), F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("attempt")
    ).agg(F.max_by(F.when(F.col("l_returnflag") == "A", "passed").when(F.col("l_returnflag") == "R", "failed").otherwise("skipped"), order).alias("outcome"))


RUNS = """(SELECT l_partkey node, CAST(year(l_shipdate) - 1995 AS INTEGER) step, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END attempt,
  arg_max(CASE l_returnflag WHEN 'A' THEN 'passed' WHEN 'R' THEN 'failed' ELSE 'skipped' END,
          row(l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag)) outcome
  FROM lineitem GROUP BY 1, 2, 3)"""


def registry(spark: SparkSession, sf: str, *columns: str, once: bool = True) -> DataFrame:
    """document_registry with every registration once (see :func:`stored`); only the asked columns are read."""
    rows = table(spark, sf, "document_registry").select("reg_id", *columns).where("reg_id IS NOT NULL")
    return rows.distinct() if once else rows


REGISTRY = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY reg_id ORDER BY ingested_at) rn_ FROM document_registry WHERE reg_id IS NOT NULL) WHERE rn_ = 1)"
