"""Lexicons from files: JSON requests (plain or typed) and CSV, gzip or not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REQUEST = "lexiconRuleName string, terms array<struct<termId: string, termDescription: string, riskDriverName: string, termType: string>>"


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """rule, position, term_id, term_description, risk_driver_name, term_type of requests; unknown properties are ignored."""
    rows = spark.read.json(path, schema=REQUEST, multiLine=True).select(F.col("lexiconRuleName").alias("rule"), F.posexplode("terms").alias("position", "t"))
    return rows.select("rule", "position", F.col("t.termId").alias("term_id"), F.col("t.termDescription").alias("term_description"), F.col("t.riskDriverName").alias("risk_driver_name"), F.coalesce("t.termType", F.lit("Standard")).alias("term_type"))


def rule_name(path: Column) -> Column:
    """A file's name without its extension; a name that begins with its only dot stays whole."""
    name = F.element_at(F.split(F.coalesce(path, F.lit("unknown_rule")), "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def read_csv(spark: SparkSession, path: str, rule: str | None = None) -> DataFrame:
    """rule, term_id, term_description, risk_driver_name of CSV lexicons.

    A first line with "term id" in its first cell is a header; blank rows, comments (#) and rows of one cell are left out;
    a byte order mark is dropped; cells are trimmed. A backslash is a character like any other.
    """
    rows = spark.read.csv(path, schema="c0 string, c1 string, c2 string", header=False, quote='"', escape='"', ignoreLeadingWhiteSpace=True, multiLine=True, mode="PERMISSIVE")
    named = rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), *[F.trim(c).alias(c) for c in ("c0", "c1", "c2")])
    first = named.groupBy("file").agg(F.min("at").alias("first"))
    header = F.col("at").eqNullSafe(F.col("first")) & F.lower(F.coalesce("c0", F.lit(""))).contains("term id")
    kept = named.join(first, "file").where(~header & ~F.coalesce("c0", F.lit("")).startswith("#") & F.col("c1").isNotNull() & (F.concat_ws("", "c0", "c1", "c2") != ""))
    name = F.lit(rule.strip()) if rule and rule.strip() else rule_name(F.col("file"))
    return kept.select(name.alias("rule"), F.col("c0").alias("term_id"), F.col("c1").alias("term_description"), F.nullif(F.col("c2"), F.lit("")).alias("risk_driver_name"))


def safe_name(name: Column) -> Column:
    """A rule's name as a file name."""
    return F.when(F.trim(F.coalesce(name, F.lit(""))) == "", "lexicon_rule").otherwise(F.regexp_replace(name, "[^a-zA-Z0-9._-]", "_"))
