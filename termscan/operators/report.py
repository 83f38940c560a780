"""Scan reports: states of terms and the flat table of matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ["message_id", "term_id", "term_state", "match_text", "start", "end", "in_disclaimer", "alert"]


def term_states(pairs: DataFrame, hits: DataFrame) -> DataFrame:
    """The state of each message and term: FAILED, DISCLAIMER ONLY, NO HIT, AND MATCH or MATCHED.

    pairs: message_id, term_id, failed, post_filter. hits: message_id, term_id, in_disclaimer.
    """
    counts = hits.groupBy("message_id", "term_id").agg(F.count("*").alias("n"), F.bool_and("in_disclaimer").alias("only"))
    state = F.when(F.col("failed"), "FAILED").when(F.col("only"), "DISCLAIMER ONLY").when(F.col("n").isNull(), "NO HIT").when(F.col("post_filter"), "AND MATCH").otherwise("MATCHED")
    return pairs.join(counts, ["message_id", "term_id"], "left").select("message_id", "term_id", state.alias("term_state"), F.coalesce("n", F.lit(0)).alias("matches"))


def scan_report(states: DataFrame, hits: DataFrame) -> DataFrame:
    """One row for each match, and one for each message and term without."""
    rows = states.join(hits.select("message_id", "term_id", "match_text", "start", "end", "in_disclaimer"), ["message_id", "term_id"], "left")
    return rows.withColumn("alert", F.coalesce(~F.col("in_disclaimer"), F.lit(False))).select(*COLUMNS)


def message_totals(hits: DataFrame) -> DataFrame:
    """Matches and those that raise an alert, of each message."""
    return hits.groupBy("message_id").agg(F.count("*").alias("total_matches"), F.count_if(~F.col("in_disclaimer")).alias("alert_matches"))


def matched_states(lexicon: DataFrame, hits: DataFrame) -> DataFrame:
    """The states of the messages and terms that hit, without a row for every message and term: for large lexicons.

    lexicon: term_id, failed, post_filter. The others are NO HIT, or FAILED where the lexicon says so.
    """
    counts = hits.groupBy("message_id", "term_id").agg(F.count("*").alias("matches"), F.bool_and("in_disclaimer").alias("only"))
    state = F.when(F.col("only"), "DISCLAIMER ONLY").when(F.col("post_filter"), "AND MATCH").otherwise("MATCHED")
    return counts.join(lexicon.where("not failed"), "term_id").select("message_id", "term_id", state.alias("term_state"), "matches")


def timed(totals: DataFrame, began: float, ended: float) -> DataFrame:
    """totals with scan_duration_ms, of a scan that began and ended at these seconds."""
    return totals.withColumn("scan_duration_ms", F.lit(round((ended - began) * 1000)).cast("long"))


def scan_totals(states: DataFrame) -> DataFrame:
    return states.agg(F.countDistinct("message_id").alias("total_messages"), F.countDistinct("term_id").alias("total_terms"), F.countDistinct(F.when(F.col("matches") > 0, F.col("term_id"))).alias("matched_terms"), F.countDistinct(F.when(F.col("term_state") == "FAILED", F.col("term_id"))).alias("failed_terms"))


def write_csv(report: DataFrame, path: str) -> None:
    """The report as CSV files with a header, quotes doubled, CRLF line ends and a byte order mark in the first name."""
    first = "﻿" + report.columns[0]
    report.withColumnRenamed(report.columns[0], first).write.mode("overwrite").option("header", True).option("escape", '"').option("lineSep", "\r\n").csv(path)
