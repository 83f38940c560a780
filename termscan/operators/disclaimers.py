"""Disclaimers: matches inside standing phrases raise no alert."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termscan.functions import matches as found


def from_text(spark: SparkSession, text: str) -> DataFrame:
    """disclaimer_id and disclaimer_text: parts between blank lines."""
    return spark.createDataFrame([(text,)], "t string").select(F.posexplode(F.split("t", r"\n\s*\n")).alias("i", "p")).where("trim(p) <> ''").select((F.col("i") + 1).cast("string").alias("disclaimer_id"), F.trim("p").alias("disclaimer_text"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """disclaimer_id and disclaimer_text of CSV files with a header (id, disclaimer_text, in any order); blank texts are left out."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=True, enforceSchema=False)
    names = {c.strip("\ufeff ").lower(): c for c in rows.columns}
    if not {"id", "disclaimer_text"} <= names.keys():
        raise ValueError(f"columns id and disclaimer_text are needed, there are {', '.join(rows.columns)}")
    return rows.select(F.trim(F.col(f"`{names['id']}`")).alias("disclaimer_id"), F.trim(F.col(f"`{names['disclaimer_text']}`")).alias("disclaimer_text")).where("disclaimer_text <> ''")


def normalised(text: Column) -> Column:
    """Without tags, entities decoded, runs of white space as one space."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def pattern(disclaimers: list[str]) -> str:
    """One pattern of all disclaimers, the longest first."""
    return "|".join(re.sub(r"([^\w\s])", r"\\\1", d) for d in sorted(disclaimers, key=lambda d: (-len(d), d)))


def spans(text: Column, disclaimers: list[str]) -> Column:
    return found.matches(text, pattern(disclaimers))


def in_disclaimer(start: Column, end: Column, where: Column) -> Column:
    """The match lies inside one of the spans."""
    return F.exists(where, lambda s: (s["start"] <= start) & (end <= s["end"]))
