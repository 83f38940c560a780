"""Where a pattern matches: leftmost, non-overlapping, greedy matches with character and byte positions.

The text is split at its matches, and positions come from the lengths of what is between them and of the matches themselves,
all in built-in functions; no character of the text is special. Patterns that can match the empty string are not for these
functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def pieces(text: Column, pattern: str) -> Column:
    """An array of structs gap (what is before a match) and hit (the match); the last one's hit is null."""
    return F.zip_with(F.split(_text(text), pattern, -1), match_texts(text, pattern), lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))


def match_texts(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(_text(text), F.lit(pattern), F.lit(0))


def match_count(text: Column, pattern: str) -> Column:
    return F.size(match_texts(text, pattern)).cast("long")


def matches(text: Column, pattern: str) -> Column:
    """An array of structs text, start, end (characters, end exclusive), byte_start, byte_end (bytes, end inclusive)."""
    # one pass over the pieces carries the two offsets along
    zero = F.struct(F.lit(0).alias("c"), F.lit(0).alias("b"), F.array().cast("array<struct<text:string,start:int,end:int,byte_start:int,byte_end:int>>").alias("found"))

    def step(acc: Column, piece: Column) -> Column:
        c, b = acc["c"] + F.length(piece["gap"]), acc["b"] + F.octet_length(piece["gap"])
        n, size = F.coalesce(F.length(piece["hit"]), F.lit(0)), F.coalesce(F.octet_length(piece["hit"]), F.lit(0))
        hit = F.struct(piece["hit"].alias("text"), c.alias("start"), (c + n).alias("end"), b.alias("byte_start"), (b + size - 1).alias("byte_end"))
        return F.struct((c + n).alias("c"), (b + size).alias("b"), F.when(piece["hit"].isNotNull(), F.concat(acc["found"], F.array(hit))).otherwise(acc["found"]).alias("found"))

    return F.aggregate(pieces(text, pattern), zero, step, lambda acc: acc["found"])


def with_delta(found: DataFrame, keys: list[str], order: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """found with delta: from the end of the match before to the start of this one, 0 for the first."""
    before = F.lag(end).over(Window.partitionBy(*keys).orderBy(*order))
    return found.withColumn("delta", F.coalesce(F.col(start) - before, F.lit(0)))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def highlighted(text: Column, pattern: str) -> Column:
    """The text as HTML, matches marked."""
    mark = lambda p: F.concat(escape_html(p["gap"]), F.when(p["hit"].isNull(), "").otherwise(F.concat(F.lit('<mark class="lex-match">'), escape_html(p["hit"]), F.lit("</mark>"))))
    return F.array_join(F.transform(pieces(text, pattern), mark), "")
