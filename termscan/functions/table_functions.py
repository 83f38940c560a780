"""Table functions for SQL: translate_term(description, type) and pattern_file(content)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from termscan.operators.compile import STANDARD, compile_term
from termscan.sources.pattern_files import read_head


class TranslateTerm:
    """One row: the term's verdict. On executors only the language's own checks run, not Java's."""

    def eval(self, description: str, term_type: str) -> Iterator[tuple]:
        done = compile_term(description, term_type or STANDARD)
        yield tuple(done[k] for k in ("status", "pattern", "flags", "post_filter", "translation_error", "error_log", "warning"))


class PatternFile:
    """One row for each expression of a pattern file's bytes; an unreadable file gives one row with the error."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        try:
            head = read_head(bytes(content or b""))
        except ValueError as e:
            yield None, None, None, str(e)
            return
        for number, pattern, flags in head["expressions"]:
            yield number, pattern, flags, None


translate_term = udtf(TranslateTerm, returnType="status string, pattern string, flags int, post_filter boolean, translation_error string, error_log string, warning string")
pattern_file = udtf(PatternFile, returnType="id int, pattern string, flags array<int>, error string")


def register(spark: SparkSession) -> None:
    """Makes both known to SQL."""
    spark.udtf.register("translate_term", translate_term)
    spark.udtf.register("pattern_file", pattern_file)
