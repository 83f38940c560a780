"""Lexicon scans of streams: scan columns hold no state, so they work on a stream as on a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from termscan.operators.multiscan import scan


def scan_stream(spark: SparkSession, path: str, schema, text: str, lexicon: Sequence[tuple[str, str]], form: str = "parquet") -> DataFrame:
    """Hits of files as they arrive in a folder."""
    return scan(spark.readStream.format(form).schema(schema).load(path), text, lexicon)


def write_hits(hits: DataFrame, path: str, checkpoint: str):
    """Appends hits to a folder, each once; ends when what is there is done."""
    return hits.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
