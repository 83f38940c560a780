"""A place for small files that every executor reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, one of our own (local mode) or in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = spark.sparkContext.master.startswith("local[")
        found = "file://" + tempfile.mkdtemp(prefix="termscan-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder that does not exist yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def put_text(spark: SparkSession, name: str, text: str) -> str:
    """Writes one text file into a new shared folder, and returns the folder's path."""
    path = new_folder(spark, name)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\n").text(path)
    return path
