"""Messages: tables by run, and folders of text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_messages(spark: SparkSession, path: str, run_date: str | None = None, execution: str | None = None, form: str = "parquet") -> DataFrame:
    """Messages of one run; RUN_DATE and PIPELINE_EXEC_ID are folders, so other runs are not read.

    form: any format that Spark reads. Avro needs Spark's own avro package on the session (spark.jars.packages).
    """
    rows = spark.read.format(form).load(path)
    for name, value in (("RUN_DATE", run_date), ("PIPELINE_EXEC_ID", execution)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows


def as_view(rows: DataFrame, name: str) -> DataFrame:
    """rows, which SQL can read from now on by the name."""
    rows.createOrReplaceTempView(name)
    return rows


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """One message for each file (message_id is its name); empty files are left out."""
    rows = spark.read.text(path, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("message_id"), F.col("value").alias("body"))
    return rows.where(F.trim("body") != "")


def write_run(rows: DataFrame, path: str) -> None:
    """Writes tables by run date; only the runs in rows are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(path)
