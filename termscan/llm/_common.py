"""Shared helpers: intermediate tables in the cluster's shared folder, and bounded Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one step of a Python operator holds at a time.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, one of our own (local mode) or in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.startswith("local["):
            found = "file://" + tempfile.mkdtemp(prefix="termscan-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage, and outlive any executor."""

    def __init__(self, spark: SparkSession, name: str):
        bounded(spark)
        self.spark = spark
        self.dir = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str, **by) -> DataFrame:
        path = f"{self.dir}/{name}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if "partition" in by:
            writer = writer.partitionBy(by["partition"])
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that no plan reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.dir}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(spark: SparkSession) -> None:
    """Rows and bytes that Spark sends to Python at once, so that a batch of long texts stays within some MB."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2_000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        if int(spark.conf.get(name).rstrip("b")) > most:
            spark.conf.set(name, str(most))


def sliced(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of about `limit` bytes of `column`, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def raw(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's strings as UTF-8."""
    col = batch.column(column)
    if pa.types.is_string(col.type):
        col = col.cast(pa.binary())
    elif pa.types.is_large_string(col.type):
        col = col.cast(pa.large_binary())
    return [t or b"" for t in col.to_pylist()]


def out(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns.values(), schema, strict=True)], schema=schema)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the text's 64-bit hash; other columns, whatever their names, are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


class Remembered(dict):
    """Bytes by word, as long as they take no more than `limit` bytes of memory, by a rough measure."""

    held, limit = 0, 128 << 20

    def fits(self, word: str | bytes, size: int = 0) -> None:
        """Counts a word that is remembered; size: bytes of what is remembered of it."""
        self.held += 120 + 2 * len(word) + size

    @property
    def full(self) -> bool:
        return self.held > self.limit

    def joined(self, cut: list[list], learn) -> list[bytes]:
        """The bytes of each row's words; learn(words) makes those known that are new."""
        found = [list(map(self.get, words)) for words in cut]
        lacking = [i for i, parts in enumerate(found) if None in parts]
        if lacking:
            learn({w for i in lacking for w, x in zip(cut[i], found[i], strict=True) if x is None})
            for i in lacking:
                found[i] = [self[w] if x is None else x for w, x in zip(cut[i], found[i], strict=True)]
        return [b"".join(parts) for parts in found]
