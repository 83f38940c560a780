"""Pattern databases in files: expressions with flags in front of a native block.

Big-endian: i32 count; for each expression i32 id (-1: none), the pattern as u16 length and modified UTF-8, i32 number of
flags and so many i32 flags; then i32 length of the native block and the block. We write the head with an empty block.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termscan.operators.compile import flag_names

MOST_EXPRESSIONS = 1_000_000
ROWS = "path string, id int, pattern string, flags array<int>, block_start long, block_bytes long, trailing_bytes long, error string"


class _Reader:
    def __init__(self, body: bytes):
        self.body, self.at = body, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.body):
            raise ValueError(f"truncated at byte {self.at}")
        self.at += n
        return self.body[self.at - n : self.at]

    def i32(self) -> int:
        return struct.unpack(">i", self.take(4))[0]

    def text(self) -> str:
        size = struct.unpack(">H", self.take(2))[0]
        units = self.take(size).replace(b"\xc0\x80", b"\x00").decode("utf-8", "surrogatepass")
        return units.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def read_head(body: bytes) -> dict:
    """Expressions (id, pattern, flags), the native block's place and size, and the bytes after it."""
    r = _Reader(body)
    count = r.i32()
    if not 0 <= count <= MOST_EXPRESSIONS:
        raise ValueError(f"implausible number of expressions: {count}")
    expressions = []
    for _ in range(count):
        number, pattern = r.i32(), r.text()
        expressions.append((None if number == -1 else number, pattern, [r.i32() for _ in range(r.i32())]))
    size = r.i32()
    start = r.at
    r.take(size)
    return {"expressions": expressions, "block_start": start, "block_bytes": size, "trailing_bytes": len(body) - r.at}


def write_head(expressions: list[tuple[int | None, str, list[int]]], block: bytes = b"") -> bytes:
    out = [struct.pack(">i", len(expressions))]
    for number, pattern, flags in expressions:
        units = b"".join(struct.pack(">H", u).decode("utf-16-be", "surrogatepass").encode("utf-8", "surrogatepass") for (u,) in struct.iter_unpack(">H", pattern.encode("utf-16-be"))).replace(b"\x00", b"\xc0\x80")
        out += [struct.pack(">iH", -1 if number is None else number, len(units)), units, struct.pack(f">i{len(flags)}i", len(flags), *flags)]
    return b"".join([*out, struct.pack(">i", len(block)), block])


def read_pattern_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each expression of each file; a file that cannot be read gives one row with the error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, body in zip(frame["path"], frame["content"], strict=True):
                try:
                    head = read_head(bytes(body))
                except ValueError as e:
                    rows.append((name, None, None, None, None, None, None, str(e)))
                    continue
                rows += [(name, *x, head["block_start"], head["block_bytes"], head["trailing_bytes"], None) for x in head["expressions"]]
            done = pd.DataFrame(rows, columns=[c.split()[0] for c in ROWS.split(", ")])
            yield done.astype({c: "Int64" for c in ("id", "block_start", "block_bytes", "trailing_bytes")})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ROWS)


def _named() -> Column:
    bits = F.aggregate(F.coalesce("flags", F.array().cast("array<int>")), F.lit(0), lambda a, b: a.bitwiseOR(b))
    return F.struct("id", "pattern", F.col("flags").alias("flags"), flag_names(bits).alias("flag_names"))


def dump_json(files: DataFrame) -> DataFrame:
    """path and json: each file's expressions with the names of their flags, or its error."""
    first = F.first("block_start", True).alias("block_start"), F.first("block_bytes", True).alias("block_bytes"), F.first("trailing_bytes", True).alias("trailing_bytes"), F.first("error", True).alias("error")
    each = files.withColumn("e", F.when(F.col("error").isNull(), _named()))
    done = each.groupBy("path").agg(F.count("e").alias("expression_count"), *first, F.array_sort(F.collect_list("e")).alias("expressions"))
    return done.select("path", F.to_json(F.struct("expression_count", "block_start", "block_bytes", "trailing_bytes", "error", "expressions")).alias("json"))


def dump_text(files: DataFrame) -> DataFrame:
    """path and line: one line for each expression, as a person reads it."""
    line = F.concat_ws("  ", F.coalesce(F.col("id").cast("string"), F.lit("-")), F.array_join(_named()["flag_names"], "|"), "pattern")
    return files.select("path", F.when(F.col("error").isNull(), line).otherwise(F.concat(F.lit("error: "), "error")).alias("line"))
