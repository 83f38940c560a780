"""Exact duplicates by deterministic block naming.

Normalised texts are cut into blocks of fixed size. Sorting the blocks gives each distinct one an integer name;
then adjacent pairs of names are named in the same way, until one name is left for each document. Equal
(number of blocks, last name) means equal texts: names come from comparing contents, so nothing can collide.

Each task first folds the equal blocks it meets itself, so that a text with millions of copies is sent once by
each task, not once by each copy, and no reducer gets more rows of one block than there are tasks. Contents are
shuffled once; everything after the first naming moves integers only.

Null texts count as empty; very long texts are many blocks. Rows with the same doc_id are rows of their own. A null doc_id is never the row that
stays unless all of its group have none; then keep_id is null and those rows count as kept. Extra columns of the
input are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, out, raw, sliced

BLOCK_BYTES = 16384
#: Bytes of blocks that a task remembers to fold equal ones; beyond it the memory starts anew.
FOLD_BYTES = 96 << 20

_CUT = "rid long, doc_id long, text_sha256 string, n_blocks int, pos int, rep long, content binary"
_SCHEMA = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("text_sha256", pa.string()), ("n_blocks", pa.int32()), ("pos", pa.int32()), ("rep", pa.int64()), ("content", pa.binary())])


def normalised(text):
    """Each run of ASCII white space as one space. Single spaces already are one, so the pattern skips them."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _cut(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, row, seen, held = TaskContext.get().partitionId() << 36, 0, {}, 0
        for batch in sliced(batches):
            cols: list[list] = [[] for _ in _SCHEMA]
            for doc_id, body in zip(batch.column("doc_id").to_pylist(), raw(batch), strict=True):
                rid, sha = base + row, hashlib.sha256(body).hexdigest()
                n = max(1, -(-len(body) // block_bytes))
                for pos in range(n):
                    block = body[pos * block_bytes : (pos + 1) * block_bytes]
                    rep = seen.get(block)
                    content = None
                    if rep is None:
                        if held > FOLD_BYTES:
                            seen, held = {}, 0
                        rep, content, held = base + row, block, held + len(block) + 120
                        seen[block] = rep
                    for col, value in zip(cols, (rid, doc_id, sha, n, pos, rep, content), strict=True):
                        col.append(value)
                    row += 1
            yield out(dict(enumerate(cols)), _SCHEMA)

    return run


def _named(distinct: DataFrame, key: list[str]) -> DataFrame:
    """Sorts the rows by key and gives the rows of each key one integer, the same for all of them."""
    placed = distinct.repartition(*key).sortWithinPartitions(*key).withColumn("at", F.monotonically_increasing_id())
    return placed.withColumn("name", F.min("at").over(Window.partitionBy(*key)))


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and n_blocks of every row."""
    store = Scratch(docs.sparkSession, "exact-dedup")
    cut = store.put(docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("text")).mapInArrow(_cut(block_bytes), _CUT), "blocks")
    names = _named(cut.where("content is not null").select("rep", "content"), ["content"]).select("rep", "name")
    first = store.put(cut.drop("content").join(names, "rep").drop("rep"), "level0")
    store.drop("blocks")
    ident = first.where("n_blocks = 1").select("doc_id", "text_sha256", "n_blocks", "name")
    longest = first.agg(F.max("n_blocks")).first()[0] or 1
    level = first.where("n_blocks > 1").select("rid", "n_blocks", F.col("n_blocks").alias("left_over"), "pos", "name")
    heads = first.where("n_blocks > 1 and pos = 0").select("rid", "doc_id", "text_sha256")
    for step in range(1, math.ceil(math.log2(longest)) + 1 if longest > 1 else 1):
        half = F.expr("pos div 2").cast("int")
        pairs = level.groupBy("rid", "n_blocks", "left_over", half.alias("at_pair")).agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("l"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("r"))
        pairs = store.put(pairs, f"pairs{step}")
        numbers = store.put(_named(pairs.select("l", "r").distinct(), ["l", "r"]).select("l", "r", "name"), f"names{step}")
        level = store.put(pairs.join(numbers, ["l", "r"]).select("rid", "n_blocks", F.expr("cast((left_over + 1) div 2 as int)").alias("left_over"), F.col("at_pair").alias("pos"), "name"), f"level{step}")
        store.drop(f"pairs{step}", f"names{step}")
        ident = ident.unionByName(level.where("left_over = 1").join(heads, "rid").select("doc_id", "text_sha256", "n_blocks", "name"))
        level = level.where("left_over > 1")
    ident = store.put(ident, "identity")
    groups = store.put(ident.groupBy("n_blocks", "name").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    return ident.join(groups, ["n_blocks", "name"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_blocks")
