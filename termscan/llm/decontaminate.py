"""Benchmark decontamination by n-gram windows.

Words are the runs of ASCII digits, letters (lower-cased) and non-ASCII characters. A benchmark item's windows are its
n consecutive words; an item of fewer words, but not none, is one window. Their hashes form a set that every task
holds; a task hashes all windows of its documents, and each hit is verified word by word. A document word inside any
occurrence of a window is hit.

The set is shared as a whole only while the benchmark has at most `block_words` words, which is counted first. A larger
benchmark is taken in blocks of that size, each against all documents, and the hits of the blocks are united.

Null texts have no words; very long texts are scanned whole, one at a time. Documents without words have no hits. Null item ids hit like any other, but are not listed.
Rows that share doc_id and text get the same result each. Extra columns are ignored; with an empty benchmark nothing is
contaminated.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, keyed, out, raw, sliced

WORDS = 10
#: Benchmark words that are shared with every task at once: some tens of MB.
BLOCK_WORDS = 500_000

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
FOLD = bytes(b if b in _KEEP else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_MULTIPLIERS = np.random.default_rng(7).integers(1, 2**63, 64, np.uint64) | np.uint64(1)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Windows:
    """The windows of some benchmark items, ready to be looked for."""

    def __init__(self, items: list[tuple[str | None, bytes]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        by: dict[int, dict[tuple, set]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            size = min(n, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                by.setdefault(size, {}).setdefault(tuple(ids[i : i + size]), set()).add(item)
        self.sets = []
        for size, windows in sorted(by.items()):
            rows = np.array(list(windows), np.int64)
            codes = self._hash(rows.ravel(), size)[::size] if len(rows) else np.zeros(0, np.uint64)
            order = np.argsort(codes, kind="stable")
            seen = np.zeros(1 << 22, bool)
            seen[codes >> np.uint64(42)] = True
            owners = list(windows.values())
            self.sets.append((size, codes[order], rows[order], [owners[i] for i in order], seen))

    @staticmethod
    def _hash(ids: np.ndarray, size: int) -> np.ndarray:
        n = len(ids) - size + 1
        total, flat = np.zeros(n, np.uint64), ids.astype(np.uint64)
        for j in range(size):
            total += flat[j : j + n] * _MULTIPLIERS[j]
        return (total ^ (total >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int, set]]:
        """Start, size and items of each window that occurs in ids."""
        for size, codes, rows, owners, seen in self.sets:
            if len(ids) < size:
                continue
            found = self._hash(ids, size)
            at = np.flatnonzero(seen[found >> np.uint64(42)])
            lo, hi = np.searchsorted(codes, found[at], "left"), np.searchsorted(codes, found[at], "right")
            for i, a, b in zip(at[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
                for k in range(a, b):
                    if (rows[k] == ids[i : i + size]).all():
                        yield i, size, owners[k]


#: The windows that this worker made last, by the name of their block: made once, not by every task.
_last: dict[str, Windows] = {}


def _ready(name: str, shared, n: int) -> Windows:
    if name not in _last:
        _last.clear()
        _last[name] = Windows(shared.value, n)
    return _last[name]


_FOUND = pa.schema([("doc_id", pa.int64()), ("same", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])
_FOUND_SQL = "doc_id long, same long, n_words long, spans array<int>, items array<string>"


def _scan(docs: DataFrame, items: list, n: int) -> DataFrame:
    """Of each row: the merged spans of its hit words (start, end, start, end ...) and the items found."""
    shared, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _ready(name, shared, n)
        get = look.vocabulary.get
        for batch in sliced(batches):
            lists = [words_of(t) for t in raw(batch)]
            sizes = np.array([len(x) for x in lists], np.int64)
            begins = np.concatenate([[0], np.cumsum(sizes + 1)])
            flat = np.zeros(begins[-1], np.int64)
            for x, b in zip(lists, begins.tolist(), strict=False):
                flat[b : b + len(x)] = np.fromiter(map(get, x, repeat(0)), np.int64, len(x))
            spans: list[list] = [[] for _ in lists]
            items: list[set] = [set() for _ in lists]
            for i, size, owners in sorted(look.hits(flat), key=lambda x: x[:2]):
                row = int(np.searchsorted(begins, i, "right")) - 1
                a = i - int(begins[row])
                if spans[row] and a <= spans[row][-1]:
                    spans[row][-1] = max(spans[row][-1], a + size)
                else:
                    spans[row] += [a, a + size]
                items[row] |= owners
            yield out({"doc_id": batch.column("doc_id"), "same": batch.column("same"), "n": sizes, "spans": spans, "items": [sorted(x for x in s if x is not None) for s in items]}, _FOUND)

    return docs.mapInArrow(run, _FOUND_SQL)


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list]:
    """Items in blocks of at most block_words words (by white space and marks, an upper bound by characters), one item at least."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    block, held = [], 0
    for row in rows.toLocalIterator():
        size = len(words_of(row["text"].encode()))
        if block and held + size > block_words:
            yield block
            block, held = [], 0
        block.append((row["item_id"], row["text"].encode()))
        held += size
    if block:
        yield block


def _united(spans: Column) -> Column:
    """Spans (start, end, start, end ...) in order, those that touch made one."""
    pairs = F.when(F.size(spans) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.size(spans) / 2).cast("int") - 1)), lambda i: F.struct(spans[i * 2].alias("a"), spans[i * 2 + 1].alias("b")))).otherwise(F.array().cast("array<struct<a:int,b:int>>"))

    def step(acc: Column, p: Column) -> Column:
        n = F.size(acc)
        last = F.element_at(acc, -1)
        return F.when((n > 0) & (p["a"] <= last), F.concat(F.slice(acc, 1, n - 1), F.array(F.greatest(last, p["b"])))).otherwise(F.concat(acc, F.array(p["a"], p["b"])))

    return F.aggregate(F.array_sort(pairs), F.array().cast("array<int>"), step)


def found(docs: DataFrame, benchmark: DataFrame, n: int = WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, same (the text's hash), n_words, spans of hit words and items of every row."""
    rows = keyed(docs).withColumn("same", F.xxhash64("text"))
    store = None
    base, rest = None, None
    for block in _blocks(benchmark, block_words):
        part = _scan(rows, block, n)
        if base is None:
            base, first = part, block
            continue
        store = store or Scratch(docs.sparkSession, "decontaminate")
        if rest is None:
            base, rest = store.put(base, "block0"), []
        rest.append(store.put(part.where("size(spans) > 0").dropDuplicates(["doc_id", "same"]), f"block{len(rest) + 1}"))
    if base is None:
        return _scan(rows, [], n)
    if not rest:
        return base
    more = rest[0]
    for x in rest[1:]:
        more = more.unionByName(x)
    more = more.groupBy("doc_id", "same").agg(F.flatten(F.collect_list("spans")).alias("s"), F.flatten(F.collect_list("items")).alias("i"))
    both = base.alias("b").join(more.alias("m"), F.col("b.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("b.same") == F.col("m.same")), "left")
    return both.select("b.doc_id", "b.same", "b.n_words", F.when(F.col("m.s").isNull(), F.col("b.spans")).otherwise(_united(F.concat("b.spans", "m.s"))).alias("spans"), F.array_sort(F.array_union("b.items", F.coalesce("m.i", F.array().cast("array<string>")))).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans and items of every row."""
    n_hit = F.expr("cast(aggregate(spans, 0, (a, x) -> x - a) as long)")  # -s1 + e1 - s2 + e2 ... for an even number of ends
    return found(docs, benchmark, n, block_words).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans", "items",
    )


def clean(docs: DataFrame, benchmark: DataFrame, n: int = WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs, all columns as they are, without those that hold a benchmark window."""
    hit = found(docs, benchmark, n, block_words).where("size(spans) > 0").select(F.col("doc_id").alias("_hit_doc"), F.col("same").alias("_hit_same"))
    same = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(hit, docs["doc_id"].cast("long").eqNullSafe(hit["_hit_doc"]) & (same == hit["_hit_same"]), "left_anti")


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
