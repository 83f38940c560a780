"""Removal of repeated passages, exact to the byte, over a logarithmic family of suffix arrays.

A byte is removed if a string of `length` bytes (200) that covers it starts anywhere else too, in the same document or
another; strings do not cross documents and are judged on the input.

Sampled suffixes. Every `length`-byte string holds an anchor: the leftmost place where the hash of the next `GRAM` bytes
is smallest. Equal strings have the same anchor at the same offset, so only suffixes at anchors (about one in 85
bytes) are kept. The strings that share an anchor start at consecutive places first..last; the anchor's context is the
bytes those strings cover. An array holds, sorted by the gram's hash and the context's 128-bit digest, how often each
context occurs.

The family. A new batch's suffixes are sorted into an array, which is merge-scanned against the levels that exist: equal
contexts are long matches as a whole, equal grams with different contexts are matches to be looked at in part. Levels
of equal size are then merged, so n batches leave about log2(n) levels and each suffix is rewritten log2(n) times.

Partial matches. The contexts of a gram are brought together, one for each different context, and the strings in them
compared; grams with very many different contexts have theirs compared by digest instead, in as many tasks as needed.
So no group of copies ever meets in one task: copies have one context, and are only counted.

Null texts count as empty; very long texts are read whole. Rows that share doc_id and text are rows of their own, and repeat each other. Extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, keyed, out, raw, sliced

LENGTH = 200
GRAM = 32
#: Batches that a corpus is taken in. Each is scanned against all levels, so many batches cost a scan of the family each.
BATCHES = 4
#: A gram's different contexts that are compared in one task (some 5 MB); grams with more have their strings compared by digest.
TOGETHER = 16_384

_BASE = 0x5851F42D4C957F2D
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 17)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def rolling(body: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each `size` consecutive bytes."""
    up, down = _powers(len(body) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((body.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    code = (sums[size:] - sums[:-size]) * down[: len(body) - size + 1]
    code ^= code >> np.uint64(32)
    code *= np.uint64(0x9E3779B97F4A7C15)
    code ^= code >> np.uint64(29)
    return code


def anchors(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The gram hash of each anchor, and the first and last start of the strings that have it."""
    n = len(text) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = rolling(np.frombuffer(text, np.uint8), GRAM)
    least = (code & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(code), dtype=np.uint64)
    span, step = length - GRAM + 1, 1
    while step * 2 <= span:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if span > step:
        least = np.minimum(least[: step - span], least[span - step :])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return code[place[first]], first, np.append(first[1:], n) - 1


def _digests(parts) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in parts), "<i8").reshape(-1, 2)


_ENTRIES = "doc_id long, same long, gram long, c1 long, c2 long, first int, last int"
_ENTRY_SCHEMA = pa.schema([("doc_id", pa.int64()), ("same", pa.int64()), ("gram", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])


def suffixes(rows: DataFrame, length: int) -> DataFrame:
    """The sampled suffixes of keyed documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found, digests, counts = [], [], []
            for text in raw(batch):
                code, first, last = anchors(text, length)
                counts.append(len(code))
                if len(code):
                    found.append((code.view(np.int64), first, last))
                    view = memoryview(text)
                    digests.append(_digests(view[a:b] for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)))
            if not found:
                continue
            gram, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
            c = np.concatenate(digests)
            at = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield out({"d": batch.column("doc_id").take(at), "s": batch.column("same").take(at), "g": gram, "c1": np.ascontiguousarray(c[:, 0]), "c2": np.ascontiguousarray(c[:, 1]), "f": first.astype(np.int32), "l": last.astype(np.int32)}, _ENTRY_SCHEMA)

    return rows.mapInArrow(run, _ENTRIES)


class SuffixFamily:
    """Levels of suffix arrays that grow by batches; `whole` and `grams` gather the matches found so far.

    `save` keeps the levels in a folder; `load` goes on with them, so that a later batch meets all earlier ones.
    """

    def __init__(self, store: Scratch):
        self.store, self.turn = store, 0
        #: Size in batches, array and the name of its table, the largest level first.
        self.levels: list[tuple[int, DataFrame, str]] = []
        self.whole: list[DataFrame] = []
        self.grams: list[DataFrame] = []

    def add(self, batch: DataFrame) -> None:
        """Sorts the suffixes of a batch into an array, scans it against the levels, and merges levels of equal size."""
        self.turn += 1
        put, turn = self.store.put, self.turn
        array = batch.groupBy("gram", "c1", "c2").agg(F.count("*").alias("n"))
        array = put(array.sortWithinPartitions("gram", "c1", "c2"), f"array{turn}")
        scan = array.withColumn("new", F.lit(1))
        for _, level, _ in self.levels:
            scan = scan.unionByName(level.withColumn("new", F.lit(0)))
        if self.levels:
            scan = put(scan.groupBy("gram", "c1", "c2").agg(F.sum("n").alias("n"), F.max("new").alias("new")).sortWithinPartitions("gram", "c1", "c2"), f"scan{turn}")
        self.whole.append(put(scan.where("n > 1 and new = 1").select("gram", "c1", "c2"), f"whole{turn}"))
        met = scan.groupBy("gram").agg(F.count("*").alias("contexts"), F.max("new").alias("new")).where("contexts > 1 and new = 1")
        self.grams.append(put(met.select("gram", "contexts"), f"grams{turn}"))
        joined, size, name, gone = array, 1, f"array{turn}", []
        while self.levels and self.levels[-1][0] == size:
            _, level, old = self.levels.pop()
            joined, size, gone = joined.unionByName(level), size * 2, [*gone, old]
        if gone and not self.levels:  # the scan is the merge of all levels
            joined, name, gone = scan.drop("new"), f"scan{turn}", [*gone, name]
        else:
            if gone:
                joined = put(joined.groupBy("gram", "c1", "c2").agg(F.sum("n").alias("n")).sortWithinPartitions("gram", "c1", "c2"), f"level{turn}")
                name, gone = f"level{turn}", [*gone, name]
            gone += [f"scan{turn}"]
        self.levels.append((size, joined, name))
        self.store.drop(*gone)

    def save(self, path: str) -> None:
        """Writes the levels as tables whose names are their places and sizes."""
        for k, (size, level, _) in enumerate(self.levels):
            level.write.mode("overwrite").parquet(f"{path}/levels/place={k}/size={size}")

    def load(self, path: str) -> None:
        """Takes the levels that `save` wrote."""
        known = self.store.spark.read.parquet(f"{path}/levels")
        for r in known.select("place", "size").distinct().orderBy("place").collect():  # one row for each level
            level = self.store.put(known.where(f"place = {r['place']}").drop("place", "size").sortWithinPartitions("gram", "c1", "c2"), f"kept{r['place']}")
            self.levels.append((r["size"], level, f"kept{r['place']}"))

    def matches(self) -> tuple[DataFrame, DataFrame]:
        """Contexts that occur more than once, and grams with more than one context."""
        whole, grams = self.whole[0], self.grams[0]
        for x in self.whole[1:]:
            whole = whole.unionByName(x)
        for x in self.grams[1:]:
            grams = grams.unionByName(x)
        return whole.distinct(), grams.groupBy("gram").agg(F.max("contexts").alias("contexts"))


_CONTEXTS = "gram long, many boolean, doc_id long, same long, first int, alone boolean, context binary"
_CONTEXT_SCHEMA = pa.schema([("gram", pa.int64()), ("many", pa.bool_()), ("doc_id", pa.int64()), ("same", pa.int64()), ("first", pa.int32()), ("alone", pa.bool_()), ("context", pa.binary())])
_SPANS = "doc_id long, same long, start int, end int"
_SPAN_SCHEMA = pa.schema([("doc_id", pa.int64()), ("same", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def _contexts(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the contexts wanted: columns doc_id, same, gram, many, first, last, alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            cols: list[list] = [[] for _ in _CONTEXT_SCHEMA]
            for doc_id, same, text, asked in zip(batch.column("doc_id").to_pylist(), batch.column("same").to_pylist(), raw(batch), batch.column("asked").to_pylist(), strict=True):
                for x in asked:
                    for col, value in zip(cols, (x["gram"], x["many"], doc_id, same, x["first"], x["alone"], text[x["first"] : x["last"] + length]), strict=True):
                        col.append(value)
            yield out(dict(enumerate(cols)), _CONTEXT_SCHEMA)

    asked = wanted.groupBy("doc_id", "same").agg(F.collect_list(F.struct("gram", "many", "first", "last", "alone")).alias("asked")).withColumnsRenamed({"doc_id": "want_doc", "same": "want_same"})
    once = rows.join(asked, rows["doc_id"].eqNullSafe(asked["want_doc"]) & (rows["same"] == asked["want_same"]))
    return once.select("doc_id", "same", "text", "asked").mapInArrow(run, _CONTEXTS)


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _compared(contexts: DataFrame, length: int) -> DataFrame:
    """Spans of the strings that occur in two contexts of a gram; all contexts of a gram come to one task, one after another."""

    def found(rows: list[tuple]) -> pa.RecordBatch:
        bodies = [r[5] for r in rows]
        flat = np.frombuffer(b"".join(bodies), np.uint8)
        sizes = np.array([len(b) for b in bodies])
        begins = np.cumsum(sizes) - sizes
        strings = sizes - length + 1
        owner = np.repeat(np.arange(len(rows)), strings)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings)
        at = begins[owner] + inside
        gram = np.array([r[0] for r in rows], np.int64).view(np.uint64)
        code = rolling(flat, length)[at] ^ (gram[owner] * np.uint64(0xC2B2AE3D27D4EB4F))
        order = np.argsort(code, kind="stable")
        ranked = code[order]
        equal = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(code), bool)
        a, b = order[:-1][equal], order[1:][equal]
        # the hash only proposes: bytes are compared
        step = 1 << 14
        true = np.concatenate([(flat[at[a[i : i + step], None] + np.arange(length)] == flat[at[b[i : i + step], None] + np.arange(length)]).all(1) for i in range(0, len(a), step)]) if len(a) else np.zeros(0, bool)
        twice[a[true]] = twice[b[true]] = True
        alone = np.array([r[4] for r in rows])
        twice &= alone[owner]
        # consecutive strings of a context make one span
        mark = np.zeros(len(flat) + 1, bool)
        mark[at[twice]] = True
        lo, hi = _runs(mark[:-1])
        row = np.searchsorted(begins, lo, "right") - 1
        start = np.array([r[3] for r in rows])[row] + lo - begins[row]
        return out({"d": [rows[i][1] for i in row.tolist()], "s": [rows[i][2] for i in row.tolist()], "start": start.astype(np.int32), "end": (start + hi - lo - 1 + length).astype(np.int32)}, _SPAN_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in sliced(batches, "context", 2 << 20):
            for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "doc_id", "same", "first", "alone", "context")), strict=True):
                if size > 2 << 20 and row[0] != held[-1][0]:
                    yield found(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield found(held)

    return contexts.repartition("gram").sortWithinPartitions("gram").select("gram", "doc_id", "same", "first", "alone", "context").mapInArrow(run, _SPANS)


def _by_digest(contexts: DataFrame, length: int) -> DataFrame:
    """The same for grams with very many contexts: each string's digest is a row, counted like words."""
    schema = pa.schema([("doc_id", pa.int64()), ("same", pa.int64()), ("start", pa.int32()), ("alone", pa.bool_()), ("d1", pa.int64()), ("d2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "context", 1 << 18):
            bodies, first = raw(batch, "context"), batch.column("first").to_pylist()
            counts = [len(b) - length + 1 for b in bodies]
            d = _digests(b[i : i + length] for b, n in zip(bodies, counts, strict=True) for i in range(n))
            at = pa.array(np.repeat(np.arange(len(bodies)), counts))
            start = np.concatenate([np.arange(n) + f for n, f in zip(counts, first, strict=True)]).astype(np.int32)
            yield out({"doc": batch.column("doc_id").take(at), "same": batch.column("same").take(at), "start": start, "alone": batch.column("alone").take(at), "d1": np.ascontiguousarray(d[:, 0]), "d2": np.ascontiguousarray(d[:, 1])}, schema)

    store = Scratch(contexts.sparkSession, "suffix-dedup-strings")
    strings = store.put(contexts.mapInArrow(run, "doc_id long, same long, start int, alone boolean, d1 long, d2 long"), "strings")
    twice = store.put(strings.groupBy("d1", "d2").agg(F.count("*").alias("n")).where("n > 1").select("d1", "d2"), "twice")
    return strings.where("alone").join(twice, ["d1", "d2"]).select("doc_id", "same", "start", (F.col("start") + length).alias("end"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES, together: int = TOGETHER) -> DataFrame:
    """doc_id, same (the text's hash), start and end of spans of repeated bytes; spans may overlap."""
    store = Scratch(docs.sparkSession, "suffix-dedup")
    rows = keyed(docs).withColumn("same", F.xxhash64("text"))
    entries = store.put(suffixes(rows, length).withColumn("batch", F.pmod(F.hash("doc_id", "same"), F.lit(batches))), "suffixes", partition="batch")
    family = SuffixFamily(store)
    for k in range(batches):
        family.add(entries.where(F.col("batch") == k).drop("batch"))
    whole, grams = family.matches()
    whole, grams = store.put(whole, "whole"), store.put(grams, "grams")
    store.drop(*(f"{name}{k + 1}" for k in range(batches) for name in ("whole", "grams")), *(name for *_, name in family.levels))
    matched = entries.drop("batch").join(grams, "gram", "left").join(whole.withColumn("again", F.lit(True)), ["gram", "c1", "c2"], "left").where("contexts is not null or again")
    matched = store.put(matched, "matched")
    store.drop("suffixes")
    spans = matched.where("again").select("doc_id", "same", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
    one = matched.where("contexts is not null").groupBy("gram", "c1", "c2").agg(F.min(F.struct("doc_id", "same", "first", "last")).alias("at"), F.first("again").isNull().alias("alone"), (F.first("contexts") > together).alias("many"))
    wanted = store.put(one.select("at.*", "gram", "many", "alone"), "wanted")
    contexts = store.put(_contexts(rows, wanted, length), "contexts")
    spans = spans.unionByName(_compared(contexts.where("not many"), length))
    if contexts.where("many").limit(1).count():
        spans = spans.unionByName(_by_digest(contexts.where("many"), length))
    spans = store.put(spans, "spans")
    store.drop("matched", "wanted", "contexts", "whole", "grams")
    return spans


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
_RESULT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def without_repeats(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES, keep: bool = True, together: int = TOGETHER) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes (null unless keep) of every row."""
    spans = repeated_spans(docs, length, batches, together)
    cuts = spans.groupBy("doc_id", "same").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")).withColumnsRenamed({"doc_id": "cut_doc", "same": "cut_same"})
    rows = keyed(docs).withColumn("same", F.xxhash64("text"))

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches_):
            cols: list[list] = [[] for _ in _RESULT_SCHEMA]
            for doc_id, text, found in zip(batch.column("doc_id").to_pylist(), raw(batch), batch.column("spans").to_pylist(), strict=True):
                kept, at, removed, n = [], 0, 0, 0
                for x in found or ():
                    a, b = x["start"], x["end"]
                    if a > at or n == 0:
                        kept.append(text[at:a])
                        n += 1
                        removed += b - a
                    else:
                        removed += max(0, b - at)
                    at = max(at, b)
                kept.append(text[at:])
                body = b"".join(kept)
                for col, value in zip(cols, (doc_id, len(text), removed, n, hashlib.sha256(body).hexdigest(), body if keep else None), strict=True):
                    col.append(value)
            yield out(dict(enumerate(cols)), _RESULT_SCHEMA)

    joined = rows.join(cuts, rows["doc_id"].eqNullSafe(cuts["cut_doc"]) & (rows["same"] == cuts["cut_same"]), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(run, _RESULT)
