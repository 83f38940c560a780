"""Line dedup by pairwise alignment.

A line is deleted from a document if any earlier document's alignment with it has the line in a common block of at least
`min_chars` characters. Two documents are aligned by patience diff: lines unique in both are anchors, their longest increasing
run is kept, blocks grow from the anchors over equal neighbours, and the gaps between are aligned in the same way.

Which pairs are aligned. A line of a long enough block is in a window of that block: consecutive lines of `min_chars`
characters or more, that begin or end at some line and are no longer than that takes. So only documents that share a window
are compared. Documents of equal lines are one class: the first stands for them, and the others lose all lines. For each
window the classes that hold it are put in order, and each is aligned with the one before it. Classes that still have lines
left in the window then go on with the earlier holders, in rounds that reach `STEP` times as far, until all the window's lines
are deleted or all its earlier holders were tried. No holder is left out; deleted lines only save alignments that could not
delete more of the window.

Documents are in the order of doc_id (null first), then of the text's hash. Lines are what is between line feeds, without
white space at either end; empty lines never match by themselves, but go with a block that they stand in. Alignment is
judged on the input: what an earlier document lost itself still counts.

Null texts count as empty; very long texts are aligned whole. Rows that share doc_id and text are one document here, and get the same result. Extra columns
are ignored (`deduplicated` keeps them); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, keyed, out, raw, sliced, texts
from .suffix_dedup import _powers

MIN_CHARS = 40
#: How many times as far as the one before each round of alignments reaches among a window's earlier holders.
STEP = 5

_EMPTY = np.uint64(0x9E3779B97F4A7C15)


def line_codes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each line, 0 for empty ones, and its length."""
    lines = [x.strip() for x in text.split(b"\n")]
    return np.array([xxhash.xxh64_intdigest(x) | 1 if x else 0 for x in lines], np.uint64), np.array([len(x) for x in lines], np.int32)


def rising(values: list[int]) -> list[int]:
    """Places of a longest increasing run of distinct values."""
    tops, ends, back = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k == len(tops):
            tops.append(v)
            ends.append(i)
        else:
            tops[k], ends[k] = v, i
        back.append(ends[k - 1] if k else -1)
    found, i = [], ends[-1] if ends else -1
    while i >= 0:
        found.append(i)
        i = back[i]
    return found[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Common blocks (start in a, start in b, lines) of the patience alignment, in order."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            pairs.append((m, n))
        if i >= m or j >= n:
            continue
        in_a, in_b = Counter(a[i:m]), Counter(b[j:n])
        place = {x: k for k, x in enumerate(a[i:m], i) if x and in_a[x] == 1 and in_b.get(x) == 1}
        met = [(place[x], k) for k, x in enumerate(b[j:n], j) if x in place]
        if not met:
            continue
        kept = [met[k] for k in rising([x for x, _ in met])]
        pairs += kept
        for (p, q), (s, t) in zip([(i - 1, j - 1), *kept], [*kept, (m, n)], strict=True):
            if s > p + 1 and t > q + 1:
                todo.append((p + 1, s, q + 1, t))
    blocks: list[tuple[int, int, int]] = []
    for p, q in sorted(pairs):
        if blocks and (p, q) == (blocks[-1][0] + blocks[-1][2], blocks[-1][1] + blocks[-1][2]):
            blocks[-1] = (*blocks[-1][:2], blocks[-1][2] + 1)
        else:
            blocks.append((p, q, 1))
    return blocks


def windows(codes: np.ndarray, sizes: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash, first line and end of the shortest windows of `min_chars` characters that begin or end at each line."""
    n = len(codes)
    sums = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    end = np.searchsorted(sums, sums[:-1] + min_chars, "left")
    first = np.searchsorted(sums, sums[1:] - min_chars, "right") - 1
    first, end = np.concatenate([np.arange(n)[end <= n], first[first >= 0]]), np.concatenate([end[end <= n], np.arange(1, n + 1)[first >= 0]])
    up, down = _powers(n + 1)
    marks = np.concatenate([[np.uint64(0)], np.cumsum((codes + _EMPTY) * up[:n], dtype=np.uint64)])
    return (marks[end] - marks[first]) * down[first], first, end


_LINES = pa.schema([("doc_id", pa.int64()), ("same", pa.int64()), ("digest", pa.binary()), ("codes", pa.binary()), ("sizes", pa.binary()), ("own", pa.list_(pa.int64()))])
_LINES_SQL = "doc_id long, same long, digest binary, codes binary, sizes binary, own array<long>"
_SEATS = pa.schema([("code", pa.int64()), ("cid", pa.int64()), ("part", pa.int32()), ("seat", pa.int64()), ("begin", pa.int64())])
_OPEN = pa.schema([("cid", pa.int64()), ("code", pa.int64())])


def _lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            cols: list[list] = [[], [], [], []]
            for text in raw(batch):
                codes, sizes = line_codes(text)
                digest = hashlib.blake2b(codes.tobytes(), digest_size=16).digest()
                for col, value in zip(cols, (digest, codes.tobytes(), sizes.tobytes(), np.unique(windows(codes, sizes, min_chars)[0]).view(np.int64)), strict=True):
                    col.append(value)
            yield out({"d": batch.column("doc_id"), "s": batch.column("same"), "h": cols[0], "c": cols[1], "z": cols[2], "o": cols[3]}, _LINES)

    return run


def _seated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of a sorted part with its seat in the part, and the seat at which its window's rows begin there."""
    part, seat, last, begin = TaskContext.get().partitionId(), 0, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column("code").to_numpy()
        seats = np.arange(seat, seat + len(codes))
        heads = np.concatenate([[last is None or codes[0] != last], codes[1:] != codes[:-1]])
        begins = np.maximum.accumulate(np.where(heads, seats, begin))
        seat, last, begin = seat + len(codes), codes[-1], begins[-1]
        yield out({"c": batch.column("code"), "i": batch.column("cid"), "p": np.full(len(codes), part, np.int32), "s": seats, "b": begins}, _SEATS)


def _holders(classes: DataFrame, store: Scratch) -> DataFrame:
    """code (of a window), cid (of a class that holds it), at (its place among all rows) and start (the window's first place)."""
    seats = classes.select("cid", F.explode("own").alias("code")).repartitionByRange("code", "cid").sortWithinPartitions("code", "cid")
    seats = store.put(seats.mapInArrow(_seated, "code long, cid long, part int, seat long, begin long"), "seats")
    ends = seats.groupBy("part").agg(F.count("*").alias("n"), F.min("code").alias("low"), F.max(F.struct("code", "begin")).alias("top"))
    parts, offset, last, start = [], 0, None, 0
    for r in sorted(ends.collect(), key=lambda r: r["part"]):  # one row of each part
        head = start if r["low"] == last else offset
        parts.append((r["part"], offset, r["low"], head))
        start = head if r["top"]["code"] == r["low"] else offset + r["top"]["begin"]
        last, offset = r["top"]["code"], offset + r["n"]
    moved = seats.join(F.broadcast(seats.sparkSession.createDataFrame(parts, "part int, offset long, low long, head long")), "part")
    return store.put(moved.select("code", "cid", F.expr("offset + seat as at"), F.expr("if(code = low, head, offset + begin) as start")), "holders")


def _open(min_chars: int):
    """The windows of which a class has lines left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "codes"):
            rows: list[tuple] = []
            for cid, x, z, spans in zip(*(batch.column(c).to_pylist() for c in ("cid", "codes", "sizes", "spans")), strict=True):
                codes = np.frombuffer(x, np.uint64)
                left = np.ones(len(codes), np.int64)
                for s in spans or ():
                    left[s["start"] : s["end"]] = 0
                sums = np.concatenate([[0], np.cumsum(left)])
                names, first, end = windows(codes, np.frombuffer(z, np.int32), min_chars)
                rows += [(cid, name) for name in np.unique(names[sums[end] > sums[first]]).view(np.int64).tolist()]
            yield out(dict(enumerate(zip(*rows, strict=True) if rows else [[]] * 2)), _OPEN)

    return run


def _cuts(min_chars: int):
    schema = pa.schema([("cid", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "codes_b"):
            rows: list[tuple] = []
            for cid, x, y, z in zip(*(batch.column(c).to_pylist() for c in ("cid", "codes_a", "codes_b", "sizes_b")), strict=True):
                sizes = np.frombuffer(z, np.int32)
                for _, q, n in patience(np.frombuffer(x, np.uint64).tolist(), np.frombuffer(y, np.uint64).tolist()):
                    if sizes[q : q + n].sum() >= min_chars:
                        rows.append((cid, q, q + n))
            yield out(dict(enumerate(zip(*rows, strict=True) if rows else [[]] * 3)), schema)

    return run


def _spans(cuts: DataFrame) -> DataFrame:
    return cuts.groupBy("cid").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))


def cut_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """cut_doc, cut_same (the text's hash) and spans (start and end lines to delete) of the documents that lose lines."""
    store = Scratch(docs.sparkSession, "line-dedup")
    rows = keyed(docs).withColumn("same", F.xxhash64("text"))
    lines = store.put(rows.mapInArrow(_lines(min_chars), _LINES_SQL).where("size(own) > 0"), "lines")
    first = lines.groupBy("digest").agg(F.min(F.struct("doc_id", "same", "codes", "sizes", "own")).alias("x")).select("x.*")
    order = [F.col("doc_id").asc_nulls_first(), F.col("same").asc()]
    classes = store.put(first.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("cid", F.monotonically_increasing_id()), "classes")
    holders = _holders(classes, store)
    codes = classes.select("cid", "codes", "sizes")
    earlier = codes.select(F.col("cid").alias("before"), F.col("codes").alias("codes_a"))
    place = holders.select(F.col("at").alias("there"), F.col("cid").alias("before"))
    open_, cuts, done, reach, turn = holders.where("at > start"), None, 0, 1, 0
    while True:
        tried = open_.select("cid", F.explode(F.expr(f"sequence(at - {done + 1}L, greatest(at - {reach}L, start), -1L)")).alias("there"))
        pairs = store.put(tried.join(place, "there").select("cid", "before").distinct(), f"pairs{turn}")
        both = pairs.join(codes.withColumnsRenamed({"codes": "codes_b", "sizes": "sizes_b"}), "cid").join(earlier, "before")
        found = store.put(both.select("cid", "codes_a", "codes_b", "sizes_b").mapInArrow(_cuts(min_chars), "cid long, start int, end int").distinct(), f"cuts{turn}")
        cuts = found if cuts is None else cuts.unionByName(found)
        further = open_.where(f"at - {reach} > start")
        judged = codes.join(further.select("cid").distinct(), "cid").join(_spans(cuts), "cid", "left")
        left = judged.mapInArrow(_open(min_chars), "cid long, code long")
        open_ = store.put(further.join(left, ["cid", "code"], "left_semi"), f"open{turn}")
        store.drop(f"pairs{turn}", f"open{turn - 1}")
        if open_.isEmpty():
            break
        done, reach, turn = reach, reach * STEP, turn + 1
    cuts = store.put(_spans(cuts).join(classes.select("cid", "doc_id", "same"), "cid").select(F.col("doc_id").alias("cut_doc"), F.col("same").alias("cut_same"), "spans"), "spans")
    # documents with the lines of an earlier one; their doc_id and hash are no class's
    members = lines.select(F.col("doc_id").alias("cut_doc"), F.col("same").alias("cut_same"), F.expr("cast(length(sizes) / 4 as int)").alias("n")).distinct()
    reps = classes.select("doc_id", "same")
    copies = members.join(reps, F.col("cut_doc").eqNullSafe(F.col("doc_id")) & (F.col("cut_same") == F.col("same")), "left_anti")
    copies = store.put(copies.select("cut_doc", "cut_same", F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("end"))).alias("spans")), "copies")
    store.drop("lines", "classes", "seats", "holders", f"open{turn}", *(f"cuts{k}" for k in range(turn + 1)))
    return cuts.unionByName(copies)


def _rest(text: str, spans: list) -> tuple[str, int, int]:
    """What is left of a text, its lines, and the lines deleted."""
    lines = text.split("\n")
    gone = np.zeros(len(lines), bool)
    for x in spans or ():
        gone[x["start"] : x["end"]] = True
    if not gone.any():
        return text, len(lines), 0
    return "\n".join(x for x, g in zip(lines, gone.tolist(), strict=True) if not g), len(lines), int(gone.sum())


def line_report(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 and text (what is left) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            done = [_rest(t, s) for t, s in zip(texts(batch), batch.column("spans").to_pylist(), strict=True)]
            yield out({"d": batch.column("doc_id"), "n": [x[1] for x in done], "r": [x[2] for x in done], "h": [hashlib.sha256(x[0].encode()).hexdigest() for x in done], "t": [x[0] for x in done]}, schema)

    cuts = cut_lines(docs, min_chars)
    rows = keyed(docs).withColumn("same", F.xxhash64("text"))
    joined = rows.join(cuts, rows["doc_id"].eqNullSafe(cuts["cut_doc"]) & (rows["same"] == cuts["cut_same"]), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_lines long, n_removed long, kept_sha256 string, text string")


def deduplicated(docs: DataFrame, min_chars: int = MIN_CHARS, emptied: bool = True) -> DataFrame:
    """docs, all columns as they are, but text without the deleted lines (null stays null).

    Without `emptied` the rows that lose all of their text go; those that had none stay.
    """
    cuts = cut_lines(docs, min_chars)
    same = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    joined = docs.join(cuts, docs["doc_id"].cast("long").eqNullSafe(cuts["cut_doc"]) & (same == cuts["cut_same"]), "left")
    lines = F.split(docs["text"], "\n", -1)
    left = F.array_join(F.filter(lines, lambda _, i: ~F.exists(cuts["spans"], lambda s: (s["start"] <= i) & (i < s["end"]))), "\n")
    if not emptied:
        joined = joined.where(cuts["spans"].isNull() | left.rlike(r"\S"))
    return joined.select(*[F.when(cuts["spans"].isNull(), docs["text"]).otherwise(left).alias("text") if c == "text" else docs[c] for c in docs.columns])
