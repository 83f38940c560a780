"""Near duplicates by a grouped prefix join on word shingles, exact at the given similarity.

Words are the runs of characters other than ASCII white space, ASCII letters lowered. A document's set holds its distinct
shingles of `words` words; with fewer words, the whole sequence as one shingle; without words it is empty and linked
with nothing. Two documents link when 100 * intersection >= percent * union.

1. Documents with equal sets are one class; only classes are compared.
2. Shingles are put in one order: by hash, those frequent in the corpus last. Linked sets share a shingle among the first
   n - ceil(t n) + 1 of each (its prefix). Any order gives the same links; the frequent ones go last to save work only.
3. Classes of equal size and prefix are one group, represented by its first class. Only prefix shingles that several groups
   hold matter; they make the posting lists.
4. Stars: in each list the group with the largest share of shared shingles in its prefix is the hub, since the text that
   copies were made from has none of its own. A group is tried against the hub that agrees with it most, if so many prefix
   shingles agree that a link is possible, and each group's members against its first; the links make components.
5. Lists that still hold more than one component give the pairs of groups with members in different components that three
   exact filters leave. Group pairs are expanded to the classes in different components, which are verified on whole sets.
   Pairs inside a component cannot change it, so none is made here.
6. If links are counted, the lists are joined once more, now for all pairs of classes inside the same component that the
   filters leave (a link lies in one component). Blocks of `BLOCK` classes are brought together, each class once for each
   other block that it has pairs in, and every pair is verified on whole sets.

The filters lose no link. Position: if a list's shingle is the first that two sets share, no shingle before it in either is
shared, so what follows must suffice. Earlier: a pair is left out of a list if one of the last few listed shingles before the
list's is shared too, since then the list of an earlier one gives it. Bitmap: a set's shingles mark bits of a bitmap, and each
bit that only one of two sets has stands for at least one shingle that the other lacks, which bounds their intersection.
Before whole sets are brought together, the same is done with bitmaps that grow with the sets.

For the components a group of thousands of near copies thus costs one pair for each member, not one for each two, and no list
is cut short. Its links are as many as its pairs, so counting them costs one verification for each two members.

Null texts count as empty. Very long texts are shingled whole, in pieces. Rows with the same doc_id are rows of their own; a
null doc_id is never a component's id unless all its rows have none. Extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, keyed, out, raw, sliced
from .components import components

WORDS = 5
PERCENT = 75
#: Shingles that a task counts at a time, how often one must come up there to be counted, how often in all to be frequent,
#: and how many are shared at most.
COUNTED, OFTEN, FREQUENT, SHARED = 3_000_000, 3, 30, 1_000_000
#: Longs of a set's bitmap.
BITMAP = 16
#: Groups of a list up to which bitmaps are left to the narrowing of pairs: they would weigh more than the pairs.
SHORT = 4
#: Listed shingles before a list's that are looked at for an earlier one that two sets share.
EARLIER = 4
#: Keys of documents to fetch that are broadcast at most: 16 bytes each.
FETCH_BROADCAST = 250_000
#: Classes of a component, by order, that meet another such block in one task when links are counted.
BLOCK = 128

#: Bytes in which words are hashed at a time; longer words than `LONG` are hashed one by one.
PIECE, LONG = 1 << 18, 1 << 12

_MULTIPLIERS = np.random.default_rng(11).integers(1, 2**63, 64, np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x9E3779B97F4A7C55
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64) + np.uint64(1)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_RUN = re.compile(rb"[^\x20\x09-\x0D]+")


def _powers(base: int) -> np.ndarray:
    found = np.full(PIECE + LONG + 2, base, np.uint64)
    found[0] = 1
    return np.cumprod(found, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def word_codes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash and the first byte of each word: a polynomial of its lowered bytes, from running sums over a piece."""
    data = np.frombuffer(blob, np.uint8)
    codes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for at in range(0, len(data), PIECE):  # the words that begin in this piece
        part = data[at : at + PIECE + LONG + 1]
        inner = ~_SPACE[part]
        begins, stops = inner.copy(), inner.copy()
        begins[1:] &= ~inner[:-1]
        begins[0] &= not at or _SPACE[data[at - 1]]
        stops[:-1] &= ~inner[1:]
        stops[-1] &= at + len(part) == len(data)
        starts, stops = np.flatnonzero(begins[:PIECE]), np.flatnonzero(stops) + 1
        if not len(starts):
            continue
        k = np.searchsorted(stops, starts, "right")
        ends = np.append(stops, PIECE * 2)[k]
        long = ends - starts > LONG
        ends[long] = starts[long]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_LOWER[part] * _UP[: len(part)], out=sums[1:])
        found = (sums[ends] - sums[starts]) * _DOWN[starts]
        for i in np.flatnonzero(long).tolist():
            found[i] = xxhash.xxh64_intdigest(_RUN.match(blob, at + int(starts[i]))[0].lower())
        found ^= found >> np.uint64(32)
        found *= _MIX
        codes.append(found ^ (found >> np.uint64(29)))
        places.append(starts + at)
    return np.concatenate(codes), np.concatenate(places)


def _summed(codes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` words."""
    n = len(codes) - size + 1
    total = np.full(n, size, np.uint64)
    for j in range(size):
        total += codes[j : j + n] * _MULTIPLIERS[j]
    total ^= total >> np.uint64(31)
    total *= _MIX
    total ^= total >> np.uint64(29)
    return total


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles."""
    codes, places = word_codes(b"\n".join(texts))
    cuts = np.searchsorted(places, np.cumsum([0, *(len(t) + 1 for t in texts)])).tolist()
    whole = _summed(codes, words) if len(codes) >= words else None
    sets = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        total = np.sort(whole[a : b - words + 1]) if b - a >= words else _summed(codes[a:b], b - a) if b > a else codes[:0]
        fresh = np.ones(len(total), bool)
        np.not_equal(total[1:], total[:-1], out=fresh[1:])
        sets.append(total[fresh])
    return sets


def _shingled(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches of few bytes with their texts' sets."""
    for batch in sliced(batches, limit=PIECE):
        yield batch, shingle_sets(raw(batch), words)


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def bitmap(codes: np.ndarray) -> np.ndarray:
    """The longs whose bits the hashes mark."""
    marks = np.zeros(64 * BITMAP, bool)
    marks[codes % np.uint64(64 * BITMAP)] = True
    return np.packbits(marks).view(np.int64)


def wide_bitmap(codes: np.ndarray) -> bytes:
    """A bitmap of four bits or more for each hash, a power of two of them in all, by the hash's low bits."""
    size = 1 << max(10, (4 * len(codes) - 1).bit_length())
    marks = np.zeros(size, bool)
    marks[codes & np.uint64(size - 1)] = True
    return np.packbits(marks).tobytes()


def may_link(x: bytes, y: bytes, n: int, m: int, percent: int) -> bool:
    """Whether two sets of n and m shingles can link by their wide bitmaps; the longer one is folded to the other's length."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(p), len(q))
    p, q = (np.bitwise_or.reduce(b.reshape(-1, size), axis=0) if len(b) > size else b for b in (p, q))
    common = min(n - int(np.bitwise_count(p & ~q).sum()), m - int(np.bitwise_count(q & ~p).sum()))
    return 100 * common >= percent * (n + m - common)


def _digests(parts: list[np.ndarray]) -> list[bytes]:
    return [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in parts]


_SEEN = pa.schema([("doc_id", pa.int64()), ("same", pa.int64()), ("n", pa.int32()), ("digest", pa.binary()), ("h", pa.int64()), ("times", pa.int64())])
_SEEN_SQL = "doc_id long, same long, n int, digest binary, h long, times long"


def _seen(rows: DataFrame, words: int) -> DataFrame:
    """doc_id, same, n and digest (of the set) of every row, and h and times of shingles that come up often in a task's stretch."""

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        flat = np.sort(np.concatenate(parts))
        heads = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        n = np.diff(np.append(heads, len(flat)))
        found = pa.array(flat[heads][n >= OFTEN].view(np.int64))
        return out({c: pa.nulls(len(found), _SEEN.field(c).type) for c in _SEEN.names[:4]} | {"h": found, "times": n[n >= OFTEN]}, _SEEN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch, sets in _shingled(batches, words):
            none = pa.nulls(len(sets), pa.int64())
            yield out({"d": batch.column("doc_id"), "s": batch.column("same"), "n": [len(x) for x in sets], "i": _digests(sets), "h": none, "t": none}, _SEEN)
            parts += [s for s in sets if len(s)]
            held += sum(map(len, sets))
            if held > COUNTED:
                yield counted(parts)
                parts, held = [], 0
        if parts:
            yield counted(parts)

    return rows.mapInArrow(run, _SEEN_SQL)


def _frequent(seen: DataFrame) -> np.ndarray:
    """Shingles that come up often within some task's stretch of documents, the most frequent first to be shared."""
    top = seen.where("h is not null").groupBy("h").agg(F.sum("times").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "h").limit(SHARED).select("h")
    return np.sort(np.array([r[0] for r in top.toLocalIterator()], np.int64).view(np.uint64))


_SKETCH = pa.schema([("doc_id", pa.int64()), ("same", pa.int64()), ("n", pa.int32()), ("digest", pa.binary()), ("alike", pa.binary()), ("bits", pa.list_(pa.int64())), ("wide", pa.binary()), ("prefix", pa.list_(pa.int64()))])
_SKETCH_SQL = "doc_id long, same long, n int, digest binary, alike binary, bits array<long>, wide binary, prefix array<long>"


def _sketches(rows: DataFrame, frequent: np.ndarray, words: int, percent: int) -> DataFrame:
    """doc_id, same, n, digest (of the set), alike (of size and prefix), bits and wide (its bitmaps) and prefix of every row."""
    often = rows.sparkSession.sparkContext.broadcast(frequent)

    def first(codes: np.ndarray, common: np.ndarray) -> np.ndarray:
        if len(common):
            late = common[np.minimum(np.searchsorted(common, codes), len(common) - 1)] == codes
            codes = np.concatenate([codes[~late], codes[late]])
        return codes[: prefix_size(len(codes), percent)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = often.value
        for batch, sets in _shingled(batches, words):
            prefixes = [first(codes, common) for codes in sets]
            cuts = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(prefixes).view(np.int64)))
            maps = pa.ListArray.from_arrays(pa.array(np.arange(0, BITMAP * len(sets) + 1, BITMAP, np.int32)), pa.array(np.concatenate([bitmap(x) for x in sets])))
            yield out({"d": batch.column("doc_id"), "s": batch.column("same"), "n": [len(x) for x in sets], "i": _digests(sets), "a": _digests(prefixes), "b": maps, "w": [wide_bitmap(x) for x in sets], "p": lists}, _SKETCH)

    return rows.mapInArrow(run, _SKETCH_SQL)


def _fetched(rows: DataFrame, classes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """cid and whole set of the classes wanted (column cid), from the text of one of their documents."""
    schema = pa.schema([("cid", pa.int64()), ("codes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _shingled(batches, words):
            yield out({"cid": batch.column("cid"), "codes": [x.tobytes() for x in sets]}, schema)

    keys = classes.join(wanted, "cid", "left_semi").select("cid", F.col("rep.doc_id").alias("rep_doc"), F.col("rep.same").alias("rep_same"))
    if wanted.count() <= FETCH_BROADCAST:
        keys = F.broadcast(keys)
    found = rows.join(keys, rows["doc_id"].eqNullSafe(keys["rep_doc"]) & (rows["same"] == keys["rep_same"]))
    return found.select("cid", "text").mapInArrow(run, "cid long, codes binary").dropDuplicates(["cid"])


def _narrowed(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b that wide bitmaps leave, which are a fraction of the whole sets' size."""
    left = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "x"):
            keep = [may_link(x, y, n, m, percent) for x, y, n, m in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "n", "m")), strict=True)]
            yield out({"a": batch.column("a"), "b": batch.column("b")}, left).filter(pa.array(keep, pa.bool_()))

    marks = classes.select("cid", "n", "wide")
    both = pairs.join(marks.toDF("a", "n", "x"), "a").join(marks.toDF("b", "m", "y"), "b")
    return both.select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long")


def _common(p: np.ndarray, q: np.ndarray) -> int:
    both = np.concatenate([p, q])
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose whole sets link."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(x: bytes, y: bytes) -> bool:
        p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        common = _common(p, q)
        return 100 * common >= percent * (len(p) + len(q) - common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "x"):
            keep = [links(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield out({"a": batch.column("a"), "b": batch.column("b")}, schema).filter(pa.array(keep, pa.bool_()))

    first = pairs.join(sets.select(F.col("cid").alias("a"), F.col("codes").alias("x")), "a")
    return first.join(sets.select(F.col("cid").alias("b"), F.col("codes").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _linked(rows: DataFrame, classes: DataFrame, pairs: DataFrame, store: Scratch, name: str, words: int, percent: int) -> DataFrame:
    """The table of the pairs a, b whose whole sets link; the sets are kept only until it is written."""
    near = store.put(_narrowed(pairs, classes, percent), f"near-{name}")
    if near.isEmpty():
        return near
    wanted = store.put(near.select(F.col("a").alias("cid")).unionByName(near.select(F.col("b").alias("cid"))).distinct(), f"wanted-{name}")
    sets = store.put(_fetched(rows, classes, wanted, words), f"sets-{name}")
    found = store.put(_verified(near, sets, percent), name)
    store.drop(f"wanted-{name}", f"sets-{name}", f"near-{name}")
    return found


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a sorted part whose token comes up again; those of its first and last token always, for the parts beside."""
    held, first, again = None, None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        tokens = batch.column("token").to_numpy()
        first = tokens[0] if first is None else first
        same = tokens[1:] == tokens[:-1]
        keep = np.concatenate([[again or tokens[0] == first], same])
        keep[:-1] |= same
        yield batch.slice(0, len(tokens) - 1).filter(pa.array(keep[:-1]))
        held, again = batch.slice(len(tokens) - 1), bool(keep[-1])
    if held is not None:
        yield held


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, count: bool = True) -> DataFrame:
    """doc_id, same (the text's hash), n_shingles, component_id and n_links (how many other classes its class links with) of every row.

    Without `count` n_links is null.
    """
    return _members(docs, words, percent, count).drop("top")


def _members(docs: DataFrame, words: int, percent: int, count: bool) -> DataFrame:
    """The rows of near_duplicates with top, a number of their component (null without shingles)."""
    store = Scratch(docs.sparkSession, "jaccard-join")
    rows = keyed(docs).withColumn("same", F.xxhash64("text"))
    seen = store.put(_seen(rows, words), "seen")
    whole = seen.where("h is null").select("doc_id", "same", "n", "digest")
    classes = _sketches(rows, _frequent(seen), words, percent).where("n > 0").groupBy("n", "digest").agg(F.min(F.struct("doc_id", "same")).alias("rep"), F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("alike", "bits", "wide", "prefix")])
    classes = store.put(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    # 3. groups and posting lists
    several = classes.groupBy("n", "alike").agg(F.min("cid").alias("gid"), F.count("*").alias("size")).where("size > 1")
    followers = store.put(classes.select("cid", "n", "alike").join(several, ["n", "alike"]).where("cid <> gid").select("gid", "cid"), "followers")
    leaders = classes.join(followers.select("cid"), "cid", "left_anti")
    postings = leaders.select(F.col("cid").alias("gid"), F.posexplode("prefix").alias("at", "token")).select("token", "at", "gid")
    shared = postings.repartitionByRange("token", "gid").sortWithinPartitions("token", "gid").mapInArrow(_several, "token long, at int, gid long")
    listed = shared.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("listed"))  # a prefix at most
    listed = store.put(listed.join(classes.select(F.col("cid").alias("gid"), "n"), "gid"), "listed")

    # 4. stars
    own = listed.select("gid", "n", F.expr(f"size(listed) / {_prefix_sql('n', percent)}").alias("share"), F.explode("listed.token").alias("token"))
    hubs = own.groupBy("token").agg(F.max(F.struct("share", F.expr("-gid as earliest"), "n")).alias("hub")).select("token", F.expr("-hub.earliest as hub"), F.col("hub.n").alias("m"))
    agreed = own.join(hubs, "token").where("gid <> hub").groupBy(F.col("hub").alias("a"), F.col("gid").alias("b")).agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("m").alias("m"))
    possible = F.greatest(F.expr(f"n - {_prefix_sql('n', percent)} + c"), F.expr(f"m - {_prefix_sql('m', percent)} + c")) >= F.expr(_enough_sql("n", "m", percent))
    star = agreed.where(possible).where(_alike_sql("n", "m", percent)).groupBy("b").agg(F.max_by("a", F.struct("c", -F.col("a"))).alias("a")).select("a", "b")
    pairs = store.put(star.unionByName(followers.toDF("a", "b")), "pairs1")
    roots = components(_linked(rows, classes, pairs, store, "links1", words, percent), store, "cc1")

    # 5. what is left between components
    placed = classes.select("cid").join(followers, "cid", "left").join(roots, F.col("cid") == F.col("node"), "left").select("cid", F.coalesce("gid", "cid").alias("gid"), F.coalesce("root", "cid").alias("root"))
    placed = store.put(placed, "placed")
    spread = placed.groupBy("gid").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size"))
    listed = store.put(listed.join(spread, "gid"), "spread")
    store.drop("listed", "pairs1")
    open_ = store.put(listed.select("lo", "hi", F.explode("listed.token").alias("token")).groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("df")).where("lo < hi").select("token", "df"), "open")
    among = listed.select("gid", F.posexplode("listed.token").alias("i", "token")).join(open_, "token").groupBy("gid").agg(F.collect_list(F.struct("i", "df")).alias("among"))  # places of open lists
    marked = listed.join(among, "gid").join(classes.select(F.col("cid").alias("gid"), "bits"), "gid").select("*", F.explode("among").alias("x"))
    marked = marked.selectExpr("listed[x.i].token as token", "gid as cid", "n", "lo", "hi", "listed[x.i].at as at", "x.i as i", *_before("listed", ".token", "x.i"), f"if(size = 1 and x.df > {SHORT}, bits, null) as bits")
    marked = store.put(marked, "marked")
    store.drop("open")
    apart = _open_pairs(marked, percent, "x.cid < y.cid and not (x.lo = x.hi and y.lo = y.hi and x.lo = y.lo)")
    parted = placed.join(spread.where("lo < hi").select("gid"), "gid", "left_semi").join(classes.select("cid", "n", "bits"), "cid")  # groups in several components
    parted = parted.alias("x").join(parted.alias("y"), F.expr(f"x.gid = y.gid and x.root < y.root and ({_bits_sql('x', 'y', _enough_sql('x.n', 'y.n', percent))})")).selectExpr("x.cid as a", "y.cid as b")
    one, other = placed.toDF("x", "a", "root_a"), placed.toDF("y", "b", "root_b")
    apart = store.put(apart, "apart")
    store.drop("marked")
    expanded = apart.join(one, "a").join(other, "b").where("root_a <> root_b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    rest = store.put(expanded.unionByName(parted), "pairs2")
    store.drop("apart", "spread", "followers")
    last = _linked(rows, classes, rest, store, "links2", words, percent)
    between = last.join(placed.select(F.col("cid").alias("a"), F.col("root").alias("ra")), "a").join(placed.select(F.col("cid").alias("b"), F.col("root").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    tops = components(between, store, "cc2").selectExpr("node", "root as higher")
    final = store.put(placed.join(tops, F.col("root") == F.col("node"), "left").select("cid", F.coalesce("higher", "root").alias("top")), "final")
    store.drop("pairs2", "placed")

    named = store.put(classes.select("cid", "n", "digest", "least").join(final, "cid"), "named")
    named = named.join(named.groupBy("top").agg(F.min("least").alias("component_id")), "top")
    if count:
        degree = _degrees(rows, classes, final, store, words, percent)
        named = named.join(degree, "cid", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    else:
        named = named.withColumn("n_links", F.lit(None).cast("long"))
    named = named.select("n", "digest", "component_id", "n_links", "top")
    linked = whole.where("n > 0").join(named, ["n", "digest"]).select("doc_id", "same", F.col("n").cast("long").alias("n_shingles"), "component_id", "n_links", "top")
    empty = whole.where("n = 0").select("doc_id", "same", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0 if count else None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("top"))
    return linked.unionByName(empty)


def _degrees(rows: DataFrame, classes: DataFrame, final: DataFrame, store: Scratch, words: int, percent: int) -> DataFrame:
    """cid and n_links, the number of other classes that it links with, of the classes that link."""
    several = final.groupBy("top").agg(F.count("*").alias("size")).where("size > 1").select("top")
    linked = final.join(several, "top").repartitionByRange("top", "cid").sortWithinPartitions("top", "cid")
    seats = store.put(linked.select("cid", F.monotonically_increasing_id().alias("seat"), "top"), "seats")
    marked = classes.select("cid", "n", "bits", "prefix").join(seats, "cid").select("*", F.posexplode("prefix").alias("at", "token"))
    marked = store.put(marked.selectExpr("token", "cid", "n", "seat", "top", "at", "at as i", *_before("prefix", "", "at"), "bits"), "marked-all")
    blocks = [f"cast(floor({side}.seat / {BLOCK}) as long) as {side}" for side in ("x", "y")]
    pairs = store.put(_open_pairs(marked, percent, "x.top = y.top and x.seat < y.seat", *blocks), "pairs-all")
    store.drop("marked-all")
    needs = store.put(pairs.selectExpr("x", "y", "a as cid").unionByName(pairs.selectExpr("x", "y", "b as cid")).distinct(), "needs")
    sets = store.put(_fetched(rows, classes, needs.select("cid").distinct(), words), "sets-all")
    both = needs.join(sets, "cid").groupBy("x", "y").cogroup(pairs.groupBy("x", "y"))
    found = store.put(both.applyInArrow(_links_of(percent), "cid long, n_links long"), "degrees")
    store.drop("pairs-all", "needs", "sets-all", "seats")
    return found.groupBy("cid").agg(F.sum("n_links").alias("n_links"))


def _links_of(percent: int):
    """The links of each class among the pairs of two blocks; the blocks' sets come once."""

    def run(held: pa.Table, pairs: pa.Table) -> pa.Table:
        sets = {c: np.frombuffer(x, np.uint64) for c, x in zip(held.column("cid").to_pylist(), held.column("codes").to_pylist(), strict=True)}
        found: Counter = Counter()
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
            p, q = sets[a], sets[b]
            common = _common(p, q)
            if 100 * common >= percent * (len(p) + len(q) - common):
                found.update((a, b))
        return pa.table({"cid": pa.array(found.keys(), pa.int64()), "n_links": pa.array(found.values(), pa.int64())})

    return run


def _before(items: str, field: str, i: str = "i") -> list[str]:
    """p1, p2 ...: the items before the i-th."""
    return [f"{items}[greatest({i} - {k}, 0)]{field} as p{k}" for k in range(1, EARLIER + 1)]


def _open_pairs(marked: DataFrame, percent: int, which: str, *more) -> DataFrame:
    """The pairs a, b of rows x, y for which `which` holds that the filters leave, each from few of the lists that both are in.

    Both sides are the same table, so it is dealt out once.
    """
    earlier = " or ".join(f"x.p{i} = y.p{j}" for i in range(1, EARLIER + 1) for j in range(1, EARLIER + 1))
    enough = _enough_sql("x.n", "y.n", percent)
    position = f"{_alike_sql('x.n', 'y.n', percent)} and least(x.n - x.at, y.n - y.at) >= {enough}"
    on = f"x.token = y.token and {which} and {position} and ({_bits_sql('x', 'y', enough)}) and (x.i = 0 or y.i = 0 or not ({earlier}))"
    return marked.alias("x").join(marked.alias("y"), F.expr(on)).selectExpr("x.cid as a", "y.cid as b", *more).distinct()


def _enough_sql(n: str, m: str, percent: int) -> str:
    """An intersection that a link of sets of n and m shingles needs at least."""
    return f"cast(ceil({percent} * ({n} + {m}) / {100 + percent}) as long)"


def _alike_sql(n: str, m: str, percent: int) -> str:
    return f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m})"


def _bits_sql(x: str, y: str, enough: str) -> str:
    """Whether the bitmaps, where both are known, leave a link possible."""
    lacking = lambda one, other: " + ".join(f"bit_count({one}.bits[{k}] & ~{other}.bits[{k}])" for k in range(BITMAP))
    return f"{x}.bits is null or {y}.bits is null or least({x}.n - ({lacking(x, y)}), {y}.n - ({lacking(y, x)})) >= {enough}"


def _prefix_sql(n: str, percent: int) -> str:
    return f"({n} - cast(ceil({percent} * {n} / 100) as int) + 1)"


def representatives(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs, all columns as they are, with one row of each component: one with the smallest doc_id. Rows without words stay.

    Components without any doc_id keep one row too; of rows that share doc_id and text any one stands for the others.
    """
    store = Scratch(docs.sparkSession, "representatives")
    found = store.put(_members(docs, words, percent, count=False).where("n_shingles > 0"), "found")
    best = found.groupBy("top").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same")).alias("x"), F.count("*").alias("size")).where("size > 1").select("top", "x.doc_id", "x.same")
    alike = F.col("f.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("f.same") == F.col("b.same"))
    judged = found.alias("f").join(best.alias("b"), "top").groupBy(F.col("f.doc_id").alias("_near_doc"), F.col("f.same").alias("_near_same")).agg(F.max(alike).alias("_near_best"), F.count("*").alias("_near_rows"))
    judged = store.put(judged, "judged")
    here = docs.withColumns({"_near_of": F.col("doc_id").cast("long"), "_near_hash": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    on = here["_near_of"].eqNullSafe(judged["_near_doc"]) & (here["_near_hash"] == judged["_near_same"])
    once = here.join(judged.where("not _near_best or _near_rows > 1"), on, "left_anti").select(*docs.columns)
    twice = here.join(judged.where("_near_best and _near_rows > 1"), on, "left_semi").groupBy("_near_of", "_near_hash").agg(F.first(F.struct(*docs.columns)).alias("row")).select("row.*")
    return once.unionByName(twice)
