"""Token ids in binary files of directly addressable codes.

An id is split into chunks of `chunk_bits`. Level 0 holds the lowest chunk of every id; a bitmap beside it says which ids
go on, and level 1 holds the next chunk of those alone, and so on. The place of an id's next chunk is the number of set
bits before it, which a rank directory gives for every 512th place, so any token is read in a few steps without
decoding what lies around it.

A file image holds the documents of one stretch of ascending doc_ids: their ids, the first token of each, and the levels.
Images are kept as rows of a Parquet table that Spark's committer writes, in the shared folder or any store that Spark
reaches; a task that is lost or runs twice leaves no half-written or double image. `dump` writes them as plain files.

Layout of an image, little-endian: magic "DAC1"; u32 documents; u64 tokens; u32 chunk bits; u32 levels; i64 doc_ids;
u8 null flags of the doc_ids; u64 first tokens (documents + 1); then for each level u64 entries, the chunks (u8 or u16),
the bitmap (u64 words) and the rank directory (u64 for every 512 places).

Null texts count as empty and hold only the end id. Null doc_ids come first. Rows with the same doc_id follow each other
in the order of their texts. Extra columns are ignored; an empty table gives no image and no rows.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Remembered, Scratch, keyed, out, raw, sliced
from .token_counts import byte_letters

END_ID = 1
CHUNK_BITS = 8
RANK_PLACES = 512
#: Text bytes of an image; a longer text is an image of its own.
IMAGE_BYTES = 4 << 20

_MAGIC = b"DAC1"
_IMAGES = "part int, image int, n_docs int, n_tokens long, body binary"
_IMAGE_SCHEMA = pa.schema([("part", pa.int32()), ("image", pa.int32()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("body", pa.binary())])


def pack(doc_ids: list[int | None], begins: np.ndarray, ids: np.ndarray, chunk_bits: int = CHUNK_BITS) -> bytes:
    """One file image. begins: the first token of each document, and the number of tokens."""
    kind = np.dtype("u1") if chunk_bits <= 8 else np.dtype("<u2")
    levels, left = [], np.asarray(ids, np.uint32)
    while True:
        more = left >> np.uint32(chunk_bits)
        chunks = (left & np.uint32((1 << chunk_bits) - 1)).astype(kind)
        goes_on = more > 0
        words = -(-len(left) // 64)
        bits = np.packbits(goes_on, bitorder="little")
        bitmap = np.zeros(words * 8, np.uint8)
        bitmap[: len(bits)] = bits
        per = np.zeros(-(-len(left) // RANK_PLACES) * RANK_PLACES, np.uint8)
        per[: len(left)] = goes_on
        ranks = np.concatenate([[0], np.cumsum(per.reshape(-1, RANK_PLACES).sum(1, dtype=np.uint64))[:-1]]) if len(left) else np.zeros(0)
        levels.append(struct.pack("<Q", len(left)) + chunks.tobytes() + bitmap.tobytes() + ranks.astype("<u8").tobytes())
        left = more[goes_on]
        if not len(left):
            break
    head = _MAGIC + struct.pack("<IQII", len(doc_ids), len(ids), chunk_bits, len(levels))
    names = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array([x is None for x in doc_ids], "u1").tobytes()
    return b"".join([head, names, np.asarray(begins, "<u8").tobytes(), *levels])


class TokenFile:
    """Reads a file image."""

    def __init__(self, body: bytes):
        if body[:4] != _MAGIC:
            raise ValueError("not a token file")
        n_docs, self.n_tokens, self.bits, n_levels = struct.unpack_from("<IQII", body, 4)
        at = 24

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(body, kind, n, at)
            at += found.nbytes
            return found

        names = take("<i8", n_docs)
        self.doc_ids = [None if gone else x for x, gone in zip(names.tolist(), take("u1", n_docs).tolist(), strict=True)]
        self.begins = take("<u8", n_docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            n = struct.unpack_from("<Q", body, at)[0]
            at += 8
            self.levels.append((n, take("u1" if self.bits <= 8 else "<u2", n), take("u1", -(-n // 64) * 8), take("<u8", -(-n // RANK_PLACES))))

    def _rank(self, level: int, i: int) -> int:
        """Set bits of the level before place i."""
        _, _, bitmap, ranks = self.levels[level]
        if i == 0:
            return 0
        block = min(i // RANK_PLACES, len(ranks) - 1)
        bits = np.unpackbits(bitmap[block * RANK_PLACES // 8 : -(-i // 8)], bitorder="little")
        return int(ranks[block]) + int(bits[: i - block * RANK_PLACES].sum())

    def token(self, i: int) -> int:
        """The i-th id, by its own chunks alone."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = 0
        for level, (_, chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            i, shift = self._rank(level, i), shift + self.bits
        return value

    def tokens(self, start: int, end: int) -> np.ndarray:
        """The ids from start to before end."""
        places, back = [], []
        a, b = start, end
        for level, (_, chunks, bitmap, _) in enumerate(self.levels):
            part = chunks[a:b].astype(np.uint32)
            on = np.unpackbits(bitmap[a >> 3 : -(-b // 8)], bitorder="little")[a & 7 : (a & 7) + b - a].astype(bool)
            places.append(part)
            back.append(on)
            a, b = self._rank(level, a), self._rank(level, b)
            if a == b:
                break
        found = places[-1]
        for part, on in zip(places[-2::-1], back[-2::-1], strict=True):
            part[on] |= found << np.uint32(self.bits)
            found = part
        return found

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.begins[k]), int(self.begins[k + 1]))


class WordEncoder:
    """The tokenizers library on each distinct word once.

    For vocabularies that split at white space and drop it: no pre-token crosses a space, so a text's ids are those of
    its words. `check` says whether a tokenizer file is of that kind; others are encoded text by text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x.get("type") for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        clean = [x.get("type") for x in (spec["normalizer"] or {}).get("normalizers", [])]
        self.by_word = steps == ["Split", "ByteLevel"] and clean == ["NFC", "Replace", "Lowercase"] and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]) and spec["pre_tokenizer"]["pretokenizers"][0]["behavior"] == "Removed"
        # letters below U+0130 are lowered one by one and have no other normal form, so the model alone is enough for them
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        self.letters = {b: c for b, c in byte_letters().items() if b != 32}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words = Remembered({b"": b""})

    def _learn(self, words: list[bytes]) -> None:
        """Letters alone are one pre-token, so many words go as one text and part where a token ends a word."""
        letters, keys, rest = [], [], []
        for key in words:
            w = key.decode()
            if w.isalpha() and (w.isascii() or max(w) < "\u0130"):
                letters.append(w)
                keys.append(key)
            else:
                rest.append(w)
        text = " ".join(letters).lower().encode().decode("latin-1").translate(self.letters)
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist() if len(ids) else []
        body, at = ids.tobytes(), 0
        for key, end in zip(keys, ends, strict=True):
            self.words[key] = body[at:end]
            at = end
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.words[w.encode()] = np.array(e.ids, "<u4").tobytes()

    def encode(self, rows: list[bytes]) -> list[bytes]:
        """Ids of UTF-8 texts, each text's as little-endian unsigned 32-bit integers."""
        if not self.by_word:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch([t.decode() for t in rows], add_special_tokens=False)]
        # ASCII letters are lowered here already, but not where a special token could arise by it
        cut = [(t if b"<" in t else t.lower()).split() for t in rows]
        if self.words.full:
            self.words = Remembered({b"": b""})
        return self.words.joined(cut, self._learn_marked)

    def _learn_marked(self, new: set[bytes]) -> None:
        """A last full stop or comma after a letter is a pre-token of its own."""
        marked = [w for w in new if w[-1:] in (b".", b",") and w[-2:-1].isalpha()]
        plain = new.difference(marked)
        plain.update(w[:-1] for w in marked)
        plain.update((b".", b","))
        self._learn(list(plain.difference(self.words)))
        for w in marked:
            self.words[w] = self.words[w[:-1]] + self.words[w[-1:]]
        for w in new:
            self.words.fits(w, len(self.words[w]))


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_images(docs: DataFrame, path: str, store: Scratch, end_id: int = END_ID, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """The table of file images, in ascending doc_id order by (part, image)."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = word_encoder(path), TaskContext.get().partitionId()
        for image, batch in enumerate(sliced(batches, limit=IMAGE_BYTES)):
            rows = [x + end for x in encoder.encode(raw(batch))]
            begins = np.concatenate([[0], np.cumsum([len(x) // 4 for x in rows])])
            body = pack(batch.column("doc_id").to_pylist(), begins, np.frombuffer(b"".join(rows), "<u4"), chunk_bits)
            yield out({"part": [part], "image": [image], "n": [len(rows)], "t": [int(begins[-1])], "body": [body]}, _IMAGE_SCHEMA)

    rows = keyed(docs)
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return store.put(ordered.mapInArrow(run, _IMAGES), "images")


def with_bases(images: DataFrame) -> DataFrame:
    """images with `base`: the tokens of all images before. Sums within parts first; parts are as many as shuffle partitions."""
    before = Window.partitionBy("part").orderBy("image").rowsBetween(Window.unboundedPreceding, -1)
    sizes = images.select("part", "image", "n_tokens").withColumn("inside", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    parts = images.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return sizes.join(F.broadcast(parts.select("part", "ahead")), "part").select("part", "image", (F.col("ahead") + F.col("inside")).alias("base"))


_READ = pa.schema([("part", pa.int32()), ("image", pa.int32()), ("doc_id", pa.int64()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_images(images: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the images."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "body"):
            for part, image, body in zip(batch.column("part").to_pylist(), batch.column("image").to_pylist(), batch.column("body").to_pylist(), strict=True):
                file = TokenFile(body)
                n, begins = len(file.doc_ids), file.begins
                ids = file.tokens(0, file.n_tokens).astype("<u4") if file.n_tokens else np.zeros(0, "<u4")
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
                yield out({"part": [part] * n, "image": [image] * n, "doc_id": file.doc_ids, "inside": begins[:-1], "n": np.diff(begins), "crc": crcs}, _READ)

    rows = images.select("part", "image", "body").mapInArrow(run, "part int, image int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(with_bases(images), ["part", "image"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str, end_id: int = END_ID, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """Writes the ids of all documents, reads the files back, and returns what they hold of every row."""
    return read_images(write_images(docs, path, Scratch(docs.sparkSession, "token-files"), end_id, chunk_bits))


def dump(images: DataFrame, folder: str) -> None:
    """Writes each image as a file of its own into a folder that every executor reaches by path."""

    def run(batches):
        for batch in batches:
            for part, image, body in zip(batch.column("part").to_pylist(), batch.column("image").to_pylist(), batch.column("body").to_pylist(), strict=True):
                name = f"{folder}/{part:06d}-{image:06d}.dac"
                with open(f"{name}.{os.getpid()}", "wb") as f:
                    f.write(body)
                os.replace(f"{name}.{os.getpid()}", name)
        return iter(())

    os.makedirs(folder, exist_ok=True)
    images.mapInArrow(run, "part int").foreach(lambda _: None)


def load_images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
