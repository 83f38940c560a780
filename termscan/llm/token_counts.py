"""Token counts without identifiers: heap-and-linked-list byte-pair merging.

A piece's symbols form a linked list; a heap holds the adjacent pairs that the vocabulary merges, lowest rank
first and leftmost first among equals. Each pop that still describes two live neighbours joins them. The count is
the number of initial symbols (bytes) less the number of merges; no token is ever named.

Texts are cut at single spaces (a token never crosses from a non-space into a space), so a worker counts each
distinct chunk once and adds up. Texts with two spaces in a row take the tokenizer's own pattern as a whole.
The tokenizer's special strings count as one token each, as the library does by default.

Null texts count as empty: no bytes, no tokens. Very long texts are counted whole, one at a time; a piece of n bytes takes time
n log n. Every row gives a row; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._common import keyed, out, sliced, texts

LIMIT = 512
#: Characters of the chunks (each with 60 more) that a worker remembers; beyond it the memory starts anew.
REMEMBERED = 60 << 20

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PairCounter:
    """Counts the tokens of a byte-level byte-pair vocabulary in the tokenizers library's JSON form."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        number = {letter: b for b, letter in byte_letters().items()}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            for x in (a, b, a + b):
                number.setdefault(x, len(number))
            self.pairs.setdefault((number[a], number[b]), (rank, number[a + b]))
        self.words = regex.compile(pattern)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.probes = special
        self.pieces: dict[str, int] = {}
        self.chunks: dict[str, int] = {}
        self.held = 0

    def merged(self, symbols: bytes) -> int:
        """Tokens that the symbols of one piece end up as."""
        n = len(symbols)
        if n < 2:
            return n
        pairs, sym = self.pairs, list(symbols)
        order = [(found[0], i, found[1], i + 1) for i in range(n - 1) if (found := pairs.get((sym[i], sym[i + 1])))]
        heapq.heapify(order)
        after, before, live, dead = list(range(1, n + 1)), list(range(-1, n - 1)), n, bytearray(n)
        while order:
            rank, i, name, j = heapq.heappop(order)
            if dead[i] or after[i] != j or pairs.get((sym[i], sym[j])) != (rank, name):
                continue
            sym[i], dead[j] = name, 1
            k = after[i] = after[j]
            live -= 1
            if k < n:
                before[k] = i
                if found := pairs.get((name, sym[k])):
                    heapq.heappush(order, (found[0], i, found[1], k))
            h = before[i]
            if h >= 0 and (found := pairs.get((sym[h], name))):
                heapq.heappush(order, (found[0], h, found[1], i))
        return live

    def _forget(self) -> None:
        if self.held > REMEMBERED:
            self.pieces.clear()
            self.chunks.clear()
            self.held = 0

    def piece(self, text: str) -> int:
        found = self.pieces.get(text)
        if found is None:
            self._forget()
            found = self.pieces[text] = self.merged(text.encode())
            self.held += len(text) + 60
        return found

    def plain(self, text: str) -> int:
        return sum(map(self.piece, self.words.findall(text)))

    def chunk(self, text: str) -> int:
        if self.special and any(s in text for s in self.probes):
            return sum(map(self.plain, self.special.split(text))) + len(self.special.findall(text))
        return self.plain(text)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if "  " in text or any(" " in s for s in self.probes):
            return self.chunk(text)
        head, *rest = text.split(" ")
        total, known = self.chunk(head) if head else 0, self.chunks
        for x in rest:
            n = known.get(x)
            if n is None:
                self._forget()
                n = self.chunk(" " + x)
                known[x] = n
                self.held += len(x) + 60
            total += n
        return total


@lru_cache(maxsize=4)
def counter(path: str, pattern: str) -> PairCounter:
    return PairCounter(path, pattern)


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row. path and pattern: the vocabulary file and its word pattern."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, pattern).count
        for batch in sliced(batches):
            rows = texts(batch)
            n = [count(t) for t in rows]
            yield out({"doc_id": batch.column("doc_id"), "n_bytes": [len(t.encode()) for t in rows], "n_tokens": n, "over": [x > limit for x in n]}, _SCHEMA)

    return keyed(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
