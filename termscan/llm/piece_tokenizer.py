"""SentencePiece byte-pair encoding and decoding in vectorised merge rounds.

The symbols of many words lie in one flat array. A round finds, by a segmented minimum, the best pair rank of each
word, merges all of that word's leftmost non-overlapping occurrences at once, and compacts the arrays; words with no
pair left drop out. The rounds end when none remains.

Merging all occurrences at once equals the library's one-at-a-time order as long as a merge cannot make a pair that
ranks no later than itself. The vocabulary tells which pieces can ("risky" ones, such as runs of spaces, whose scores
are all equal); words whose round would make one merge only its leftmost occurrence.

Words are cut where a space mark follows another character: no piece of the vocabulary holds such a place (checked when
the model is loaded), so words do not interact, and a worker encodes each distinct word once.

Runs of space marks, whose merges all rank alike, are first shortened by the longest piece of marks, which each such stretch
of a run ends as.

Null texts count as empty: no ids, and they decode to the empty text. Very long texts are encoded whole, one at a time. Every
row gives a row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import Remembered, keyed, out, sliced, texts

MARK = "▁"
#: Bytes of distinct words and their ids that a worker remembers, by a rough measure; beyond it the memory starts anew.
REMEMBERED = 40 << 20
#: Symbols that the merge rounds take at a time.
ROUND_SYMBOLS = 1 << 18
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


class PieceModel:
    """A byte-pair model file of the sentencepiece library with identity normalisation and byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.name != "identity" or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
            raise ValueError("only byte-pair models with identity normalisation, a dummy prefix and no white space removal are supported")
        pieces = [(p.piece, p.score, p.type) for p in model.pieces]
        if any(kind in (USER, UNUSED) for *_, kind in pieces) or sum(kind == BYTE for *_, kind in pieces) != 256:
            raise ValueError("only models with byte fallback and without user-defined or unused pieces are supported")
        if any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in pieces if kind == NORMAL):
            raise ValueError("a piece goes on past a space mark, so words cannot be encoded alone")
        self.size = len(pieces)
        self.number = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.bytes = np.zeros(256, np.int64)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.bytes[int(p[1:-1], 16)] = i
        scores = sorted({s for _, s, kind in pieces if kind == NORMAL}, reverse=True)
        place = {s: i for i, s in enumerate(scores)}
        symbols = dict(self.number)  # characters that pieces hold without being one get numbers of their own
        for c in {c for p in self.number for c in p}:
            symbols.setdefault(c, self.size + len(symbols))
        self.span = max([self.size, *symbols.values()]) + 2
        pairs, risky = [], set()
        for p, i in self.number.items():
            for cut in range(1, len(p)):
                a, b = symbols.get(p[:cut]), symbols.get(p[cut:])
                if a is not None and b is not None:
                    pairs.append((a * self.span + b, place[pieces[i][1]], i))
                    risky |= {x for x in (a, b) if x < self.size and place[pieces[i][1]] <= place[pieces[x][1]]}
        pairs.sort()
        self.keys, self.ranks, self.makes = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.risky = np.zeros(self.span, bool)
        self.risky[list(risky)] = True
        self.symbols, self.none = symbols, len(scores)
        # a hash table over the pair keys: as many slots as keep the longest probe short
        self.bits = 20
        self.table = np.full(1 << self.bits, -1, np.int64)
        left = np.arange(len(self.keys))
        self.probes = 0
        while len(left):
            slot = self._slot(self.keys[left], self.probes)
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            left = left[self.table[slot] != left]
            self.probes += 1
        self.run = self._runs()
        self._forget()
        whole = [b" \xe2\x81\x87 " if kind == UNKNOWN else b"" if kind == CONTROL else bytes([int(p[1:-1], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in pieces]
        self.kinds = np.array([kind for *_, kind in pieces])
        self.width = np.array([len(x) for x in whole], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.width)[:-1]])
        self.letters = np.frombuffer(b"".join(whole), np.uint8)
        self.decimal = [str(i) for i in range(self.size)]

    def _forget(self) -> None:
        self.words = Remembered()
        self.words.limit = REMEMBERED

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * probe & (1 << 64) - 1)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair in keys, -1 where the vocabulary does not merge it."""
        keys, found = left * self.span + right, np.full(len(left), -1, np.int64)
        todo = np.arange(len(keys))
        for probe in range(self.probes):
            at = self.table[self._slot(keys[todo], probe)]
            hit = (at >= 0) & (self.keys[at] == keys[todo])
            found[todo[hit]] = at[hit]
            todo = todo[~hit & (at >= 0)]
            if not len(todo):
                break
        return found

    def merge(self, flat: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols left of each word; word: the word's number of each symbol, ascending."""
        done_s, done_w = [], []
        rank = place = None
        while len(flat):
            if rank is None:
                place = np.full(len(flat), -1, np.int64)
                inner = np.flatnonzero(word[:-1] == word[1:])
                place[inner] = self._look(flat[inner], flat[inner + 1])
            rank = np.where(place >= 0, self.ranks[place], self.none)
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, heads)
            length = np.diff(np.append(heads, len(flat)))
            live = np.repeat(best < self.none, length)
            if not live.all():
                done_s.append(flat[~live])
                done_w.append(word[~live])
                flat, word, place, rank, best, length = flat[live], word[live], place[live], rank[live], best[best < self.none], length[best < self.none]
                if not len(flat):
                    break
            at = np.flatnonzero(rank == np.repeat(best, length))
            run = np.concatenate([[True], np.diff(at) > 1])
            within = np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            at = at[within % 2 == 0]
            first = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
            if not first.all():
                bad = np.unique(word[at[self.risky[self.makes[place[at]]]]])
                if len(bad):
                    at = at[first | ~np.isin(word[at], bad)]
            flat = flat.copy()
            flat[at] = self.makes[place[at]]
            keep = np.ones(len(flat), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            flat, word, place, at = flat[keep], word[keep], place[keep], moved[at]
            # only pairs beside a merged symbol are new
            fresh = np.unique(np.concatenate([at, at[at > 0] - 1]))
            place[fresh] = -1
            inner = fresh[fresh + 1 < len(flat)]
            inner = inner[word[inner] == word[inner + 1]]
            place[inner] = self._look(flat[inner], flat[inner + 1])
        if not done_s:
            return flat, word
        flat, word = np.concatenate(done_s), np.concatenate(done_w)
        order = np.argsort(word, kind="stable")
        return flat[order], word[order]

    def _runs(self) -> tuple[int, int]:
        """The symbols m of the longest run of space marks that is a piece, if runs can be shortened by it (else 0), and its id.

        If all merges of marks rank alike, the leftmost comes first. So the first m marks of a longer run end as that piece,
        if a run of m alone does, and no piece goes on from it; what follows is as if they were not there.
        """
        runs = {len(p): i for p, i in self.number.items() if not p.strip(MARK)}
        most = max(runs, default=0)
        mixed = any(p.startswith(MARK * 2) and p.strip(MARK) for p in self.number)
        ranks = {int(r) for r, i in zip(self.ranks, self.makes, strict=True) if int(i) in runs.values()}
        if most < 2 or mixed or len(ranks) > 1:
            return 0, 0
        alone, _ = self.merge(np.full(most, self.symbols[MARK], np.int64), np.zeros(most, np.int64))
        return (most, runs[most]) if alone.tolist() == [runs[most]] else (0, 0)

    def _learn(self, words: list[str]) -> None:
        """Encodes words, given without their first space mark, and remembers their ids."""
        most, piece = self.run
        long = [w for w in words if most and w.startswith(MARK * (4 * most - 1))]
        if long:  # runs of three to four times `most` marks stay
            begun = {w: (len(w) + 1 - len(w.lstrip(MARK))) // most - 3 for w in long}
            rest = {w: w[begun[w] * most :] for w in long}
            self._learn([w for w in dict.fromkeys([*words, *rest.values()]) if w not in begun and w not in self.words])
            for w in long:
                self.words[w] = np.array([piece], "<u4").tobytes() * begun[w] + self.words[rest[w]]
                self.words.fits(w, len(self.words[w]))
            return
        start = 0
        while start < len(words):
            end, held = start, 0
            while end < len(words) and (end == start or held + len(words[end]) <= ROUND_SYMBOLS):
                held += len(words[end]) + 1
                end += 1
            part = words[start:end]
            chars = "".join(MARK + w for w in part)
            codes = np.frombuffer(chars.encode("utf-32-le"), np.uint32)
            word = np.repeat(np.arange(len(part)), [len(w) + 1 for w in part])
            kinds, inverse = np.unique(codes, return_inverse=True)
            number = np.array([self.symbols.get(chr(c), -1) for c in kinds], np.int64)
            flat = number[inverse]
            # characters outside the vocabulary become their bytes at once; bytes never merge
            lost = np.flatnonzero((flat < 0) | (flat >= self.size))
            stray = {int(i): chars[i] for i in lost}
            flat = flat.copy()
            flat[flat < 0] = self.span - 1
            ids, owner = self.merge(flat, word)
            if len(lost):
                ids, owner = self._spelled(ids, owner, [stray[i] for i in sorted(stray)], flat, word)
            cuts = np.searchsorted(owner, np.arange(len(part) + 1)) * 4
            body = ids.astype("<u4").tobytes()
            for i, w in enumerate(part):
                self.words[w] = body[cuts[i] : cuts[i + 1]]
                self.words.fits(w, int(cuts[i + 1] - cuts[i]))
            start = end

    def _spelled(self, ids, owner, stray, flat, word):
        """ids with each symbol that is no piece replaced by the ids of its bytes; strays keep their order."""
        places = np.flatnonzero(ids >= self.size)
        # a character that some piece holds may have merged away, so strays are matched per word through the symbols left
        spelled, at = [], {}
        for k, i in enumerate(np.flatnonzero(flat >= self.size)):
            at.setdefault((int(word[i]), int(flat[i])), []).append(stray[k])
        left: dict = {}
        for i in places:
            key = (int(owner[i]), int(ids[i]))
            k = left[key] = left.get(key, -1) + 1
            spelled.append(self.bytes[list(at[key][k].encode())])
        sizes = np.ones(len(ids), np.int64)
        sizes[places] = [len(x) for x in spelled]
        new = np.repeat(ids, sizes)
        begin = np.cumsum(sizes) - sizes
        for i, x in zip(places, spelled, strict=True):
            new[begin[i] : begin[i] + len(x)] = x
        return new, np.repeat(owner, sizes)

    def split(self, text: str) -> list[str]:
        """The words of a text, each without its first space mark, which every word has."""
        if not text:
            return []
        words = text.split(" ")
        if "" in words or MARK in text:
            return [w[1:] for w in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))]
        return words

    def encode(self, rows: list[str]) -> list[np.ndarray]:
        """The ids of each text, as the library gives them without begin and end ids."""
        cut = [self.split(t) for t in rows]
        if self.words.full:
            self._forget()
        return [np.frombuffer(x, "<u4") for x in self.words.joined(cut, lambda new: self._learn(list(new)))]

    def decode(self, ids: np.ndarray) -> str:
        """The text of one row of ids."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return ""
        width = self.width[ids]
        total = int(width.sum())
        first = np.cumsum(width) - width
        body = self.letters[np.repeat(self.begins[ids] - first, width) + np.arange(total)].tobytes()
        shown = np.flatnonzero(self.kinds[ids] != CONTROL)
        skip = int(len(shown) and self.kinds[ids[shown[0]]] == NORMAL and body[:1] == b" ")
        try:
            return body[skip:].decode()
        except UnicodeDecodeError:
            return self._mended(ids)[skip:]

    def _mended(self, ids: np.ndarray) -> str:
        """Byte ids that are no UTF-8 each become U+FFFD; other pieces stand for themselves."""
        parts, run = [], bytearray()

        def flush():
            i = 0
            while i < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        parts.append(bytes(run[i : i + n]).decode())
                        i += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    parts.append("�")
                    i += 1
            run.clear()

        for i in ids.tolist():
            piece = self.letters[self.begins[i] : self.begins[i] + self.width[i]].tobytes()
            if self.kinds[i] == BYTE:
                run += piece
            elif self.kinds[i] != CONTROL:
                flush()
                parts.append(piece.decode())
        flush()
        return "".join(parts)


@lru_cache(maxsize=4)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def piece_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the text that they decode to, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        name = model.decimal.__getitem__
        for batch in sliced(batches):
            ids = model.encode(texts(batch))
            yield out(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_tokens": [len(x) for x in ids],
                    "ids": [hashlib.sha256(",".join(map(name, x.tolist())).encode()).hexdigest() for x in ids],
                    "decoded": [hashlib.sha256(model.decode(x).encode()).hexdigest() for x in ids],
                },
                _SCHEMA,
            )

    return keyed(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of every row, ids as an array."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in sliced(batches):
            ids = model.encode(texts(batch))
            cuts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            yield out({"doc_id": batch.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))}, schema)

    return keyed(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with ids; null ids decode to the empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            yield out({"doc_id": batch.column("doc_id"), "text": [model.decode(x or []) for x in batch.column("ids").to_pylist()]}, schema)

    return rows.selectExpr("cast(doc_id as long) doc_id", "ids").mapInArrow(run, "doc_id long, text string")
