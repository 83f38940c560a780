"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: lower case, homoglyphs and accents of other scripts to the Latin letters they look like, digits and
signs inside words to the letters they stand for, everything else to spaces. The lexicon holds word beginnings and whole
words with weights; one automaton finds all of them in one pass. Occurrences inside an exception phrase don't count. The
weights found, damped by the text's length, give the score.

Lexicon, weights, exceptions and the scale are learned from labelled documents: a term's weight is the log ratio of its
share among toxic and other training documents; of a family of beginnings the shortest that is pure enough stays; a
two-word phrase around a term that comes up in clean documents makes an exception. The sample is the training documents
with the smallest hash of doc_id, SAMPLE of them at most; only the fit is bounded so, every row is scored.

Null and empty texts score 0; very long texts are scored whole, one at a time. Every row gives a row. Rows without a doc_id are never learned from and count as not held
out. Labels with a null count for nothing; a document labelled twice is toxic if one label says so. Without toxic labels the
lexicon is empty and every score 0. Extra columns are ignored.
"""

import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import out, sliced, texts

THRESHOLD = 0.3
#: Labelled documents that the lexicon is learned from at most; they bound its terms and exceptions too.
SAMPLE = 8_000
#: Lengths of word beginnings that are tried.
SHORTEST, LONGEST = 4, 10
#: Log of the number of terms that may come in by chance.
CHANCE = math.log(0.05)

#: Characters that are drawn like a Latin letter.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ո": "n", "һ": "h",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d",
}
#: Digits and signs that stand for letters inside words.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}


class _Folds(dict):
    """str.translate table made as characters come up."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in HOMOGLYPHS:
            folded = HOMOGLYPHS[c]
        elif c in SUBSTITUTES:
            folded = SUBSTITUTES[c]
        else:
            plain = unicodedata.normalize("NFKD", c).lower()
            bare = "".join(HOMOGLYPHS.get(x, x) for x in plain if x.isalpha())
            if "​" <= c <= "‏" or c in "­⁠﻿":
                folded = ""
            elif unicodedata.category(c) in ("Mn", "Mc"):
                folded = ""
            else:
                folded = bare or " "
        self[code] = folded
        return folded


_folds = _Folds()


def folded(text: str) -> str:
    """A text's words, folded, with one space or more around each."""
    return f" {text.lower().translate(_folds)} "


_FEATURE = pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each word beginning and each whole word, folded within the task."""
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for batch in sliced(batches):
        for text, toxic in zip(texts(batch), batch.column("toxic").to_pylist(), strict=True):
            words = set(folded(text).split())
            terms = {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in range(SHORTEST, min(LONGEST, len(w)) + 1)}
            for t in terms:
                counts[t][0 if toxic else 1] += 1
            if len(counts) > 1_000_000:
                yield out({"t": list(counts), "x": [v[0] for v in counts.values()], "c": [v[1] for v in counts.values()]}, _FEATURE)
                counts.clear()
    yield out({"t": list(counts), "x": [v[0] for v in counts.values()], "c": [v[1] for v in counts.values()]}, _FEATURE)


def _word_before(text: str, at: int) -> str:
    while at and text[at - 1] == " ":
        at -= 1
    return text[text.rfind(" ", 0, at) + 1 : at]


def _word_after(text: str, at: int) -> str:
    while at < len(text) and text[at] == " ":
        at += 1
    end = text.find(" ", at)
    return text[at:] if end < 0 else text[at:end]


class Lexicon:
    """Weighted terms with exceptions. Terms begin with a space; whole words end with one too."""

    def __init__(self, weights: dict[str, float], exceptions: set[str] = frozenset(), scale: float = 1.0):
        self.weights, self.exceptions, self.scale = dict(weights), set(exceptions), scale
        self.automaton = None

    def __getstate__(self):
        return {**self.__dict__, "automaton": None}

    def _build(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            self.automaton.add_word(term, (term, weight))
        if self.weights:
            self.automaton.make_automaton()

    def matches(self, text: str) -> Iterator[tuple[str, float, str]]:
        """Term, weight and the two-word phrases around it, of each occurrence in a folded text."""
        if self.automaton is None:
            self._build()
        if not self.weights:
            return
        for end, (term, weight) in self.automaton.iter(text):
            start = end - len(term) + 1
            stop = text.find(" ", start + 1)
            word, before, after = text[start + 1 : stop], _word_before(text, start), _word_after(text, stop)
            yield term, weight, [f"{before} {word}" if before else "", f"{word} {after}" if after else ""]

    def raw_score(self, text: str) -> float:
        """The weights of the occurrences that count, damped by the text's length."""
        clean = folded(text)
        total = sum(weight for _, weight, phrases in self.matches(clean) if self.exceptions.isdisjoint(phrases))
        return total / math.sqrt(1 + clean.count(" ") / 2_000) if total else 0.0

    def score(self, text: str) -> float:
        return 1 - math.exp(-self.raw_score(text) / self.scale)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> Lexicon:
    """The lexicon of the training rows: those not held out."""
    spark = docs.sparkSession
    marked = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("label_doc")).agg(F.max("toxic").alias("toxic"))
    drawn = marked.where(~held_out(F.col("label_doc"))).orderBy(F.xxhash64("label_doc"), "label_doc").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("label_doc")).select("text", "toxic").where("text is not null")
    rows = rows.persist()
    try:
        sizes = {r["toxic"]: r["n"] for r in rows.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
        n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
        if not n_toxic:
            return Lexicon({})
        counted = rows.select("text", F.col("toxic") > 0).toDF("text", "toxic").mapInArrow(_features, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("x"), F.sum("clean").alias("c"))
        counted = counted.persist()
        n_terms = counted.count()
        best = counted.where(f"x >= 3 and c <= 0.05 * x * {max(1.0, n_clean / n_toxic)}").collect()  # the sample bounds them
        counted.unpersist()
        chosen = _chosen([(r["term"], r["x"], r["c"]) for r in best], n_toxic, n_clean, n_terms)
        plain = Lexicon(chosen)
        shared = spark.sparkContext.broadcast(plain)
        phrases = rows.select("text", F.col("toxic") > 0).toDF("text", "toxic").mapInArrow(_phrases(shared), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("x"), F.sum("clean").alias("c"))
        exceptions = {r["term"] for r in phrases.where("c >= 2 and c > x").collect()}  # all; the sample bounds them
        exact = Lexicon(chosen, exceptions)
        shared = spark.sparkContext.broadcast(exact)
        scored = rows.select("text", F.col("toxic") > 0).toDF("text", "toxic").mapInArrow(_scored(shared), "raw double, toxic boolean").collect()  # `sample` rows at most
    finally:
        rows.unpersist()
    return Lexicon(chosen, exceptions, _scale([(r["raw"], r["toxic"]) for r in scored], threshold))


def _chosen(terms: list[tuple[str, int, int]], n_toxic: int, n_clean: int, n_terms: int) -> dict[str, float]:
    """Terms that no chance explains among so many tried, the shortest of each family, with their weights."""
    rate = n_toxic / (n_toxic + n_clean)
    found: dict[str, float] = {}
    for term, x, c in sorted(terms, key=lambda r: (len(r[0].strip()), r[0])):
        chance = math.lgamma(x + c + 1) - math.lgamma(x + 1) - math.lgamma(c + 1) + x * math.log(rate) + c * math.log(1 - rate)
        weight = math.log((x + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))
        if chance + math.log(n_terms) < CHANCE and weight > 2 and not any(term[:k] in found for k in range(SHORTEST + 1, len(term))):
            found[term] = weight
    return dict(sorted(found.items(), key=lambda r: (-r[1], r[0])))


def _phrases(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic_in, clean_in = Counter(), Counter()
        for batch in sliced(batches):
            for text, toxic in zip(texts(batch), batch.column("toxic").to_pylist(), strict=True):
                found = {p for *_, phrases in shared.value.matches(folded(text)) for p in phrases if p}
                (toxic_in if toxic else clean_in).update(found)
        terms = list(clean_in)
        yield out({"t": terms, "x": [toxic_in[t] for t in terms], "c": [clean_in[t] for t in terms]}, _FEATURE)

    return run


def _scored(shared):
    schema = pa.schema([("raw", pa.float64()), ("toxic", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield out({"r": [shared.value.raw_score(t) for t in texts(batch)], "t": batch.column("toxic")}, schema)

    return run


def _scale(scored: list[tuple[float, bool]], threshold: float) -> float:
    """The scale at which the threshold splits the training rows best (by F1); ties take the middle of the best stretch."""
    at = -math.log(1 - threshold)
    positives = sum(t for _, t in scored)
    best, choices, hits, seen = -1.0, [], 0, 0
    for cut, group in groupby(sorted((x for x in scored if x[0] > 0), reverse=True), key=lambda x: x[0]):
        marks = [t for _, t in group]
        hits, seen = hits + sum(marks), seen + len(marks)
        f1 = 2 * hits / (positives + seen)
        if f1 > best + 1e-12:
            best, choices = f1, [cut]
        elif abs(f1 - best) <= 1e-12:
            choices.append(cut)
    if not choices:
        return 1.0
    least = min(choices)
    below = max((r for r, _ in scored if r < least), default=0.0)
    return max(1e-6, (least + below) / 2) / at


def toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            scores = [shared.value.score(t) for t in texts(batch)]
            yield out({"d": batch.column("doc_id"), "h": batch.column("held"), "s": scores, "p": [int(s >= threshold) for s in scores]}, schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id").cast("long")).alias("held"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns as they are, without the rows that score at the threshold or above."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = sliced([pa.RecordBatch.from_arrays([batch], ["text"])])
            yield pa.array([shared.value.score(t) for part in parts for t in texts(part)], pa.float64())

    return docs.where(score(F.col("text").cast("string")) < threshold)
