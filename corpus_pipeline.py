"""A corpus in five stages: toxic documents go, repeated lines go, one of each group of near duplicates stays, documents
with benchmark passages go, and the rest is encoded.

Every stage works on all that the one before kept and returns the columns of documents, but for the last, which returns
the encoding's digests. Null and empty texts, ties, repeated rows and very long texts are handled as the operators define; an
empty table stays one. A document that line dedup leaves no text of goes with its lines; one that had no text before stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from termscan.llm import decontaminate, jaccard_join, line_dedup, piece_tokenizer, toxicity
from termscan.llm._common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the lexicon, learned from the labelled ones among them, scores at the threshold or above.

    Null and empty texts score 0 and stay, and so do all documents if no label is toxic.
    """
    return toxicity.accepted(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the lines that an earlier document has in a common block, and without documents that lose all their text.

    Rows that share doc_id and text are one document and lose the same lines; null texts stay null.
    """
    return line_dedup.deduplicated(docs, emptied=False)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each component of near duplicates, one with the smallest doc_id; texts without words all stay."""
    return jaccard_join.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a benchmark window; null and empty texts hold none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of every document; null texts count as empty."""
    return piece_tokenizer.piece_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: Learned scores, alignments, components and a tokenizer have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    store, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = store.put(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            store.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
