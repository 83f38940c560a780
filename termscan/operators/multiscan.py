"""Scan tables with whole lexicons.

Terms become literal columns: each pattern is compiled once by each stage, and stands behind a cheap test for the literals
that a match needs. A lexicon that is a table itself comes to the driver in blocks (it holds definitions, not data), and each
block is one scan of the rows; a term whose pattern is relaxed is evaluated by its description. Text tables that come as one
file are dealt out first, since matching is what costs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from itertools import batched

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termscan.functions import matches as found
from termscan.functions.predicates import tree_match
from termscan.plans import terms
from termscan.plans.validate import for_java

#: Terms whose hits make one array, and terms that one scan of the rows takes.
LITERAL_TERMS = 100
BLOCK_TERMS = 1_000


def spread(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """rows over as many partitions as there are cores, if they come in fewer."""
    cores = partitions or rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _lower(rows: DataFrame, text: str) -> DataFrame:
    return rows.withColumn("_lower", F.lower(F.coalesce(F.col(text), F.lit(""))))


def _scan(rows: DataFrame, text: str, lexicon: Iterable[tuple], name: str) -> DataFrame:
    """rows with the ids (column `name`) of the trees or columns that hold; each block of the lexicon is one scan."""
    keep, low = rows.columns, _lower(rows, text)
    test = lambda x: x if isinstance(x, Column) else tree_match(x, F.col(text), F.col("_lower"))
    scans = []
    for block in batched(lexicon, BLOCK_TERMS):
        hits = F.concat(*[F.array(*[F.when(test(x), F.lit(i)) for i, x in part]) for part in batched(block, LITERAL_TERMS)])
        scans.append(low.select(*keep, F.explode(F.filter(hits, lambda x: x.isNotNull())).alias(name)))
    return reduce(DataFrame.unionByName, scans) if scans else rows.withColumn(name, F.lit(None).cast("string")).limit(0)


def scan(rows: DataFrame, text: str, lexicon: Sequence[tuple[str, str]], raw: bool = False) -> DataFrame:
    """rows with term_id of each term that they fulfil, one row for each hit. lexicon: ids and terms (or raw patterns)."""
    return _scan(rows, text, ((i, terms.translate_raw(t).tree if raw else terms.translate(t).tree) for i, t in lexicon), "term_id")


def scan_patterns(rows: DataFrame, text: str, patterns: DataFrame) -> DataFrame:
    """rows with id of each term of a pattern set that they fulfil: the same rows as `scan` gives.

    patterns: id and regex, and term_description, term_type and post_filter where there are terms of the term language. A
    relaxed pattern (post_filter) without its description is refused, since it says less than the term.
    """

    def known() -> Iterator[tuple]:
        for r in patterns.orderBy("id").toLocalIterator():
            r = r.asDict()
            if r.get("term_description") and r.get("term_type") != "NLT":
                yield r["id"], terms.translate(r["term_description"]).tree
            elif r.get("post_filter"):
                raise ValueError(f"pattern {r['id']} is relaxed, and there is no description to evaluate")
            else:
                yield r["id"], F.coalesce(F.col(text), F.lit("")).rlike(r["regex"])

    return _scan(rows, text, known(), "id")


def prefilter(rows: DataFrame, text: str, lexicon: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows that may hit some term: one alternation of all relaxed patterns. Not for terms that are true without a match."""
    parts = []
    for _, term in lexicon:
        t = terms.translate(term)
        if not terms.positional(t.tree) and _true_without_match(t.tree):
            raise ValueError(f"no prefilter holds for {term!r}")
        parts.append(f"(?:{terms.inline(t.flags)}{for_java(t.pattern)})")
    return rows.where(F.coalesce(F.col(text), F.lit("")).rlike("|".join(parts)))


def _true_without_match(node) -> bool:
    match node:
        case terms.Not():
            return True
        case terms.Or(parts):
            return any(map(_true_without_match, parts))
        case terms.And(parts):
            return all(map(_true_without_match, parts))
        case terms.AndNot(left, _):
            return _true_without_match(left)
        case terms.Near(left, right):
            return _true_without_match(left) or _true_without_match(right)
    return False


def _tagged(term_id: str):
    return lambda m: F.struct(F.lit(term_id).alias("term_id"), m["text"].alias("match_text"), m["start"].alias("start"), m["end"].alias("end"), m["byte_start"].alias("byte_start"), m["byte_end"].alias("byte_end"))


def positions(rows: DataFrame, text: str, lexicon: Sequence[tuple[str, str]]) -> DataFrame:
    """One row for each match of each term's pattern in rows that fulfil the term: match_text, positions."""
    keep, parts = rows.columns, []
    low = _lower(rows, text)
    for i, term in lexicon:
        t = terms.translate(term)
        where = found.matches(F.col(text), terms.inline(t.flags) + for_java(t.pattern))
        parts.append(F.when(tree_match(t.tree, F.col(text), F.col("_lower")), F.transform(where, _tagged(i))))
    hits = F.flatten(F.filter(F.array(*parts), lambda x: x.isNotNull()))
    return low.select(*keep, F.explode(hits).alias("m")).select(*keep, "m.*")
