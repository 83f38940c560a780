"""Compile a lexicon: each term's pattern, flags and verdict; and the summary of a lexicon."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from termscan.functions.scripts import SCRIPTS
from termscan.plans import terms
from termscan.plans.validate import for_java, for_java_column, java_compiles, java_problem, problem

PASS, FAILED = "PASS", "FAILED"
STANDARD, RAW = "Standard", "NLT"
#: Other names of the two types.
TYPES = {"Standard": STANDARD, "NLT": RAW, "NATURAL_LANGUAGE": STANDARD, "REGEX": RAW}
#: Declared limit of a request's terms, not enforced; and of a file's bytes.
MAX_TERMS = 1000
MAX_BYTES = 10 << 20

RESULT = "position int, term_id string, term_description string, risk_driver_name string, term_type string, status string, pattern string, error_log string, translation_error string, flags int, post_filter boolean, warning string"
#: Names of flags. The name of 0 stands for no flag.
NO_FLAG = "NO_FLAG"
FLAG_NAMES = {1: "CASELESS", 2: "DOTALL", 4: "MULTILINE", 8: "SINGLEMATCH", 16: "ALLOWEMPTY", 32: "UTF8", 64: "UCP", 128: "PREFILTER", 256: "SOM_LEFTMOST", 512: "COMBINATION", 1024: "QUIET"}


def compile_term(description: str | None, term_type: str = STANDARD) -> dict:
    """The verdict of one term. A bad term is a FAILED result, never an exception."""
    row = {"status": FAILED, "pattern": None, "error_log": None, "translation_error": None, "flags": 0, "post_filter": False, "warning": None}
    try:
        done = terms.translate_raw(description or "") if TYPES.get(term_type) == RAW else terms.translate(description)
    except terms.TermError as e:
        return row | {"translation_error": str(e)}
    row |= {"pattern": done.pattern, "flags": done.flags, "warning": "; ".join(done.warnings) or None}
    if error := problem(done.pattern) or java_problem(terms.inline(done.flags) + for_java(done.pattern), done.pattern):
        return row | {"error_log": error}
    return row | {"status": PASS, "post_filter": done.post_filter}


class RequestError(ValueError):
    """A request with wrong fields: what is wrong, by the field's name."""

    def __init__(self, fields: dict[str, str]):
        super().__init__("; ".join(f"{name} {what}" for name, what in fields.items()))
        self.fields = fields


class TooLarge(ValueError):
    """A file beyond MAX_BYTES."""


def checked(lexicon: Iterable[dict]) -> list[dict]:
    """Validates a request: terms there, ids and descriptions not blank, known types. Names all fields that are wrong."""
    rows, wrong = [dict(t) for t in lexicon], {}
    if not rows:
        wrong["terms"] = "must not be empty"
    for i, t in enumerate(rows):
        for name in ("term_id", "term_description"):
            if not (t.get(name) or "").strip():
                wrong[f"terms[{i}].{name}"] = "must not be blank"
        if (t.get("term_type") or STANDARD) not in TYPES:
            wrong[f"terms[{i}].term_type"] = f"must be one of {', '.join(TYPES)}"
    if wrong:
        raise RequestError(wrong)
    return rows


def sized(body: bytes) -> bytes:
    """A file's bytes, if they are not too many."""
    if len(body) > MAX_BYTES:
        raise TooLarge(f"{len(body)} bytes; {MAX_BYTES} at most")
    return body


def error_response(error: Exception) -> dict:
    """What a service answers: 400 with the wrong fields, 413 for a file too large, 500 for all else."""
    status = 400 if isinstance(error, RequestError) else 413 if isinstance(error, TooLarge) else 500
    return {"status": status, "message": str(error), "field_errors": getattr(error, "fields", {})}


def compile_terms(spark: SparkSession, lexicon: Iterable[dict]) -> DataFrame:
    """Results in the order of the request; position is the expression id, with gaps where terms fail."""
    rows = []
    for i, t in enumerate(lexicon):
        kind = TYPES.get(t.get("term_type"), STANDARD)
        done = compile_term(t.get("term_description"), kind)
        rows.append((i, t.get("term_id"), t.get("term_description"), t.get("risk_driver_name"), kind, *(done[k] for k in ("status", "pattern", "error_log", "translation_error", "flags", "post_filter", "warning"))))
    return spark.createDataFrame(rows, RESULT)


def compile_frame(lexicon: DataFrame) -> DataFrame:
    """The same for a lexicon that is a table itself: position, term_id, term_description, risk_driver_name, term_type."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["term_type"] = [TYPES.get(k, STANDARD) for k in frame["term_type"]]
            done = pd.DataFrame([compile_term(d, k) for d, k in zip(frame["term_description"], frame["term_type"], strict=True)], columns=["status", "pattern", "error_log", "translation_error", "flags", "post_filter", "warning"])
            yield pd.concat([frame.reset_index(drop=True), done], axis=1)

    return lexicon.select("position", "term_id", "term_description", "risk_driver_name", "term_type").mapInPandas(run, RESULT).transform(_by_java)


def _by_java(results: DataFrame) -> DataFrame:
    """results with those FAILED that Java does not compile."""
    bad = (F.col("status") == PASS) & ~java_compiles(_regex())
    error = F.concat(F.lit("Pattern compile error: not a pattern [pattern: "), F.substring("pattern", 1, 100), F.when(F.length("pattern") > 100, "…").otherwise(""), F.lit("]"))
    return results.withColumns({"status": F.when(bad, FAILED).otherwise(F.col("status")), "error_log": F.when(bad, error).otherwise(F.col("error_log")), "post_filter": ~bad & F.col("post_filter")})


def _regex() -> Column:
    """The pattern with its flags, as Java reads it."""
    letters = F.concat(*[F.when(F.col("flags").bitwiseAND(bit) != 0, letter).otherwise("") for bit, letter in ((1, "i"), (2, "s"), (32, "u"), (64, "U"))])
    return F.concat(F.when(letters != "", F.concat(F.lit("(?"), letters, F.lit(")"))).otherwise(""), for_java_column(F.col("pattern")))


def summary(results: DataFrame, rule: Column | str = "rule") -> DataFrame:
    """Counts of a lexicon's results, of each rule if there is such a column."""
    counts = [F.count("*").alias("total_terms"), F.count_if(F.col("status") == PASS).alias("pass_count"), F.count_if(F.col("status") == FAILED).alias("failed_count"), F.bool_or(F.col("status") == FAILED).alias("has_failures")]
    return results.groupBy(*([rule] if isinstance(rule, Column) or rule in results.columns else [])).agg(*counts)


def response(results: DataFrame) -> DataFrame:
    """One row with the summary and all results in order, as a report file holds them."""
    item = F.struct("position", *[c for c in results.columns if c != "position"])
    return results.agg(F.count("*").alias("total_terms"), F.count_if(F.col("status") == PASS).alias("pass_count"), F.count_if(F.col("status") == FAILED).alias("failed_count"), F.array_sort(F.collect_list(item)).alias("results"))


def observed(results: DataFrame) -> tuple[DataFrame, Observation]:
    """results with counters that fill as an action runs: passed and failed, standard and raw terms."""
    seen = Observation("compiled")
    return results.observe(seen, F.count_if(F.col("status") == PASS).alias("passed"), F.count_if(F.col("status") == FAILED).alias("failed"), F.count_if(F.col("term_type") == STANDARD).alias("standard"), F.count_if(F.col("term_type") == RAW).alias("raw")), seen


def pattern_set(results: DataFrame) -> DataFrame:
    """The terms that can be scanned for: id, term_id, term_description, term_type, pattern, flags, post_filter, regex."""
    rows = results.where(F.col("status") == PASS).select(F.col("position").alias("id"), "term_id", "term_description", "term_type", "pattern", "flags", "post_filter")
    return rows.withColumn("regex", _regex())


def database_note(results: DataFrame) -> DataFrame:
    """Whether the terms make a pattern set, and why not."""
    n = F.count_if(F.col("status") == PASS)
    return results.agg((n > 0).alias("has_database"), F.when(n == 0, "No term compiled, so there is no database").alias("note"), n.alias("expressions"))


def flag_bits(names: Column) -> Column:
    """The bitmask of an array of flag names; unknown names count for nothing."""
    bits = F.create_map(*[F.lit(x) for b, n in FLAG_NAMES.items() for x in (n, b)])
    return F.aggregate(names, F.lit(0), lambda acc, n: acc.bitwiseOR(F.coalesce(bits[n], F.lit(0))))


def flag_names(flags: Column) -> Column:
    """The names of a bitmask's flags, unknown bits as UNKNOWN(0x..); of 0 that of no flag."""
    known = [F.when(flags.bitwiseAND(b) != 0, n) for b, n in FLAG_NAMES.items()]
    rest = flags.bitwiseAND(F.lit(~sum(FLAG_NAMES)))
    return F.filter(F.array(F.when(flags == 0, NO_FLAG), *known, F.when(rest != 0, F.concat(F.lit("UNKNOWN(0x"), F.lower(F.hex(rest)), F.lit(")")))), lambda x: x.isNotNull())


def engine(spark: SparkSession) -> DataFrame:
    """One row that says what the engine understands; running it is the health probe."""
    probe = F.lit("price spread").rlike(terms.inline(1) + terms.translate("price OR spread").pattern)
    return spark.range(1).select(F.when(probe, "UP").otherwise("DOWN").alias("status"), F.array(*map(F.lit, ("OR", "AND", "AND NOT", "NOT", "NEAR{n}", "FOLLOWEDBY{n}", "wildcard", "phrase"))).alias("operators"), F.array(*map(F.lit, sorted(SCRIPTS))).alias("scripts"))
