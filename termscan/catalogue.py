"""The registered queries of the scan engine, each with the SQL that has to give the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termscan.functions import matches, scripts
from termscan.functions.predicates import term_match
from termscan.operators import compile as lexicons
from termscan.operators import disclaimers, features, multiscan, report
from termscan.plans import terms

NEAR = "with NEAR{2} by"
_NEAR = r"(?is)(?:with(?:\s+\S+){0,2}\s+by|by(?:\s+\S+){0,2}\s+with)"

QUERIES: dict = {}
_ORACLES: dict[str, str] = {}


def oracles() -> dict[str, str]:
    return dict(_ORACLES)


def _query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            _ORACLES[f.__name__] = oracle
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = multiscan.spread(_docs(spark, sf_dir).select("doc_id", "text"))
    return docs.where(term_match(F.col("text"), NEAR)).select("doc_id")


# one term over documents: name, term, SQL condition

def _m(pattern: str) -> str:
    return f"regexp_matches(coalesce(text, ''), '{pattern}')"


TERMS = {
    "term_single": ("with", _m("(?i)with")),
    "term_phrase": ("of the", _m("(?i)of the")),
    "term_or": ("license OR keit", f"({_m('(?i)license')} OR {_m('(?i)keit')})"),
    "term_wildcard_trail": ("licens*", _m(r"(?i)licens\S*")),
    "term_wildcard_lead": ("*tion", _m(r"(?i)\S*tion")),
    "term_wildcard_embed": ("th*nt", _m(r"(?i)th\S*nt")),
    "term_quoted": ('"Version 2.0"', _m(r"(?i)Version 2\.0")),
    "term_and": ("with AND by", f"{_m('(?i)with')} AND {_m('(?i)by')}"),
    "term_and_not": ("with AND NOT by", f"{_m('(?i)with')} AND NOT {_m('(?i)by')}"),
    "term_not": ("NOT the", f"NOT {_m('(?i)the')}"),
    "term_bang": ("!license", f"NOT {_m('(?i)license')}"),
    "term_nested_bool": ("(with OR from) AND (by OR keit) AND NOT license", f"{_m('(?i)with|from')} AND {_m('(?i)by|keit')} AND NOT {_m('(?i)license')}"),
    "term_and_not_chain": ("with AND NOT by AND from", f"{_m('(?i)with')} AND NOT ({_m('(?i)by')} AND {_m('(?i)from')})"),
    "term_near_0": ("with NEAR{0} by", _m(r"(?is)with\s+by|by\s+with")),
    "term_near_2": (NEAR, _m(_NEAR)),
    "term_near_5": ("with NEAR{5} by", _m(r"(?is)with(?:\s+\S+){0,5}\s+by|by(?:\s+\S+){0,5}\s+with")),
    "term_followedby": ("for FOLLOWEDBY{3} this", _m(r"(?is)for(?:\s+\S+){0,3}\s+this")),
    "term_near_chain": ("with NEAR{3} by NEAR{2} that", _m(r"(?is)with(?:\s+\S+){0,3}\s+(?:by(?:\s+\S+){0,2}\s+that|that(?:\s+\S+){0,2}\s+by)|(?:by(?:\s+\S+){0,2}\s+that|that(?:\s+\S+){0,2}\s+by)(?:\s+\S+){0,3}\s+with")),
    "term_near_or_group": ("(with*) NEAR{5} ((by) OR (from))", _m(r"(?is)with\S*(?:\s+\S+){0,5}\s+(?:by|from)|(?:by|from)(?:\s+\S+){0,5}\s+with\S*")),
    "term_near_logic": ("(with AND from) NEAR{2} by", _m(r"(?is)(?:with|from)(?:\s+\S+){0,2}\s+by|by(?:\s+\S+){0,2}\s+(?:with|from)") + f" AND {_m('(?i)with')} AND {_m('(?i)from')}"),
    "term_unicode": ("über", _m("(?i)über")),
    "term_sharp_s": ("ß", _m("(?i)ß")),
    "term_unicode_near": ("über NEAR{3} der", _m(r"(?is)über(?:\s+\S+){0,3}\s+der|der(?:\s+\S+){0,3}\s+über")),
}

for _name, (_term, _where) in TERMS.items():
    QUERIES[_name] = lambda spark, sf_dir, term=_term: multiscan.spread(_docs(spark, sf_dir).select("doc_id", "text")).where(term_match(F.col("text"), term)).select("doc_id")
    _ORACLES[_name] = f"SELECT doc_id FROM documents WHERE {_where}"

#: Message cases in many scripts: name, term, text, whether it hits.
CASES = [
    ("or", "copper OR zinc", "the Zinc widened", True), ("or_miss", "copper OR zinc", "nothing here", False),
    ("and", "harbour AND bulletin", "an harbour before the bulletin", True), ("and_miss", "harbour AND bulletin", "only an harbour", False),
    ("and_not", "crane* AND NOT footnote", "a craneman", True), ("and_not_miss", "crane* AND NOT footnote", "cranes, footnote below", False),
    ("near_4", "crane NEAR{4} bulletin", "the crane one two three four bulletin", True), ("near_3", "crane NEAR{3} bulletin", "the crane one two three four bulletin", False),
    ("near_back", "crane NEAR{1} bulletin", "bulletin of crane", True), ("followed", "buy FOLLOWEDBY{1} now", "buy it now", True), ("followed_miss", "buy FOLLOWEDBY{1} now", "now buy", False),
    ("lines", "buy FOLLOWEDBY{1} now", "buy\nnow", True), ("korean", "항구 OR 등대지기 불빛", "이것은 등대지기 불빛 입니다", True), ("korean_near", "등대지기 NEAR{3} 불빛", "등대지기의 푸른 불빛", True),
    ("chinese", "灯塔渔船 OR 港口海风", "远处灯塔渔船", True), ("chinese_near", "灯塔 NEAR{2} 渔船", "灯塔海风的渔船", True), ("chinese_far", "灯塔 NEAR{2} 渔船", "灯塔海风海风海风海风海风的渔船", False),
    ("japanese", "カモメの海岸", "これはカモメの海岸です", True), ("arabic_near", "البحر NEAR{2} الميناء", "البحر و الميناء", True), ("hebrew", "נמל הים", "זה נמל הים יפה", True),
    ("german", "Überfahrt OR Leuchtturm", "die überfahrt kommt", True), ("turkish", "gümüş balık", "bu gümüş balık", True), ("emoji", "🐟 OR 🚢", "pst 🚢", True), ("emoji_miss", "🐟 OR 🚢", "pst", False),
    ("leet", "h4rb0ur* OR qu4y*", "an h4rb0urs tip", True), ("mixed_near", "harbour NEAR{3} 등대지기", "harbour tip 등대지기", True), ("quote", "don't FOLLOWEDBY{3} captain", "don't tell the captain", True), ("null_text", "copper", None, False),
]


def _sql(value) -> str:
    return "NULL" if value is None else str(value).upper() if isinstance(value, bool) else "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def _values(rows: list[tuple], columns: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) t({columns})"


@_query(_values([(n, hit) for n, _, _, hit in CASES], "name, hit"))
def term_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every case's term over its own text."""
    rows = spark.createDataFrame([(n, t) for n, _, t, _ in CASES], "name string, text string")
    hit = reduce(lambda c, x: c.when(F.col("name") == x[0], term_match(F.col("text"), x[1])), CASES[1:], F.when(F.col("name") == CASES[0][0], term_match(F.col("text"), CASES[0][1])))
    return rows.select("name", hit.alias("hit"))


SCRIPT_CASES = [
    ("hello", "LATIN"), (None, "LATIN"), ("  ", "LATIN"), ("12345", "LATIN"), ("🚢", "LATIN"), ("привет", "LATIN"), ("البحر", "ARABIC"), ("נמל", "HEBREW"), ("नमस्ते", "DEVANAGARI"), ("灯塔", "CJK"),
    ("カタカナ", "KANA"), ("등대지기", "HANGUL"), ("สวัสดี", "THAI"), ("カモメの海岸", "MIXED_CJK"), ("harbour 등대지기", "MIXED_CJK"), ("copper البحر", "MIXED_RTL"), ("البحر נמל", "MIXED"), ("hello नमस्ते", "MIXED"),
]


@_query(_values([(i, s) for i, (_, s) in enumerate(SCRIPT_CASES)], "id, script"))
def script_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SCRIPT_CASES)], "id int, text string")
    return rows.select("id", scripts.script_type(F.col("text")).alias("script"))


@_query(r"""
SELECT CASE WHEN NOT regexp_matches(t, '[\p{L}]') THEN 'LATIN' WHEN regexp_matches(t, '[\p{Han}\p{Hangul}\p{Hiragana}\p{Katakana}\p{Thai}]') THEN 'MIXED_CJK'
  WHEN regexp_matches(t, '[\p{Arabic}\p{Hebrew}]') THEN 'MIXED_RTL' ELSE 'LATIN' END AS script, count(*) AS n
FROM (SELECT coalesce(text, '') AS t FROM documents) GROUP BY 1""")
def script_detect_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = multiscan.spread(_docs(spark, sf_dir).select("text"))
    return docs.groupBy(scripts.script_type(F.col("text")).alias("script")).agg(F.count("*").alias("n"))


#: Words of many scripts that are put in front of documents in turn.
_FOREIGN = ["", "港口", "カモメ", "등대", "ท่าเรือ", "ميناء", "נמל", "ޖަހާޒު", "बंदरगाह", "порт", "ひかり 港", "등대 ميناء", "ميناء נמל", "บ้าน बंदरगाह", "\u200d\u0301", "ဆိပ်", "བོད"]
_HAS = {c: "regexp_matches(shown, '[" + "".join(f"\\p{{{s}}}" for s in names) + "]')" for c, names in scripts.CATEGORIES.items()}


def _none_but(*own: str) -> str:
    return "NOT (" + " OR ".join(c.lower() for c in _HAS if c not in own) + ")"


@_query(rf"""
SELECT doc_id, CASE WHEN {_none_but()} THEN 'LATIN' WHEN {_none_but('CJK')} THEN 'CJK' WHEN {_none_but('KANA')} THEN 'KANA' WHEN {_none_but('HANGUL')} THEN 'HANGUL' WHEN {_none_but('THAI')} THEN 'THAI'
  WHEN {_none_but('ARABIC', 'OTHER_RTL')} THEN 'ARABIC' WHEN {_none_but('HEBREW')} THEN 'HEBREW' WHEN {_none_but('INDIC')} THEN 'DEVANAGARI' WHEN {_none_but('LATIN')} THEN 'LATIN'
  WHEN cjk OR kana OR hangul OR thai THEN 'MIXED_CJK' WHEN (arabic OR hebrew OR other_rtl) AND (latin OR indic) THEN 'MIXED_RTL' ELSE 'MIXED' END AS script
FROM (SELECT doc_id, {', '.join(f'{has} AS {c.lower()}' for c, has in _HAS.items())}
  FROM (SELECT doc_id, regexp_replace(list_extract([{', '.join("'" + w + "'" for w in _FOREIGN)}], CAST(doc_id % {len(_FOREIGN)} AS INT) + 1) || CASE WHEN doc_id % 3 = 0 THEN ' 12' ELSE ' ' || coalesce(text, '') END, '[\x{{200C}}-\x{{200F}}\x{{FEFF}}\p{{Mn}}\p{{Mc}}]', '', 'g') AS shown FROM documents))""")
def script_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script types of documents behind a word of another script; a third of them keep that word alone."""
    word = F.element_at(F.array(*map(F.lit, _FOREIGN)), (F.col("doc_id") % len(_FOREIGN)).cast("int") + 1)
    text = F.concat(word, F.when(F.col("doc_id") % 3 == 0, " 12").otherwise(F.concat(F.lit(" "), F.coalesce("text", F.lit("")))))
    return multiscan.spread(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", scripts.script_type(text).alias("script"))


@_query(r"SELECT doc_id, regexp_matches(coalesce(text, ''), '[^\x00-\x7F]') AS non_ascii, regexp_matches(coalesce(text, ''), '[\x{2600}-\x{27BF}\x{FE00}-\x{FE0F}\x{1F100}-\x{1F1FF}\x{1F300}-\x{1F64F}\x{1F680}-\x{1F8FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FAFF}]') AS emoji FROM documents")
def character_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiscan.spread(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", scripts.has_non_ascii(F.col("text")).alias("non_ascii"), scripts.has_emoji(F.col("text")).alias("emoji"))


#: A lexicon and its verdicts: id, term, type, status, pattern, flags, post filter.
GOLDEN = [
    ("t1", "(juggle*) NEAR{5} ((copper) OR (zinc) OR (nickel))", "Standard", "PASS", r"(?:juggle\S*(?:\s+\S+){0,5}\s+(?:copper|zinc|nickel)|(?:copper|zinc|nickel)(?:\s+\S+){0,5}\s+juggle\S*)", 3, False),
    ("t2", "harbour AND before AND bulletin", "Standard", "PASS", "(?:harbour|before|bulletin)", 3, True),
    ("t3", "crane* AND NOT footnote", "Standard", "PASS", r"crane\S*", 3, True), ("t4", "NOT kelp", "Standard", "PASS", "kelp", 3, True), ("t5", "copper OR zinc", "Standard", "PASS", "(?:copper|zinc)", 1, False),
    ("t6", "🐟 OR 🚢", "Standard", "PASS", r"(?:\x{1F41F}|\x{1F6A2})", 97, False), ("t7", "등대지기 NEAR{3} 불빛", "Standard", "PASS", r"(?:등대지기[\s\S]{0,18}불빛|불빛[\s\S]{0,18}등대지기)", 99, False),
    ("t8", "[unclosed", "Standard", "FAILED", None, 0, False), ("t9", "NEAR{5} (copper)", "Standard", "FAILED", None, 0, False), ("t10", "()", "Standard", "FAILED", "", 1, False), ("t11", "**", "Standard", "FAILED", r"\S*\S*", 1, False),
    ("t12", r"\binsid(er|e)\b", "NLT", "PASS", r"\binsid(er|e)\b", 3, False), ("t13", "(?=.*a).*", "NLT", "FAILED", "(?=.*a).*", 3, False), ("t14", "(unclosed", "NLT", "FAILED", "(unclosed", 3, False), ("t15", "(unclosed", "Standard", "PASS", r"\(unclosed", 1, False),
    ("t16", "   ", "Standard", "FAILED", None, 0, False), ("t17", "*", "Standard", "PASS", r"\S+", 1, False), ("t18", "Straße AND x", "Standard", "PASS", "(?:Straße|x)", 99, True),
]


def _compiled(spark: SparkSession) -> DataFrame:
    return lexicons.compile_terms(spark, [{"term_id": g[0], "term_description": g[1], "term_type": g[2]} for g in GOLDEN])


@_query(_values([(g[0], *g[3:]) for g in GOLDEN], "term_id, status, pattern, flags, post_filter"))
def compile_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compiled(spark).select("term_id", "status", "pattern", "flags", "post_filter")


_PASSED = sum(g[3] == "PASS" for g in GOLDEN)


@_query(f"SELECT CAST({len(GOLDEN)} AS BIGINT) AS total_terms, CAST({_PASSED} AS BIGINT) AS pass_count, CAST({len(GOLDEN) - _PASSED} AS BIGINT) AS failed_count, TRUE AS has_failures")
def compile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicons.summary(_compiled(spark))


@_query(_values([(g[0], g[4] is None, g[4] is not None) for g in GOLDEN if g[3] == "FAILED"], "term_id, in_translation, in_pattern"))
def compile_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compiled(spark).where("status = 'FAILED'").select("term_id", F.col("translation_error").isNotNull().alias("in_translation"), F.col("error_log").isNotNull().alias("in_pattern"))


@_query(_values([(i, g[0]) for i, g in enumerate(GOLDEN) if g[3] == "PASS"], "id, term_id"))
def pattern_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicons.pattern_set(_compiled(spark)).select("id", "term_id")


@_query(_values([("0", "NO_FLAG"), ("1", "CASELESS"), ("3", "CASELESS,DOTALL"), ("97", "CASELESS,UTF8,UCP"), ("2049", "CASELESS,UNKNOWN(0x800)")], "bits, names"))
def flag_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(0,), (1,), (3,), (97,), (2049,)], "flags int")
    return rows.select(F.col("flags").cast("string").alias("bits"), F.array_join(lexicons.flag_names(F.col("flags")), ",").alias("names"))


CSV = '﻿Term ID,Term Description,Risk Driver Name\n1,copper OR zinc,R1\n\n# a comment,x,y\n2,  """quoted"" phrase",\n3,"with, comma",R3\nonlyone\n4,two cells\n,,\n'


@_query(_values([("1", "copper OR zinc", "R1"), ("2", '"quoted" phrase', None), ("3", "with, comma", "R3"), ("4", "two cells", None)], "term_id, term_description, risk_driver_name"))
def lexicon_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termscan.sources.lexicons import read_csv
    from termscan.sources.shared import put_text

    return read_csv(spark, put_text(spark, "lexicon-csv", CSV), "rule").select("term_id", "term_description", "risk_driver_name")


# matches

_PARTS = f"SELECT doc_id, string_split_regex(regexp_replace(coalesce(text, ''), '{_NEAR}', chr(1) || '\\0' || chr(2), 'g'), '[\\x01\\x02]') AS p FROM documents"
_FOUND = f"SELECT doc_id, p[i] AS match_text, length(array_to_string(p[1:i-1], '')) AS s, strlen(array_to_string(p[1:i-1], '')) AS b, i FROM (SELECT doc_id, p, unnest(generate_series(2, len(p), 2)) AS i FROM ({_PARTS}))"


def _near_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = multiscan.spread(_docs(spark, sf_dir).select("doc_id", "text"))
    return multiscan.positions(docs, "text", [("near", NEAR)]).drop("text")


@_query(f"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '{_NEAR}')) AS BIGINT) AS n FROM documents")
def match_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = terms.translate(NEAR)
    return multiscan.spread(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", matches.match_count(F.col("text"), terms.inline(t.flags) + t.pattern).alias("n"))


@_query(f"SELECT doc_id, match_text, CAST(s AS INT) AS start_char, CAST(s + length(match_text) AS INT) AS end_char FROM ({_FOUND})")
def match_positions_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near_matches(spark, sf_dir).select("doc_id", "match_text", F.col("start").alias("start_char"), F.col("end").alias("end_char"))


@_query(f"SELECT doc_id, CAST(b AS INT) AS start_byte, CAST(b + strlen(match_text) - 1 AS INT) AS end_byte FROM ({_FOUND})")
def match_positions_byte(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near_matches(spark, sf_dir).select("doc_id", F.col("byte_start").alias("start_byte"), F.col("byte_end").alias("end_byte"))


@_query(f"SELECT doc_id, CAST(s AS INT) AS start_char, CAST(coalesce(s - lag(s + length(match_text)) OVER (PARTITION BY doc_id ORDER BY i), 0) AS INT) AS delta FROM ({_FOUND})")
def match_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches.with_delta(_near_matches(spark, sf_dir), ["doc_id"], ["start", "term_id"]).select("doc_id", F.col("start").alias("start_char"), "delta")


@_query(f"SELECT doc_id, replace(replace(array_to_string(list_transform(p, lambda x, i: CASE WHEN i % 2 = 0 THEN chr(1) || x || chr(2) ELSE x END), ''), chr(1), '<mark class=\"lex-match\">'), chr(2), '</mark>') AS html FROM (SELECT doc_id, list_transform(p, lambda x: replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS p FROM ({_PARTS}))")
def highlighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = terms.translate(NEAR)
    return multiscan.spread(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", matches.highlighted(F.col("text"), terms.inline(t.flags) + t.pattern).alias("html"))


# lexicons over tables

LEXICON = [("near", NEAR), ("license", "licens*"), ("both", "with AND from"), ("umlaut", "über"), ("but", "for AND NOT the")]
_CONDITIONS = {"near": _m(_NEAR), "license": _m(r"(?i)licens\S*"), "both": f"{_m('(?i)with')} AND {_m('(?i)from')}", "umlaut": _m("(?i)über"), "but": f"{_m('(?i)for')} AND NOT {_m('(?i)the')}"}


def _hits_sql(table: str, columns: str) -> str:
    return " UNION ALL ".join(f"SELECT {columns}, '{i}' AS term_id FROM {table} WHERE {w}" for i, w in _CONDITIONS.items())


def _hits(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return multiscan.scan(multiscan.spread(_docs(spark, sf_dir).select(*columns, "text")), "text", LEXICON).drop("text")


@_query(_hits_sql("documents", "doc_id"))
def multi_term_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, "doc_id")


@_query(f"SELECT term_id, count(*) AS docs FROM ({_hits_sql('documents', 'doc_id')}) GROUP BY term_id")
def docs_per_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, "doc_id").groupBy("term_id").agg(F.count("*").alias("docs"))


@_query(f"SELECT lang, term_id, count(*) AS n FROM ({_hits_sql('documents', 'lang')}) GROUP BY ALL")
def hits_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, "lang").groupBy("lang", "term_id").agg(F.count("*").alias("n"))


@_query(f"SELECT source, count(*) AS n FROM ({_hits_sql('documents', 'source')}) GROUP BY ALL")
def hits_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, "source").groupBy("source").agg(F.count("*").alias("n"))


@_query(f"SELECT term_id, toxic, count(*) AS n FROM ({_hits_sql('documents', 'doc_id')}) JOIN labels USING (doc_id) GROUP BY ALL")
def hits_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, "doc_id").join(_docs(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id").groupBy("term_id", "toxic").agg(F.count("*").alias("n"))


_WORDS = [("near", NEAR), ("license", "licens*"), ("umlaut", "über")]


@_query(f"SELECT doc_id FROM documents WHERE {_CONDITIONS['near']} OR {_CONDITIONS['license']} OR {_CONDITIONS['umlaut']}")
def combined_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiscan.prefilter(multiscan.spread(_docs(spark, sf_dir).select("doc_id", "text")), "text", _WORDS).select("doc_id")


@_query(" UNION ALL ".join(f"SELECT doc_id, {k} AS id FROM documents WHERE {_CONDITIONS[i]}" for k, (i, _) in enumerate(_WORDS)))
def pattern_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = lexicons.pattern_set(lexicons.compile_terms(spark, [{"term_id": i, "term_description": t} for i, t in _WORDS]))
    return multiscan.scan_patterns(multiscan.spread(_docs(spark, sf_dir).select("doc_id", "text")), "text", patterns).select("doc_id", "id")


@_query(_hits_sql("conversations", "conv_id, turn"))
def conversations_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiscan.scan(multiscan.spread(_docs(spark, sf_dir, "conversations").select("conv_id", "turn", "text")), "text", LEXICON).drop("text")


_PAGE = r"trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


@_query(f"SELECT page_id FROM (SELECT page_id, {_PAGE} AS text FROM pages) WHERE {_m(_NEAR)}")
def pages_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _docs(spark, sf_dir, "pages").select("page_id", disclaimers.normalised(F.col("html")).alias("text"))
    return multiscan.spread(pages).where(term_match(F.col("text"), NEAR)).select("page_id")


@_query("SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(?i)ring|widg\\S*') AND NOT regexp_matches(p_name, '(?i)red')")
def part_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "part").where(term_match(F.col("p_name"), "(ring OR widg*) AND NOT red")).select("p_partkey")


@_query(" UNION ALL ".join(f"SELECT doc_id, {k} AS id FROM documents WHERE {w}" for k, w in enumerate([*_CONDITIONS.values(), f"NOT {_m('(?i)the')}", _m(r"(?i)\bthe\w+\b")])))
def logic_pattern_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern set with logic in it: terms are evaluated, not their relaxed patterns."""
    lexicon = [{"term_id": i, "term_description": t} for i, t in [*LEXICON, ("not", "NOT the")]] + [{"term_id": "raw", "term_description": r"(?<i_d>\bthe\w+\b)", "term_type": "REGEX"}]
    patterns = lexicons.pattern_set(lexicons.compile_terms(spark, lexicon))
    return multiscan.scan_patterns(multiscan.spread(_docs(spark, sf_dir).select("doc_id", "text")), "text", patterns).select("doc_id", "id")


_FREQUENT = "the and of to with for this that from by in is der die und le la de el en".split()


def _pairs_of(n: int) -> list[tuple[str, str, str]]:
    pairs = [(a, b) for i, a in enumerate(_FREQUENT) for b in _FREQUENT[i + 1 :] + _FREQUENT[:i]]
    return [(f"{a}-{b}", f"{a} NEAR{{3}} {b}", _m(rf"(?is)(?:{a}(?:\s+\S+){{0,3}}\s+{b}|{b}(?:\s+\S+){{0,3}}\s+{a})")) for a, b in pairs[:n]]


def _lexicon_counts(n: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        hits = multiscan.scan(multiscan.spread(_docs(spark, sf_dir).select("doc_id", "text")), "text", [x[:2] for x in _pairs_of(n)])
        return hits.groupBy("term_id").agg(F.count("*").alias("docs"))

    return run


for _n in (10, 50, 200):
    QUERIES[f"lexicon_{_n}"] = _lexicon_counts(_n)
    _ORACLES[f"lexicon_{_n}"] = "SELECT term_id, count(*) AS docs FROM (" + " UNION ALL ".join(f"SELECT '{i}' AS term_id FROM documents WHERE {w}" for i, _, w in _pairs_of(_n)) + ") GROUP BY term_id"


_MARKED = r"'a' || chr(1) || coalesce(text, '') || chr(2) || ' with' || chr(1) || chr(10) || 'by'"


@_query(f"SELECT doc_id, match_text, CAST(s AS INT) AS start_char, CAST(b AS INT) AS start_byte FROM ({_FOUND})".replace("chr(1)", "chr(5)").replace("chr(2)", "chr(6)").replace("\\x01\\x02", "\\x05\\x06").replace("coalesce(text, '')", f"({_MARKED})"))
def control_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions in documents that hold control characters."""
    text = F.concat(F.lit("a\x01"), F.coalesce("text", F.lit("")), F.lit("\x02 with\x01\nby"))
    found = multiscan.positions(multiscan.spread(_docs(spark, sf_dir).select("doc_id", "text")).withColumn("text", text), "text", [("near", NEAR)])
    return found.select("doc_id", "match_text", F.col("start").alias("start_char"), F.col("byte_start").alias("start_byte"))


# features, noise and audits

_NOISE = [("m1", 0, "OR", True, True), ("m1", 1, None, True, False), ("m1", 2, None, False, True), ("m2", 0, "OR", True, False), ("m2", 1, "OR", False, True), ("m3", 0, "AND", True, True), ("m3", 1, "AND", True, False), ("m3", 2, "AND", False, True),
          ("m4", 0, "AND", True, True), ("m4", 1, "AND", True, True), ("m4", 2, "AND", False, False), ("m5", 0, None, True, True), ("m5", 1, None, False, True), ("m6", 0, None, False, True), ("m7", 0, None, True, True), ("m7", 1, "OR", False, True)]


def _noise(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(_NOISE, "message_id string, position int, feature_op string, is_noise_reduction boolean, matched boolean")
    return rows.withColumn("feature_name", F.concat(F.lit("f"), F.col("position").cast("string")))


@_query(_values([("m1", True), ("m2", False), ("m3", False), ("m4", True), ("m5", False), ("m6", False), ("m7", True)], "message_id, skipped"))
def noise_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.noise_decision(_noise(spark)).select("message_id", "skipped")


@_query(_values([("m1", "f0", "NOISE_REDUCTION"), ("m2", "f1", "STANDARD"), ("m3", "f2", "STANDARD"), ("m4", "f0", "NOISE_REDUCTION"), ("m4", "f1", "NOISE_REDUCTION"), ("m5", "f1", "STANDARD"), ("m6", "f0", "STANDARD"), ("m7", "f0", "NOISE_REDUCTION")], "message_id, feature_name, hit_type"))
def decided_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.decided_hits(_noise(spark))


@_query(_values([("p1", "m1", "OR", False, "copper", "copper OR zinc"), ("p1", "m1", "AND", True, "kelp", "kelp*"), ("p1", "m2", None, False, "tip", "tip*")], "process_id, message_id, feature_op, is_noise_reduction, feature_name, definition"))
def feature_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = spark.createDataFrame(
        [("p1", "m1", [("lexicon", "1", "copper", "OR", None, None), ("Composite", "2", "noise", "AND", True, [("kelp", "lexicon"), ("model", "ml")]), ("ml", "3", "other", None, None, None)]), ("p1", "m2", [("lexicon", "4", "tip", None, False, [])]), ("p1", "m3", []), ("p9", "m4", [("lexicon", "1", "copper", "OR", None, None)])],
        "process_id string, message_id string, features array<struct<type: string, id: string, name: string, feature_op: string, is_noise_reduction: boolean, sub_feature: array<struct<name: string, type: string>>>>",
    )
    master = spark.createDataFrame(
        [("p1", "copper", "lexicon", "copper OR zinc", None), ("p1", "tip", "lexicon", "tip*", None), ("p1", "noise", "Composite", None, [("kelp", "lexicon", "kelp*"), ("model", "ml", "x")]), ("p2", "copper", "lexicon", "other", None)],
        "policy_engine_id string, feature_name string, feature_type string, feature_definition string, sub_features array<struct<name: string, type: string, definition: string>>",
    )
    return features.feature_view(decisions, master)


_CONV = f"SELECT conv_id, term_id FROM ({_hits_sql('conversations', 'conv_id, turn')})"


@_query(f"SELECT CAST(conv_id AS VARCHAR) AS message_id, string_agg(DISTINCT term_id, ',' ORDER BY term_id) AS lexicon_terms, count(DISTINCT term_id) AS hit_count_of_terms, CAST({len(LEXICON)} AS BIGINT) AS total_count_of_terms FROM ({_CONV}) GROUP BY conv_id")
def hit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = conversations_scan(spark, sf_dir).select(F.col("conv_id").cast("string").alias("message_id"), "term_id")
    return features.hit_summary(hits, len(LEXICON), ["message_id"])


_DETAILED = [("license", r"(?i)licens\S*"), ("near", _NEAR)]


def _turn_matches(i: str, pattern: str) -> str:
    parts = f"SELECT conv_id, turn, string_split_regex(regexp_replace(coalesce(text, ''), '{pattern}', chr(1) || '\\0' || chr(2), 'g'), '[\\x01\\x02]') AS p FROM conversations"
    return f"SELECT conv_id, turn, '{i}' AS term_id, p[i] AS match_text, length(array_to_string(p[1:i-1], '')) AS s, strlen(array_to_string(p[1:i-1], '')) AS b FROM (SELECT *, unnest(generate_series(2, len(p), 2)) AS i FROM ({parts}))"


_DETAILS = f"""SELECT conv_id AS message_id, 'attachment-' || turn AS part, term_id, match_text, b AS start_index, b + strlen(match_text) - 1 AS end_index,
  coalesce(s - lag(s + length(match_text)) OVER (PARTITION BY conv_id, turn ORDER BY s, term_id), 0) AS delta FROM ({' UNION ALL '.join(_turn_matches(*x) for x in _DETAILED)})"""


def _details(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = multiscan.spread(_docs(spark, sf_dir, "conversations")).select(F.col("conv_id").alias("message_id"), F.concat(F.lit("attachment-"), F.col("turn").cast("string")).alias("part"), "text")
    found = multiscan.positions(turns, "text", [("near", NEAR), ("license", "licens*")]).drop("text")
    return features.hit_details(matches.with_delta(found, ["message_id", "part"], ["start", "term_id"]))


@_query(f"SELECT message_id, count(*) AS matches, min(start_index) AS first_start, sum(delta) AS deltas, string_agg(part || ':' || term_id || ':' || match_text, chr(10) ORDER BY part, start_index, end_index, term_id) AS listed FROM ({_DETAILS}) GROUP BY message_id")
def hit_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON read back: matches by part, in order."""
    kind = "map<string, struct<matches: array<struct<term_id: string, match_text: string, start_index: long, end_index: long, delta: long>>>>"
    parts = _details(spark, sf_dir).select("message_id", F.explode(F.from_json("hit_details", kind)).alias("part", "x"))
    each = parts.select("message_id", "part", F.explode("x.matches").alias("m")).select("message_id", "part", "m.*")
    line = F.struct("part", "start_index", "end_index", "term_id", F.concat_ws(":", "part", "term_id", "match_text").alias("line"))
    return each.groupBy("message_id").agg(F.count("*").alias("matches"), F.min("start_index").alias("first_start"), F.sum("delta").cast("decimal(38,0)").alias("deltas"), F.array_join(F.array_sort(F.collect_list(line))["line"], "\n").alias("listed")).withColumn("deltas", F.col("deltas").cast("long"))


@_query("SELECT doc_id AS message_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def wanted_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _docs(spark, sf_dir).select(F.col("doc_id").alias("message_id"), "text")
    return features.wanted_messages(messages, _labelled(spark, sf_dir).where("feature_name = 'toxic'")).select("message_id")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.array(*[F.struct(F.lit(c).alias("feature_name"), F.col(c).alias("on")) for c in ("toxic", "quality")])
    rows = _docs(spark, sf_dir, "labels").select(F.col("doc_id").alias("message_id"), F.explode(F.filter(marks, lambda m: m["on"] == 1)).alias("m"))
    return rows.select("message_id", "m.feature_name", F.lit("OR").alias("feature_op"), (F.col("m.feature_name") == "quality").alias("is_noise_reduction"))


@_query("SELECT d.doc_id AS message_id, d.n_chars, concat_ws(',', CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END) AS names FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1 OR toxic = 1")
def featured_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _docs(spark, sf_dir).select(F.col("doc_id").alias("message_id"), "n_chars")
    return features.featured_messages(messages, _labelled(spark, sf_dir)).select("message_id", "n_chars", F.array_join("features.feature_name", ",").alias("names"))


@_query("SELECT doc_id, lang FROM documents WHERE lang = 'fr'")
def message_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run of messages that were written by run; other runs' folders are not read."""
    from termscan.sources.messages import read_messages
    from termscan.sources.shared import new_folder

    path = new_folder(spark, "runs")
    _docs(spark, sf_dir).select("doc_id", F.col("lang").alias("RUN_DATE"), F.lit("e1").alias("PIPELINE_EXEC_ID")).write.partitionBy("RUN_DATE", "PIPELINE_EXEC_ID").parquet(path)
    return read_messages(spark, path, "fr", "e1").select("doc_id", F.col("RUN_DATE").alias("lang"))


def _conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir, "conversations")
    return rows.groupBy(F.col("conv_id").alias("message_id")).agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("body"), F.sort_array(F.collect_list(F.when(F.col("turn") > 0, F.col("text")))).alias("attachments"))


@_query("SELECT conv_id AS message_id, count(*) AS parts, sum(length(text)) AS chars FROM (SELECT conv_id, text FROM conversations WHERE turn > 0 AND text IS NOT NULL UNION ALL SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) FROM conversations GROUP BY conv_id) GROUP BY conv_id")
def message_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.parts(_conversation_messages(spark, sf_dir)).groupBy("message_id").agg(F.count("*").alias("parts"), F.sum(F.length("text")).cast("decimal(38,0)").cast("long").alias("chars"))


_STATUS = "CASE WHEN b IS NULL THEN 'FAILED' WHEN regexp_matches(b, '(?i)licens') THEN 'SKIPPED' ELSE 'PROCESSED' END"
_BODIES = "SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS b FROM conversations GROUP BY conv_id"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _conversation_messages(spark, sf_dir)
    decisions = messages.select("message_id", term_match(F.col("body"), "licens*").alias("skipped"))
    hits = multiscan.scan(messages.select("message_id", F.col("body").alias("text")), "text", [("with", "with"), ("by", "by")])
    return features.record_audit(messages, decisions, hits)


@_query(f"SELECT conv_id AS message_id, {_STATUS} AS status, CAST(coalesce(regexp_matches(b, '(?i)with'), FALSE) AS BIGINT) + CAST(coalesce(regexp_matches(b, '(?i)by'), FALSE) AS BIGINT) AS n_hits FROM ({_BODIES})")
def record_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).withColumn("n_hits", F.col("n_hits").cast("long"))


@_query(f"SELECT 'scan' AS stage, count(*) AS records, count(*) FILTER (b IS NULL) AS failed, CASE WHEN count(*) FILTER (b IS NULL) = 0 THEN 'SUCCESS' WHEN count(*) FILTER (b IS NULL) < count(*) THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM ({_BODIES})")
def stage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.stage_audit(_records(spark, sf_dir), "scan")


# disclaimers and reports

DISCLAIMERS = ["Licensed under the Apache License, Version 2.0."]
_DISCLAIMED = "(SELECT doc_id, coalesce(text, '') AS text FROM documents)"


def _licensed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of two terms in documents, each with whether a disclaimer holds it."""
    docs = multiscan.spread(_docs(spark, sf_dir).select("doc_id", "text")).withColumn("spans", disclaimers.spans(F.col("text"), DISCLAIMERS))
    found = multiscan.positions(docs, "text", [("license", "license"), ("that", "that ed*")])
    inside = disclaimers.in_disclaimer(F.col("start"), F.col("end"), F.col("spans"))
    return found.select(F.col("doc_id").alias("message_id"), "term_id", "match_text", "start", "end", inside.alias("in_disclaimer"))


def _term_sql(i: str, pattern: str) -> str:
    parts = f"string_split_regex(regexp_replace(text, '{pattern}', chr(1) || '\\0' || chr(2), 'g'), '[\\x01\\x02]')"
    gone = "string_split_regex(regexp_replace(text, 'Licensed under the Apache License, Version 2\\.0\\.', chr(1) || '\\0' || chr(2), 'g'), '[\\x01\\x02]')"
    spans = "list_transform(generate_series(2, len(g), 2), lambda j: {'a': length(array_to_string(g[1:j-1], '')), 'z': length(array_to_string(g[1:j], ''))})"
    return f"""SELECT doc_id AS message_id, '{i}' AS term_id, match_text, CAST(s AS INT) AS start, CAST(s + length(match_text) AS INT) AS "end",
      len(list_filter(spans, lambda x: x.a <= s AND s + length(match_text) <= x.z)) > 0 AS in_disclaimer
    FROM (SELECT doc_id, p[i] AS match_text, length(array_to_string(p[1:i-1], '')) AS s, {spans} AS spans
      FROM (SELECT doc_id, p, g, unnest(generate_series(2, len(p), 2)) AS i FROM (SELECT doc_id, {parts} AS p, {gone} AS g FROM {_DISCLAIMED})))"""


_LICENSED = _term_sql("license", "(?i)license") + " UNION ALL " + _term_sql("that", r"(?i)that ed\S*")


@_query(_LICENSED)
def alert_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _licensed(spark, sf_dir)


@_query(f"SELECT message_id, count(*) AS total_matches, count(*) FILTER (NOT in_disclaimer) AS alert_matches FROM ({_LICENSED}) GROUP BY message_id")
def message_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.message_totals(_licensed(spark, sf_dir))


_PAIRS = "SELECT doc_id AS message_id, t.term_id, t.failed, t.post_filter FROM documents, (VALUES ('license', FALSE, FALSE), ('that', FALSE, TRUE), ('bad', TRUE, FALSE)) t(term_id, failed, post_filter)"
_STATES = f"""SELECT p.message_id, p.term_id, CASE WHEN failed THEN 'FAILED' WHEN alone THEN 'DISCLAIMER ONLY' WHEN n IS NULL THEN 'NO HIT' WHEN post_filter THEN 'AND MATCH' ELSE 'MATCHED' END AS term_state, coalesce(n, 0) AS matches
FROM ({_PAIRS}) p LEFT JOIN (SELECT message_id, term_id, count(*) AS n, bool_and(in_disclaimer) AS alone FROM ({_LICENSED}) GROUP BY ALL) h ON p.message_id = h.message_id AND p.term_id = h.term_id"""


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = [("license", False, False), ("that", False, True), ("bad", True, False)]
    each = F.array(*[F.struct(F.lit(i).alias("term_id"), F.lit(failed).alias("failed"), F.lit(post).alias("post_filter")) for i, failed, post in lexicon])
    pairs = _docs(spark, sf_dir).select(F.col("doc_id").alias("message_id"), F.explode(each).alias("t")).select("message_id", "t.*")
    return report.term_states(pairs, _licensed(spark, sf_dir))


@_query(_STATES)
def term_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir)


@_query(f"""SELECT s.message_id, s.term_id, term_state, match_text, h.start, h."end", in_disclaimer, coalesce(NOT in_disclaimer, FALSE) AS alert
FROM ({_STATES}) s LEFT JOIN ({_LICENSED}) h ON s.message_id = h.message_id AND s.term_id = h.term_id""")
def scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.scan_report(_states(spark, sf_dir), _licensed(spark, sf_dir))


@_query(f"SELECT count(DISTINCT message_id) AS total_messages, count(DISTINCT term_id) AS total_terms, count(DISTINCT CASE WHEN matches > 0 THEN term_id END) AS matched_terms, count(DISTINCT CASE WHEN term_state = 'FAILED' THEN term_id END) AS failed_terms FROM ({_STATES})")
def scan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.scan_totals(_states(spark, sf_dir))


@_query(f"SELECT message_id, term_id, term_state, matches FROM ({_STATES}) WHERE matches > 0 AND term_state <> 'FAILED'")
def matched_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States without a row for every message and term."""
    lexicon = spark.createDataFrame([("license", False, False), ("that", False, True), ("bad", True, False)], "term_id string, failed boolean, post_filter boolean")
    return report.matched_states(lexicon, _licensed(spark, sf_dir))


@_query(f"SELECT s.message_id, s.term_id, match_text, h.start FROM ({_STATES}) s LEFT JOIN ({_LICENSED}) h ON s.message_id = h.message_id AND s.term_id = h.term_id")
def report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report written as CSV and read back."""
    from termscan.sources.shared import new_folder

    path = new_folder(spark, "report")
    report.write_csv(scan_report(spark, sf_dir), path)
    rows = spark.read.csv(path, header=True, escape='"', multiLine=True)
    return rows.select(F.col(rows.columns[0]).cast("long").alias("message_id"), "term_id", "match_text", F.col("start").cast("int").alias("start"))


_LISTED = 'Disclaimer_Text,ID\n"Sent by the ""harbour"" office,\nno reply",h1\n,h2\n  plain words  ,h3\n'


@_query(_values([("h1", 'Sent by the "harbour" office,\nno reply'), ("h3", "plain words")], "disclaimer_id, disclaimer_text"))
def disclaimers_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    from termscan.sources.shared import put_text

    return disclaimers.read_csv(spark, put_text(spark, "disclaimers", _LISTED))


@_query(_values([("1", "first part\nof two lines"), ("2", "second")], "disclaimer_id, disclaimer_text"))
def disclaimers_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclaimers.from_text(spark, "first part\nof two lines\n  \nsecond")


_TYPED = [("a", "copper OR zinc", "NATURAL_LANGUAGE", "PASS", "(?:copper|zinc)"), ("b", "copper OR zinc", "REGEX", "PASS", "copper OR zinc"), ("c", "{broken}", "NLT", "PASS", "{broken}"), ("d", "(?P<x_1>a)b{,3}", "REGEX", "PASS", "(?P<x_1>a)b{,3}"),
          ("e", "[a", "REGEX", "FAILED", "[a"), ("f", r"a\Q(", "REGEX", "FAILED", r"a\Q("), ("g", "x{2}{3}", "REGEX", "FAILED", "x{2}{3}")]


@_query(_values([(t[0], t[3], t[4]) for t in _TYPED], "term_id, status, pattern"))
def term_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicons.compile_terms(spark, lexicons.checked([{"term_id": i, "term_description": d, "term_type": k} for i, d, k, _, _ in _TYPED])).select("term_id", "status", "pattern")


@_query("SELECT 'UP' AS status")
def engine_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicons.engine(spark).select("status")
