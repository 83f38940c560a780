import random

import pytest
import regex
from pyspark.sql import functions as F

from termscan.functions import matches, scripts
from termscan.functions.predicates import term_match, tree_match
from termscan.operators import compile as lexicons
from termscan.operators import multiscan
from termscan.plans import terms
from termscan.plans.validate import problem

GOLDEN = [
    ("copper OR zinc", "(?:copper|zinc)", 1, False),
    ("((copper) OR (zinc) OR (nickel))", "(?:copper|zinc|nickel)", 1, False),
    ("harbour AND bulletin", "(?:harbour|bulletin)", 3, True),
    ("harbour AND NOT footnote", "harbour", 3, True),
    ("!kelp", "kelp", 3, True),
    ("juggle*", r"juggle\S*", 1, False),
    ("*running", r"\S*running", 1, False),
    ("fr*nt", r"fr\S*nt", 1, False),
    ("*", r"\S+", 1, False),
    ('"(net)"', r"\(net\)", 1, False),
    ("copper.zinc", r"copper\.zinc", 1, False),
    ('"stop!"', "stop!", 1, False),
    ("🐟", r"\x{1F41F}", 97, False),
    ("등대지기 NEAR{3} 불빛", r"(?:등대지기[\s\S]{0,18}불빛|불빛[\s\S]{0,18}등대지기)", 99, False),
    ("灯塔 NEAR{2} 渔船", r"(?:灯塔[\s\S]{0,8}渔船|渔船[\s\S]{0,8}灯塔)", 99, False),
    ("harbour NEAR{3} 등대지기", r"(?:harbour[\s\S]{0,15}등대지기|등대지기[\s\S]{0,15}harbour)", 99, False),
    ("A AND NOT B AND C", "A", 3, True),
    ("A AND B AND NOT C", "(?:A|B)", 3, True),
    ("NOT(A)", r"NOT\(A\)", 1, False),
    ("(a) (b)", r"\(a\) \(b\)", 1, False),
    ('"a" "b"', 'a" "b', 1, False),
    ("A OR OR B", "(?:A|OR B)", 1, False),
    ("(unclosed", r"\(unclosed", 1, False),
    ("copper?", "copper?", 1, False),
    ('"a*b"', "a*b", 1, False),
    ("등대지기*", "등대지기*", 97, False),
]


@pytest.mark.parametrize(("term", "pattern", "flags", "post"), GOLDEN)
def test_golden(term, pattern, flags, post):
    done = terms.translate(term)
    assert (done.pattern, done.flags, done.post_filter) == (pattern, flags, post)


@pytest.mark.parametrize("term", [None, "", "  ", "[unclosed", "NEAR{5} (copper)", "(juggle) NEAR{5}", "A LINEAR{3} B", "(A)NEAR{3}(B)", "A NEAR{99999999999} B"])
def test_errors(term):
    with pytest.raises(terms.TermError):
        terms.translate(term)


@pytest.mark.parametrize("pattern", ["(unclosed", "[unclosed", "(?=.*a).*", "(?!.*a).*", "", "a*", r"(a)\1", "(?>a)b", "a++", r"a\Kb"])
def test_refused(pattern):
    assert problem(pattern).startswith("Pattern")


@pytest.mark.parametrize("pattern", [r"\bcopper\b", "a{2,3}", r"\x{1F41F}", "[(?=]x", "{broken}", r"\(?=a"])
def test_accepted(pattern):
    assert problem(pattern) is None


JAVA = [("{broken}", "a {broken} b"), ("(?P<x_1>a)b", "ab"), ("a{,3}b", "a{,3}b"), (r"\bcop(per|s)\b", "a copper"), ("[{]x", "{x"), (r"\x{1F41F}+", "🐟"), (r"a\{2", "a{2")]


def test_every_pass_compiles_in_java(spark):
    """What passes can be scanned, and matches what it says; what Java refuses fails, on the driver and in a table."""
    rows = spark.createDataFrame([(t,) for _, t in JAVA], "text string")
    for pattern, text in JAVA:
        done = lexicons.compile_term(pattern, "NLT")
        assert done["status"] == "PASS", done
        assert [r.text for r in multiscan.scan(rows.where(F.col("text") == text), "text", [("x", pattern)], raw=True).collect()] == [text]
    strange = [r"a\Q(", "x{2}{3}", "(?<1a>x)", "a**", r"\p{Nothing}", "[a-", "[z-a]", "a{3,2}", "{1}", r"\8", "a|*", "(?z)a", "a{2}?", "[[:alpha:]]", r"\x{110000}", "a)", "x{99999999999}", "?", "a|b)"]
    rng = random.Random(2)
    strange += ["".join(rng.choice(["a", "b", "(", ")", "[", "]", "{", "}", "2", ",", "|", "*", "+", "?", "\\", "^", "$", "-", "P<", ":", ".", "x"]) for _ in range(rng.randint(1, 8))) for _ in range(400)]
    table = spark.createDataFrame([(k, "i", s, None, "NLT") for k, s in enumerate(strange)], "position int, term_id string, term_description string, risk_driver_name string, term_type string")
    inside = {r.position: r.status for r in lexicons.compile_frame(table).collect()}
    alone = [lexicons.compile_term(s, "NLT")["status"] for s in strange]
    assert [inside[k] for k in range(len(strange))] == alone and 50 < alone.count("PASS") < len(alone)
    passed = lexicons.pattern_set(lexicons.compile_terms(spark, [{"term_id": str(k), "term_description": s, "term_type": "REGEX"} for k, s in enumerate(strange)]))
    assert passed.count() == alone.count("PASS")
    multiscan.scan_patterns(spark.createDataFrame([("a(b",)], "text string"), "text", passed).collect()  # none throws


def test_both_scans_give_the_same_rows(spark, monkeypatch):
    rng = random.Random(11)
    rows = spark.createDataFrame([(i, " ".join(rng.choice(["red", "blue", "green", "sky", "Reddish"]) for _ in range(rng.randint(0, 5)))) for i in range(30)], "i int, text string")
    lexicon = [(k, _random_term(rng)) for k in range(40)]
    patterns = lexicons.pattern_set(lexicons.compile_terms(spark, [{"term_id": str(k), "term_description": t} for k, t in lexicon]))
    one = sorted((r.i, r.term_id) for r in multiscan.scan(rows, "text", lexicon).collect())
    assert one == sorted((r.i, r.id) for r in multiscan.scan_patterns(rows, "text", patterns).collect()) and one
    monkeypatch.setattr(multiscan, "BLOCK_TERMS", 7)
    monkeypatch.setattr(multiscan, "LITERAL_TERMS", 3)
    assert one == sorted((r.i, r.term_id) for r in multiscan.scan(rows, "text", lexicon).collect())
    assert multiscan.scan(rows, "text", []).count() == 0
    with pytest.raises(ValueError, match="relaxed"):
        multiscan.scan_patterns(rows, "text", patterns.drop("term_description"))


def test_offsets_with_control_characters(spark):
    text = "ab\x01 kelp\x02\x01kelp \x05 é kelp"
    found = spark.createDataFrame([(text,)], "t string").select(matches.matches(F.col("t"), "kelp").alias("m"), matches.highlighted(F.col("t"), "kelp").alias("h")).first()
    assert [(m.start, m.end, m.byte_start, m.byte_end) for m in found.m] == [(m.start(), m.end(), len(text[: m.start()].encode()), len(text[: m.end()].encode()) - 1) for m in regex.finditer("kelp", text)]
    assert found.h == text.replace("kelp", '<mark class="lex-match">kelp</mark>')


def test_patterns_of_two_literals():
    assert terms.near_pattern("copper", "zinc", 2) == terms.translate("copper NEAR{2} zinc").pattern
    assert terms.followed_pattern("copper", "zinc", 2) == terms.translate("copper FOLLOWEDBY{2} zinc").pattern
    assert terms.recommended_flags("copper", "zinc") == 3 and terms.recommended_flags("copper", "등대") == 99


def test_scripts_and_languages(spark):
    rows = spark.createDataFrame([("the harbour is quiet and the boats are in",), ("der Hafen ist ruhig und die Boote sind auf",), ("등대 등대 등대 등대 등대 등대 등대",), ("zzz zzz zzz zzz zzz zzz",), ("the",), (None,)], "t string")
    assert [r[0] for r in rows.select(scripts.likely_language(F.col("t"))).collect()] == ["en", "de", "ko", None, None, None]
    assert scripts.refine("CJK", "ko") == "HANGUL" and scripts.refine("CJK", "zh") == "CJK" and scripts.has_rtl("a ميناء") and not scripts.purely_rtl("a ميناء") and scripts.purely_rtl("ميناء")
    plan = rows.select(scripts.script_type(F.col("t")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and plan.upper().count("RLIKE") == len(scripts.CATEGORIES)


def naive(node, text):
    """A plain evaluator, leaf by leaf."""
    match node:
        case terms.Or(parts):
            return any(naive(p, text) for p in parts)
        case terms.And(parts):
            return all(naive(p, text) for p in parts)
        case terms.AndNot(left, right):
            return naive(left, text) and not naive(right, text)
        case terms.Not(part):
            return not naive(part, text)
    pattern, flags = terms.own_pattern(node)
    return bool(regex.search(pattern, text, regex.I | (regex.S if flags & 2 else 0)))


def _random_term(rng, depth=3):
    words = ["red", "blue", "green", "sky", "re*", "*en", '"red sky"']
    if depth == 0 or rng.random() < 0.25:
        return rng.choice(words)
    kind = rng.choice(["OR", "AND", "AND NOT", "NOT", "NEAR{1}", "FOLLOWEDBY{2}"])
    a, b = _random_term(rng, depth - 1), _random_term(rng, depth - 1)
    if kind == "NOT":
        return f"(NOT ({a}))"
    if "{" in kind:
        a, b = rng.choice(words), rng.choice(words)
    return f"(({a}) {kind} ({b}))"


def test_random_terms(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["red", "blue", "green", "sky", "Reddish", "then"]) for _ in range(rng.randint(0, 6))) for _ in range(40)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    trees = [terms.translate(_random_term(rng)).tree for _ in range(25)]
    got = rows.select("i", *[tree_match(t, F.col("text")).alias(f"c{k}") for k, t in enumerate(trees)]).orderBy("i").collect()
    for i, text in enumerate(texts):
        for k, tree in enumerate(trees):
            assert got[i][f"c{k}"] == naive(tree, text), (text, tree)


def test_null_text(spark):
    rows = spark.createDataFrame([(None,)], "text string")
    assert [tuple(r) for r in rows.select(term_match(F.col("text"), "a"), term_match(F.col("text"), "NOT a")).collect()] == [(False, True)]
