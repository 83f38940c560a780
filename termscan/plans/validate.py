"""What a pattern may hold: the common subset that a streaming multi-pattern matcher accepts, and that Java compiles.

`for_java` writes a pattern as Java reads it; what is checked is what scans use.
"""

from __future__ import annotations

import re

import regex
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Constructs that are refused, with the reason given.
REFUSED = [
    (r"\(\?<?[=!]", "Zero-width assertions are not supported"),
    (r"\(\?>", "Atomic groups are not supported"),
    (r"\(\?\(", "Conditional subpatterns are not supported"),
    (r"\(\?(?:R|&|P>|[+-]?\d+\))", "Recursion is not supported"),
    (r"\\[1-9]|\\k[<{']|\(\?P=", "Back-references are not supported"),
    (r"\\K", "\\K is not supported"),
    (r"(?:[*+?]|\{\d+(?:,\d*)?\})\+", "Possessive quantifiers are not supported"),
]
_CODE_POINT = re.compile(r"\\x\{([0-9A-Fa-f]+)\}")


def _bare(pattern: str) -> str:
    """The pattern with escaped characters and classes blanked, so that constructs in them don't count."""
    return re.sub(r"\\[^1-9kK]|\[\^?\]?(?:\\.|[^\]\\])*\]", lambda m: "x" * len(m[0]), pattern, flags=re.S)


def problem(pattern: str | None) -> str | None:
    """Why a pattern is refused, None if it is not."""
    if pattern is None or not pattern.strip():
        return "Pattern is null or blank"
    bare, reason = _bare(pattern), None
    for construct, why in REFUSED:
        if re.search(construct, bare):
            reason = why
            break
    if not reason:
        try:
            code = regex.compile(_CODE_POINT.sub(lambda m: regex.escape(chr(int(m[1], 16))), for_java(pattern)))
        except (regex.error, ValueError, OverflowError) as e:
            reason = str(e)
        else:
            if code.fullmatch(""):
                reason = "Pattern matches the empty string"
    return reason and refusal(reason, pattern)


#: Braces that are no quantifier are literal in the language, but an error in Java; nor has Java P in names of groups, or
#: underscores. No name is referred to, since back-references are refused.
_REWRITTEN = [(r"(?<!\\)(?<!\\[xpP])\{(?!\d+(?:,\d*)?\})", r"\\{"), (r"(?<!\\)\(\?P?<(?![=!])[^>]*>", "(")]


def for_java(pattern: str) -> str:
    for look, put in _REWRITTEN:
        pattern = re.sub(look, put, pattern)
    return pattern


def for_java_column(pattern: Column) -> Column:
    for look, put in _REWRITTEN:
        pattern = F.regexp_replace(pattern, look, put.replace("(", "\\("))
    return pattern


def refusal(reason: str, pattern: str) -> str:
    return f"Pattern compile error: {reason} [pattern: {pattern[:100]}{'…' if len(pattern) > 100 else ''}]"


def java_problem(java: str, pattern: str) -> str | None:
    """Why Java does not compile it, asked on the driver; None where there is no session to ask."""
    session = SparkSession.getActiveSession()
    if session is None:
        return None
    try:
        session.sparkContext._jvm.java.util.regex.Pattern.compile(java)
    except (PySparkException, Py4JJavaError) as e:
        return refusal(str(e).split("\n")[0], pattern)
    return None


def java_compiles(java: Column) -> Column:
    """Whether Java compiles a column's patterns; asked where the rows are."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), java).isNotNull()
