"""Terms as boolean columns: exact boolean logic over literal regular expressions, inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from termscan.plans import terms
from termscan.plans.terms import And, AndNot, Leaf, Near, Not, Or, Raw
from termscan.plans.validate import for_java


def java_pattern(node) -> str:
    pattern, flags = terms.own_pattern(node)
    return terms.inline(flags) + for_java(pattern)


def _exact(node, text: Column) -> Column:
    match node:
        case Or(parts):
            plain = [p for p in parts if terms.positional(p)]
            rest = [p for p in parts if not terms.positional(p)]
            columns = ([text.rlike(java_pattern(Or(tuple(plain)) if len(plain) > 1 else plain[0]))] if plain else []) + [_exact(p, text) for p in rest]
            return reduce(lambda a, b: a | b, columns)
        case And(parts):
            return reduce(lambda a, b: a & b, [_exact(p, text) for p in parts])
        case AndNot(left, right):
            return _exact(left, text) & ~_exact(right, text)
        case Not(part):
            return ~_exact(part, text)
        case Near(left, right):
            column = text.rlike(java_pattern(node))
            for side in (left, right):  # logic inside an operand has no place in the text; it holds for the whole text
                if not terms.positional(side):
                    column = column & _exact(side, text)
            return column
        case Leaf() | Raw():
            return text.rlike(java_pattern(node))
    raise TypeError(node)


def guard(node, lowered: Column) -> Column | None:
    """A cheap condition that every match fulfils: the literals that have to occur. None where none is known."""
    if any(not x.isascii() for lits in terms.needed(node) for x in lits) or terms.own_pattern(node)[1] & terms.UTF8:
        return None
    tests = [reduce(lambda a, b: a | b, [lowered.contains(x) for x in lits]) for lits in terms.needed(node)]
    return reduce(lambda a, b: a & b, tests) if tests else None


def tree_match(node, text: Column, lowered: Column | None = None) -> Column:
    """Whether the text fulfils the tree; null texts do not. lowered: lower(text), if it is at hand."""
    text = F.coalesce(text, F.lit(""))
    exact = _exact(node, text)
    cheap = guard(node, F.lower(text) if lowered is None else lowered)
    return exact if cheap is None else F.when(cheap, exact).otherwise(False)


def term_match(text: Column, term: str, lowered: Column | None = None) -> Column:
    """Whether the text fulfils a term of the term language."""
    return tree_match(terms.translate(term).tree, text, lowered)


def relaxed_match(text: Column, term: str) -> Column:
    """Whether the term's relaxed pattern occurs: the first phase of a two-phase scan."""
    t = terms.translate(term)
    return F.coalesce(text.rlike(terms.inline(t.flags) + for_java(t.pattern)), F.lit(False))
