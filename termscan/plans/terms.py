"""The term language: a text becomes a tree, a tree becomes a pattern.

From loosest to tightest: OR, AND NOT, AND, NEAR{n} and FOLLOWEDBY{n}, NOT or !, and leaves (quoted phrases, wildcards,
plain text). Operators are words with one space at each side, in any case, outside quotes and parentheses.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

from termscan.functions import scripts

CASELESS, DOTALL, UTF8, UCP = 1, 2, 32, 64
#: Characters that are escaped in literals. Asterisk and question mark are not among them.
ESCAPED = "\\.^$|+()[]{}<>"
PROXIMITY = re.compile(r"(NEAR|FOLLOWEDBY)\{(\d+)\}", re.I)
INT_MAX = 2**31 - 1


class TermError(ValueError):
    """A term that cannot be translated."""


@dataclass(frozen=True)
class Leaf:
    text: str
    kind: str  # quoted, emoji, other (non-ASCII), wild, plain, empty

    @property
    def pattern(self) -> str:
        if self.kind == "emoji":
            return "".join(f"\\x{{{ord(c):X}}}" if scripts.is_emoji(c) else escaped(c) for c in self.text)
        if self.kind == "wild":
            return "\\S+" if self.text == "*" else "\\S*".join(map(escaped, self.text.split("*")))
        return escaped(self.text)


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class AndNot:
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class Near:
    left: object
    right: object
    n: int
    both_ways: bool


@dataclass(frozen=True)
class Raw:
    """A regular expression as it is."""

    pattern: str


@dataclass
class Translation:
    pattern: str
    flags: int
    post_filter: bool
    operands: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    tree: object = None


def escaped(text: str) -> str:
    return "".join(f"\\{c}" if c in ESCAPED else c for c in text)


def prepared(term: str) -> str:
    return unicodedata.normalize("NFC", term.strip().replace('""', '"'))


def _open_places(expr: str) -> list[bool]:
    """Whether each place is outside all quotes and parentheses, its own character taken into account."""
    places, depth, quoted = [], 0, False
    for c in expr:
        if c == '"':
            quoted = not quoted
        elif not quoted:
            depth += (c == "(") - (c == ")")
        places.append(not quoted and depth == 0)
    return places


def _wrapped(expr: str) -> bool:
    """One pair of parentheses holds the whole expression."""
    return expr.startswith("(") and next((i for i, free in enumerate(_open_places(expr)) if free and expr[i] == ")"), -1) == len(expr) - 1


def _operators(expr: str, pattern: str) -> Iterator[re.Match]:
    """Matches of an operator at open places, each looked for after the last one's end."""
    places, at, look = _open_places(expr), 0, re.compile(pattern, re.I)
    while m := look.search(expr, at):
        if places[m.start()]:
            yield m
            at = m.end()
        else:
            at = m.start() + 1


def _pieces(expr: str, pattern: str) -> list[str]:
    """The non-empty parts between an operator's occurrences; a group named other is none, and stays."""
    parts, at = [], 0
    for m in _operators(expr, pattern):
        if m.lastgroup != "other":
            parts.append(expr[at : m.start()].strip())
            at = m.end()
    parts = [p for p in [*parts, expr[at:].strip()] if p]
    return parts if len(parts) > 1 else []


def parse(expr: str) -> object:
    expr = expr.strip()
    while _wrapped(expr):
        expr = expr[1:-1].strip()
    if not expr:
        return Leaf("", "empty")
    if parts := _pieces(expr, " OR "):
        return Or(tuple(map(parse, parts)))
    places = _open_places(expr)
    for m in re.finditer("(?= AND NOT )", expr, re.I):
        left, right = expr[: m.start()].strip(), expr[m.start() + 9 :].strip()
        if places[m.start()] and left and right:
            return AndNot(parse(left), parse(right))
    if parts := _pieces(expr, "(?P<other> AND NOT )| AND "):
        return And(tuple(map(parse, parts)))
    for m in re.finditer(r"(?<= )(?=(?:NEAR|FOLLOWEDBY)\{\d+\})", expr, re.I):
        op = PROXIMITY.match(expr, m.start())
        left, right = expr[: m.start() - 1].strip(), expr[op.end() :].strip()
        if places[m.start()]:
            if int(op[2]) > INT_MAX:
                raise TermError(f'Unexpected error: For input string: "{op[2]}"')
            if left and right:
                return Near(parse(left), parse(right), int(op[2]), op[1].upper() == "NEAR")
    if expr[:4].upper() == "NOT ":
        return Not(parse(expr[4:]))
    if expr.startswith("!"):
        return Not(parse(expr[1:]))
    return _leaf(expr)


def _leaf(text: str) -> Leaf:
    if len(text) > 1 and text.startswith('"') and text.endswith('"'):
        return Leaf(text[1:-1], "quoted")
    rest = re.sub(r"\\.", "", text, flags=re.S)
    if "[" in rest[rest.rfind("]") + 1 :]:
        raise TermError(f"Unclosed character class '[' in term: '{text}'. Either close it with ']' or wrap the term in quotes to match it literally, e.g. \"[{text[1:]}\".")
    for name in ("NEAR", "FOLLOWEDBY"):
        if m := re.search(rf"{name}\{{(\d+)\}}", text, re.I):
            raise TermError(f"{name}{{{m[1]}}} is missing a left and/or right operand in term: '{text}'. Expected format: 'word1 {name}{{n}} word2'. To match this text literally instead, wrap it in quotes, e.g. \"{text}\".")
    if any(map(scripts.is_emoji, text)):
        return Leaf(text, "emoji")
    if not text.isascii():
        return Leaf(text, "other")
    return Leaf(text, "wild" if "*" in text else "plain")


class _Writer:
    """Writes a tree's relaxed pattern, and notes what it needs on the way."""

    def __init__(self):
        self.logic = self.proximity = self.unicode = False
        self.operands: list[str] = []
        self.warnings: list[str] = []

    def write(self, node) -> str:
        match node:
            case Leaf() as leaf:
                self.unicode |= not leaf.text.isascii()
                return leaf.pattern
            case Raw(pattern):
                return pattern
            case Or(parts):
                return f"(?:{'|'.join(map(self.write, parts))})"
            case And(parts):
                self.logic = True
                return f"(?:{'|'.join(map(self._operand, parts))})"
            case AndNot(left, right):
                self.logic = True
                found = self._operand(left)
                self.write(right)
                return found
            case Not(part):
                self.logic = True
                return self.write(part)
            case Near(left, right, n, both_ways):
                self.proximity = True
                return self._near(self.write(left), self.write(right), n, both_ways)
        raise TypeError(node)

    def _operand(self, node) -> str:
        found = self.write(node)
        self.operands.append(found)
        return found

    def _near(self, left: str, right: str, n: int, both_ways: bool) -> str:
        script = scripts.detect(left, right)
        between = scripts.gap(script, n)
        self.unicode |= bool(scripts.SCRIPTS[script].flags & UTF8)
        if both_ways:
            return f"(?:{left}{between}{right}|{right}{between}{left})"
        if (scripts.has_rtl(left) or scripts.has_rtl(right)) and not scripts.purely_rtl(left, right):
            self.warnings.append("FOLLOWEDBY between right-to-left and left-to-right text follows the order of storage, not of display")
        return f"{left}{between}{right}"


def translate(term: str | None) -> Translation:
    """The relaxed pattern of a term, with its flags, as reports show it; tree holds what is evaluated."""
    if term is None or not term.strip():
        raise TermError("Term description is null or blank")
    tree, writer = parse(prepared(term)), _Writer()
    pattern = writer.write(tree)
    flags = CASELESS | DOTALL * (writer.logic or writer.proximity) | (UTF8 | UCP) * writer.unicode
    return Translation(pattern, flags, writer.logic, writer.operands, writer.warnings, tree)


def translate_raw(pattern: str) -> Translation:
    """A regular expression: as it is, with the flags of its script."""
    return Translation(pattern, scripts.SCRIPTS[scripts.detect(pattern)].flags, False, tree=Raw(pattern))


def recommended_flags(*texts: str) -> int:
    """The flags of the texts' common script."""
    return scripts.SCRIPTS[scripts.detect(*texts)].flags


def near_pattern(left: str, right: str, n: int) -> str:
    """Two literals within n words of each other, in any order."""
    return _Writer().write(Near(_leaf(left), _leaf(right), n, True))


def followed_pattern(left: str, right: str, n: int) -> str:
    """The second literal within n words after the first."""
    return _Writer().write(Near(_leaf(left), _leaf(right), n, False))


def inline(flags: int, dialect: str = "java") -> str:
    """Flags as an inline group. RE2 always reads Unicode, and means something else by U."""
    letters = "i" * bool(flags & CASELESS) + "s" * bool(flags & DOTALL)
    if dialect == "java":
        letters += "u" * bool(flags & UTF8) + "U" * bool(flags & UCP)
    return f"(?{letters})" if letters else ""


def positional(node) -> bool:
    """The node has a place in the text: no AND, AND NOT or NOT in it."""
    match node:
        case And() | AndNot() | Not():
            return False
        case Or(parts):
            return all(map(positional, parts))
        case Near(left, right):
            return positional(left) and positional(right)
    return True


def own_pattern(node) -> tuple[str, int]:
    """Pattern and flags of one node by itself."""
    writer = _Writer()
    pattern = writer.write(node)
    if isinstance(node, Raw):
        return pattern, scripts.SCRIPTS[scripts.detect(pattern)].flags
    return pattern, CASELESS | DOTALL * (writer.logic or writer.proximity) | (UTF8 | UCP) * writer.unicode


def needed(node) -> list[list[str]]:
    """Literals without which the node cannot match: of each list, one has to be in the lower-cased text. ASCII only."""
    match node:
        case Leaf(text, kind):
            if not text.isascii() or kind in ("empty", "emoji", "other"):
                return []
            if kind == "wild":
                best = max(text.split("*"), key=len)
                return [[best.lower()]] if best and "?" not in text else []
            return [[text.lower()]] if not set(text) & set("?*") else []
        case And(parts):
            return [x for p in parts for x in needed(p)]
        case AndNot(left, _):
            return needed(left)
        case Near(left, right):
            return needed(left) + needed(right)
        case Or(parts):
            options = [needed(p) for p in parts]
            if not all(options):
                return []
            return [[x for o in options for x in max(o, key=lambda ws: min(map(len, ws)))]]
    return []
