"""Writing systems of texts, on the driver and as columns.

A text's categories are those of its characters, without invisible ones (joiners, marks, combining signs); the script
type follows from the set of categories, and says how wide a proximity gap has to be.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Writing systems by category.
CATEGORIES = {
    "CJK": ["Han", "Bopomofo"],
    "KANA": ["Hiragana", "Katakana"],
    "HANGUL": ["Hangul"],
    "THAI": ["Thai", "Lao", "Myanmar"],
    "ARABIC": ["Arabic"],
    "HEBREW": ["Hebrew"],
    "OTHER_RTL": ["Thaana", "Nko", "Samaritan", "Mandaic"],
    "INDIC": ["Devanagari", "Bengali", "Gurmukhi", "Gujarati", "Oriya", "Tamil", "Telugu", "Kannada", "Malayalam", "Sinhala", "Tibetan"],
    "LATIN": ["Latin", "Greek", "Cyrillic", "Armenian", "Georgian"],
}
SPACE_FREE = ("CJK", "KANA", "HANGUL", "THAI")
RIGHT_TO_LEFT = ("ARABIC", "HEBREW", "OTHER_RTL")


@dataclass(frozen=True)
class Script:
    rtl: bool
    spaced: bool
    width: int
    flags: int


#: Script types with direction, spaces between words, characters of a word, and pattern flags.
SCRIPTS = {
    "LATIN": Script(False, True, 8, 3),
    "ARABIC": Script(True, True, 7, 99),
    "HEBREW": Script(True, True, 7, 99),
    "DEVANAGARI": Script(False, True, 7, 99),
    "CJK": Script(False, False, 3, 99),
    "KANA": Script(False, False, 3, 99),
    "HANGUL": Script(False, False, 5, 99),
    "THAI": Script(False, False, 6, 99),
    "MIXED_CJK": Script(False, False, 4, 99),
    "MIXED_RTL": Script(True, True, 8, 99),
    "MIXED": Script(False, False, 6, 99),
}

INVISIBLE = "[\\x{200C}-\\x{200F}\\x{FEFF}\\p{Mn}\\p{Mc}]"
#: Code point ranges of emoji.
EMOJI = [(0x2600, 0x27BF), (0xFE00, 0xFE0F), (0x1F100, 0x1F1FF), (0x1F300, 0x1F64F), (0x1F680, 0x1F8FF), (0x1F900, 0x1F9FF), (0x1FA00, 0x1FAFF)]
EMOJI_CLASS = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in EMOJI) + "]"

_HIDDEN = regex.compile("[‌-‏﻿\\p{Mn}\\p{Mc}]")
_MEMBERS = {c: regex.compile("[" + "".join(f"\\p{{Script={s}}}" for s in names) + "]") for c, names in CATEGORIES.items()}
#: Types that one category, or one set of them, gives; what follows holds for mixtures.
_PURE = [("CJK", {"CJK"}), ("KANA", {"KANA"}), ("HANGUL", {"HANGUL"}), ("THAI", {"THAI"}), ("ARABIC", {"ARABIC", "OTHER_RTL"}), ("HEBREW", {"HEBREW"}), ("DEVANAGARI", {"INDIC"}), ("LATIN", {"LATIN"})]


def is_emoji(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in EMOJI)


def categories(text: str | None) -> set[str]:
    shown = _HIDDEN.sub("", text or "")
    return {c for c, members in _MEMBERS.items() if members.search(shown)}


def _resolve(found: set[str]) -> str:
    for name, own in _PURE:
        if found and found <= own:
            return name
    if not found:
        return "LATIN"
    if found & set(SPACE_FREE):
        return "MIXED_CJK"
    return "MIXED_RTL" if found & set(RIGHT_TO_LEFT) and found & {"LATIN", "INDIC"} else "MIXED"


def detect(*texts: str | None) -> str:
    """The script type of one text, or of several together."""
    return _resolve(set().union(*map(categories, texts)))


def has_rtl(text: str | None) -> bool:
    return not categories(text).isdisjoint(RIGHT_TO_LEFT)


def purely_rtl(*texts: str | None) -> bool:
    """Every text has right-to-left letters, and no others."""
    return all((found := categories(t)) and found <= set(RIGHT_TO_LEFT) for t in texts)


def word_gap(n: int) -> str:
    return f"(?:\\s+\\S+){{0,{n}}}\\s+"


def char_gap(script: str, n: int) -> str:
    return f"[\\s\\S]{{0,{n * SCRIPTS[script].width + n}}}"


def gap(script: str, n: int) -> str:
    return word_gap(n) if SCRIPTS[script].spaced else char_gap(script, n)


def refine(script: str, language: str | None) -> str:
    """Korean text in Chinese characters counts as Hangul."""
    return "HANGUL" if language == "ko" and script in ("CJK", "MIXED_CJK") else script


# the same as columns


def _once(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def category_columns(shown: Column) -> dict[str, Column]:
    """A boolean for each category; shown: the text without invisible characters."""
    return {c: shown.rlike("[" + "".join(f"\\p{{Is{s}}}" for s in names) + "]") for c, names in CATEGORIES.items()}


def script_type(text: Column) -> Column:
    """The script type of a text column: invisible characters are taken out once, and each category is looked for once."""

    def resolved(has: Column) -> Column:
        any_of = lambda names: reduce(lambda a, b: a | b, [has[c] for c in names])
        case = F.when(~any_of(CATEGORIES), "LATIN")
        for name, own in _PURE:
            case = case.when(~any_of([c for c in CATEGORIES if c not in own]), name)
        case = case.when(any_of(SPACE_FREE), "MIXED_CJK").when(any_of(RIGHT_TO_LEFT) & any_of(["LATIN", "INDIC"]), "MIXED_RTL")
        return case.otherwise("MIXED")

    found = lambda shown: F.struct(*[has.alias(c) for c, has in category_columns(shown).items()])
    return _once(_once(F.regexp_replace(F.coalesce(text, F.lit("")), INVISIBLE, ""), found), resolved)


def has_emoji(text: Column) -> Column:
    return F.coalesce(text.rlike(EMOJI_CLASS), F.lit(False))


def has_non_ascii(text: Column) -> Column:
    return F.coalesce(text.rlike("[^\\x00-\\x7F]"), F.lit(False))


def reliable_length(text: Column) -> Column:
    """Long enough to tell its language."""
    return F.coalesce(F.length(text) >= 20, F.lit(False))


#: Frequent words by language, and the language that a script alone tells.
STOP_WORDS = {
    "en": "the and of to with that is for it was this are".split(),
    "de": "der die und das mit ist nicht ein eine von den auf".split(),
    "fr": "le la les des est que une dans pour qui pas sur".split(),
    "es": "el los que una por con las del para como pero es".split(),
    "it": "il di che la per non una con sono della gli anche".split(),
    "pt": "o que os uma para com dos não em as mais ao".split(),
    "nl": "de het een van en dat niet zijn op te voor met".split(),
    "tr": "ve bir bu için ile da de çok gibi ama ne olarak".split(),
}
SCRIPT_LANGUAGES = {"HANGUL": "ko", "KANA": "ja", "CJK": "zh", "THAI": "th", "HEBREW": "he", "ARABIC": "ar", "DEVANAGARI": "hi"}


def likely_language(text: Column) -> Column:
    """The language that the text's script tells, else the one whose frequent words make most of its words: a rough guess.

    Null for short texts and where no frequent word occurs. Ties go to the first name.
    """

    def one_of(own: list[str]):
        return lambda w: w.isin(own)

    def counted(words: Column) -> Column:
        counts = [F.struct(F.size(F.filter(words, one_of(own))).alias("n"), F.lit(-k).alias("order"), F.lit(name).alias("language")) for k, (name, own) in enumerate(sorted(STOP_WORDS.items()))]
        return F.array_max(F.array(*counts))

    def told(script: Column) -> Column:
        return reduce(lambda c, x: c.when(script == x[0], x[1]), SCRIPT_LANGUAGES.items(), F.when(F.lit(False), F.lit(None).cast("string")))

    best = _once(_once(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}]+"), counted), lambda x: F.when(x["n"] > 0, x["language"]))
    return F.when(reliable_length(text), F.coalesce(_once(script_type(text), told), best))
