"""Folding, cleaning and tokenizing of names as Column expressions: everything here stays in the JVM."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that fold to two, and to one.
EXTENDED_FOLD = {"Ä": "AE", "Ö": "OE", "Ü": "UE", "ß": "SS", "Æ": "AE", "Ø": "OE"}
SIMPLE_FOLD = {"Ä": "A", "Ö": "O", "Ü": "U", "ß": "SS", "Æ": "A", "Ø": "O", "Ł": "L", "Đ": "D"}
# Words that the blocking text leaves out.
STOP_WORDS = ("AND", "THE", "OF")
KEY_LENGTH = 4


def trim_controls(c: Column) -> Column:
    """Strip everything up to U+0020 at both ends."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


@functools.cache
def _mark_table() -> tuple[str, str]:
    """Letters of the Basic Multilingual Plane that are one letter without their marks, and these."""
    pairs = []
    for code in range(0x80, 0x10000):
        plain = "".join(x for x in unicodedata.normalize("NFD", chr(code)) if not unicodedata.category(x).startswith("M"))
        if plain != chr(code) and len(plain) == 1:
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def drop_marks(c: Column) -> Column:
    """Decompose and drop combining marks. Hangul syllables stay whole."""
    marked, plain = _mark_table()
    return F.regexp_replace(F.translate(c, marked, plain), r"\p{M}", "")


def _replace(c: Column, table: dict[str, str]) -> Column:
    for a, b in table.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _letters(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Z0-9]", "")


def fold(c: Column) -> Column:
    """Upper case, umlauts spelled out, marks dropped, letters A-Z and digits only."""
    return _letters(fold_keep_special(c))


def fold_keep_special(c: Column) -> Column:
    """As fold(), other characters kept."""
    return drop_marks(_replace(F.upper(c), EXTENDED_FOLD))


def fold_variants(c: Column) -> Column:
    """The three foldings under which names can be equal: marks dropped, umlauts spelled out, umlauts reduced."""
    upper = F.upper(c)
    return F.array(*[_letters(drop_marks(_replace(upper, table))) for table in ({}, EXTENDED_FOLD, SIMPLE_FOLD)])


def equal_folded(a: Column, b: Column) -> Column:
    """Whether any folding of one equals any of the other; two nulls are equal, one is not."""
    both = F.arrays_overlap(fold_variants(a), fold_variants(b))
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(both)


def remove_brackets(c: Column) -> Column:
    """Drop one bracketed group at the end."""
    return trim_controls(F.regexp_replace(c, r"\s*\([^)]+\)\s*$", ""))


def remove_punctuation(c: Column) -> Column:
    return F.translate(c, ",:;", "")


def clean_company_name(c: Column) -> Column:
    trimmed = trim_controls(c)
    return F.when(c.isNull(), F.lit(None)).when(trimmed == "", "").otherwise(trim_controls(remove_punctuation(remove_brackets(trimmed))))


def remove_legal_suffixes(c: Column, forms: list[str]) -> Column:
    """Strip listed suffixes after a space from the end, as many as there are; a name of nothing else becomes empty."""
    if not forms:
        return c
    quoted = "|".join(r"\Q" + f.replace(r"\E", "") + r"\E" for f in sorted(set(forms), key=lambda f: (-len(f), f)))
    return trim_controls(F.when(F.upper(c).isin([f.upper() for f in forms]), "").otherwise(F.regexp_replace(c, rf"(?iu)((^|\s+)({quoted}))+\s*$", "")))


def clean_and_strip_legal_form(c: Column, forms: list[str]) -> Column:
    return remove_legal_suffixes(clean_company_name(c), forms)


def _tokens(c: Column, pattern: str) -> Column:
    return F.filter(F.split(c, pattern), lambda w: w != "")


def name_words(c: Column) -> Column:
    """Cut at white space, hyphens and after dots."""
    return F.filter(F.transform(_tokens(c, r"[\s\-]+|(?<=\.)"), trim_controls), lambda w: w != "")


def plain_words(c: Column) -> Column:
    """Ampersands deleted; cut at white space, hyphens and slashes."""
    return F.filter(F.transform(_tokens(F.replace(c, F.lit("&"), F.lit("")), r"[\s\-/]+"), trim_controls), lambda w: w != "")


def legal_words(c: Column, plus_is_and: bool = True) -> Column:
    """Lower-case folded words for legal-form rules: ``&`` (and ``+``) and ``und`` are ``u``, brackets dropped."""
    text = F.replace(F.lower(c), F.lit("&"), F.lit(" u "))
    if plus_is_and:
        text = F.replace(text, F.lit("+"), F.lit(" u "))
    text = F.regexp_replace(F.regexp_replace(text, r'[;$.,_#+*§"!?-]', " "), r"\([^)]*\)", " ")
    words = F.transform(_tokens(text, r"\s+"), lambda w: F.lower(fold(w)))
    words = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.when(w == "und", "u").otherwise(w))
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(words)


def city_words(c: Column, titles: list[str] | None = None) -> Column:
    """Cut at white space, hyphens, slashes and after dots; titles left out."""
    words = F.filter(F.transform(_tokens(c, r"(?<=\.)|[\s\-/]+"), trim_controls), lambda w: w != "")
    if titles:
        listed = F.array(*[F.lit(t) for t in titles])
        words = F.filter(words, lambda w: ~F.array_contains(listed, F.upper(w)))
    return words


def normalize_name(c: Column) -> Column:
    """The blocking text: letters outside A-Z are spaces, stop words go. A first character that is none leaves an empty first word."""
    words = F.split(F.regexp_replace(F.upper(clean_company_name(c)), r"[^A-Z\s]", " "), r"\s+")
    # Empty words at the end go, one at the front stays.
    kept = F.filter(words, lambda w, i: (w != "") | (i == 0))
    kept = F.filter(kept, lambda w: ~w.isin(*STOP_WORDS))
    joined = F.when(F.forall(kept, lambda w: w == ""), "").otherwise(F.array_join(kept, " "))
    return F.coalesce(joined, F.lit(""))


def block_key(normalized: Column) -> Column:
    """First letters of up to four words."""
    firsts = F.transform(F.filter(F.split(normalized, r"\s+"), lambda w: w != ""), lambda w: F.substring(w, 1, 1))
    return F.substring(F.array_join(firsts, ""), 1, KEY_LENGTH)


def share_word(a: Column, b: Column) -> Column:
    """Whether a word of one list is a prefix of one of the other."""
    return F.exists(a, lambda x: F.exists(b, lambda y: F.startswith(x, y) | F.startswith(y, x)))


def initials_of(c: Column) -> Column:
    return F.upper(F.array_join(F.transform(name_words(c), lambda w: F.substring(w, 1, 1)), ""))


def matches_initials(a: Column, b: Column) -> Column:
    """Whether one name spells the first letters of the other's words."""
    one = lambda long, short: (F.size(name_words(long)) > 0) & (F.length(short) > 0) & (initials_of(long) == F.regexp_replace(F.upper(short), "[^A-Z]", ""))
    return one(a, b) | one(b, a)


def is_abbreviation(full: Column, short: Column) -> Column:
    """Whether short is the first letter of full, with or without a dot, and shorter than it."""
    form = (F.length(short) == 1) | ((F.length(short) == 2) & short.endswith("."))
    return F.coalesce((F.length(full) > F.length(short)) & form & (F.upper(F.substring(full, 1, 1)) == F.upper(F.substring(short, 1, 1))), F.lit(False))


def is_city_abbreviation(a: Column, b: Column) -> Column:
    """Whether one is a letter with a dot and the other starts with that letter."""
    longer = F.when((F.length(a) < F.length(b)) | ((F.length(a) == 2) & (F.length(b) == 2) & a.endswith(".")), b).otherwise(a)
    shorter = F.when((F.length(a) < F.length(b)) | ((F.length(a) == 2) & (F.length(b) == 2) & a.endswith(".")), a).otherwise(b)
    return F.coalesce((F.length(shorter) == 2) & shorter.endswith(".") & longer.startswith(F.substring(shorter, 1, 1)), F.lit(False))
