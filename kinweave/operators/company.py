"""Scores pairs of company names: a cascade of rules from equality to word-by-word comparison."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from kinweave.config import DEFAULT_COUNTRY
from kinweave.functions.legal_forms import LegalForm, Rule, legal_form_of, name_without_form
from kinweave.functions.similarity import fold_equal, jaro_winkler, levenshtein_similarity
from kinweave.functions.words import compare_by_words

# Scores and thresholds of the cascade.
EQUAL_SCORE, CLEANED_EQUAL_SCORE, INITIALS_SCORE = 1.0, 0.99, 0.5
JARO_FACTOR, WHOLE_LIMIT, CLEANED_LIMIT, EDIT_CAP, LIMIT, FORM_PENALTY = 2.5, 0.95, 0.9, 0.95, 0.85, 0.9
ABBREVIATED_WORD, WORD_LIMIT, MISSING_WORD = 0.9, 0.95, 0.2
_CONTROLS = "".join(map(chr, range(33)))
_BRACKETS = re.compile(r"\s*\([^)]+\)\s*$", re.ASCII)
_CUTS = re.compile(r"[\s\-]+|(?<=\.)", re.ASCII)


def cleaned(name: str) -> str:
    text = _BRACKETS.sub("", name.strip(_CONTROLS)).strip(_CONTROLS)
    return text.translate({ord(c): None for c in ",:;"}).strip(_CONTROLS)


def name_words(name: str) -> list[str]:
    return [w for w in (x.strip(_CONTROLS) for x in _CUTS.split(name)) if w]


def abbreviates(full: str, short: str) -> bool:
    return len(full) > len(short) and (len(short) == 1 or (len(short) == 2 and short[1] == ".")) and full[0].upper() == short[0].upper()


def _word_score(a: str, b: str) -> float | None:
    if a.lower() == b.lower() or fold_equal(a, b):
        return 1.0
    if abbreviates(a, b) or abbreviates(b, a):
        return ABBREVIATED_WORD
    score = jaro_winkler(a, b)
    return score if score >= WORD_LIMIT else None


def word_sequence_score(name1: str, name2: str) -> float | None:
    """Word against word from the left; None unless all words of the shorter name fit, and it has more than half of the longer's."""
    best = None
    one, two = name_words(name1), name_words(name2)
    if min(len(one), len(two)) < 2:
        return None
    for a, b in ((one, two), (two, one)):
        few, many = sorted((len(a), len(b)))
        scores = [_word_score(x, y) for x, y in zip(a, b)] if few > many / 2 else [None]
        if None not in scores:
            total = 0.0
            for s in scores:
                total += s
            score = total / (few + (many - few) * MISSING_WORD)
            best = score if best is None else max(best, score)
    return best


def spells_initials(name1: str, name2: str) -> bool:
    def one(long: str, short: str) -> bool:
        words = name_words(long)
        return bool(words) and bool(short) and "".join(w[0].upper() for w in words) == re.sub("[^A-Z]", "", short.upper())

    return one(name1, name2) or one(name2, name1)


def _edit_score(a: str, b: str) -> float:
    return min(EDIT_CAP, levenshtein_similarity(a, b)) if len(a) > 2 and len(b) > 2 else 0.0


def _jaro_score(a: str, b: str) -> float:
    return 1 - (1 - jaro_winkler(a, b)) * JARO_FACTOR


def country_of(code1: str | None, code2: str | None) -> str:
    """The common country; of two different ones the second; DE without any."""
    return next((c.upper() for c in (code2, code1) if c is not None), DEFAULT_COUNTRY)


def match_company_names(
    name1: str | None, name2: str | None, rules: Sequence[Rule] = (), forms: Sequence[LegalForm] | None = None, form1: str | None = None, form2: str | None = None, bare1: str | None = None, bare2: str | None = None
) -> float | None:
    """Probability that two names are of one company, None if they don't match.

    form1/2 and bare1/2, the names' legal forms and the names without, are worked out if not given.
    """
    if name1 is None or name2 is None:
        return None
    one, two = (n.strip(_CONTROLS).upper() for n in (name1, name2))
    if not one or not two:
        return None
    if fold_equal(one, two):
        return EQUAL_SCORE
    jaro = _jaro_score(one, two)
    if jaro >= WHOLE_LIMIT:
        return jaro
    whole = _edit_score(one, two)
    if whole >= EDIT_CAP:
        return whole
    penalty = 1.0
    if forms:
        form1 = form1 or legal_form_of(one, rules, forms)
        form2 = form2 or legal_form_of(two, rules, forms)
        form1, form2 = form1 or form2, form2 or form1
        penalty = 1.0 if form1 == form2 else FORM_PENALTY
    if form1 is not None and form1 == form2:
        one = (bare1 if bare1 is not None else name_without_form(one, rules, forms)).upper()
        two = (bare2 if bare2 is not None else name_without_form(two, rules, forms)).upper()
    else:
        one, two = cleaned(one), cleaned(two)
    if not one or not two:
        return None
    if fold_equal(one, two):
        return CLEANED_EQUAL_SCORE
    in_sequence = word_sequence_score(one, two)
    if in_sequence is not None and in_sequence > LIMIT:
        return in_sequence
    if spells_initials(one, two):
        return INITIALS_SCORE
    by_words, jaro, edit = compare_by_words(one, two), _jaro_score(one, two), _edit_score(one, two)
    if jaro * penalty >= CLEANED_LIMIT and edit >= by_words:
        return jaro * penalty
    if by_words > max(whole, edit) and by_words >= LIMIT:
        return by_words * penalty
    return next((s * penalty for s in (whole, edit) if s >= LIMIT), None)


def company_score(name1: Column, name2: Column, rules: Sequence[Rule] = (), forms: dict[str, Sequence[LegalForm]] | None = None, country1: Column | None = None, country2: Column | None = None, prepared: Sequence[Column] = ()) -> Column:
    """match_company_names() as a nullable double column, Arrow-batched. prepared: form1, form2, bare1, bare2 of the pair."""
    rules, forms = tuple(rules), dict(forms or {})

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series, c1: pd.Series, c2: pd.Series, *known: pd.Series) -> pd.Series:
        out = [match_company_names(x, y, rules, forms.get(country_of(p, q)), *more) for x, y, p, q, *more in zip(a, b, c1, c2, *known)]
        return pd.Series(out, dtype="float64")

    codes = [F.lit(DEFAULT_COUNTRY) if c is None else c for c in (country1, country2)]
    return F.nanvl(score.asNondeterministic()(name1, name2, *codes, *prepared), F.lit(None).cast("double"))


def legal_form_column(name: Column, rules: Sequence[Rule], forms: dict[str, Sequence[LegalForm]], country: str = DEFAULT_COUNTRY) -> Column:
    rules, own = tuple(rules), tuple(forms.get(country, ()))

    @F.pandas_udf("string")
    def find(names: pd.Series) -> pd.Series:
        return pd.Series([legal_form_of(n, rules, own) for n in names], dtype=object)

    return find.asNondeterministic()(name)


def name_without_form_column(name: Column, rules: Sequence[Rule], forms: dict[str, Sequence[LegalForm]], country: str = DEFAULT_COUNTRY) -> Column:
    rules, own = tuple(rules), tuple(forms.get(country, ()))

    @F.pandas_udf("string")
    def strip(names: pd.Series) -> pd.Series:
        return pd.Series([name_without_form(n, rules, own) for n in names], dtype=object)

    return strip.asNondeterministic()(name)


def normalize_legal_column(name: Column, rules: Sequence[Rule]) -> Column:
    from kinweave.functions.legal_forms import clean_words, rewrite

    rules = tuple(rules)

    @F.pandas_udf("array<string>")
    def normalize(names: pd.Series) -> pd.Series:
        return pd.Series([list(rewrite(clean_words(n), rules)[0]) for n in names])

    return normalize.asNondeterministic()(name)


def word_sequence_column(a: Column, b: Column) -> Column:
    from kinweave.functions.similarity import pair_udf

    return pair_udf(word_sequence_score, "double")(a, b)
