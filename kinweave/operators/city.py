"""Place names: aliases, titles, and a pair scorer."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.similarity import fold_equal, folded, jaro_winkler
from kinweave.functions.text import trim_controls

# Aliases of places; the last of two equal ones counts.
CITY_ALIASES = (
    ("Aix-la-Chapelle", "Aachen"), ("Anvers", "Antwerp"), ("Antwerpen", "Antwerp"), ("Basil", "Basel"), ("Basle", "Basel"), ("Bozen", "Bolzano"), ("Braunschweig", "Brunswick"),
    ("Breslau", "Wroclaw"), ("Brügge", "Bruges"), ("Leghorn", "Livorno"), ("Leipsic", "Leipzig"), ("Lipswick", "Leipzig"), ("Mailand", "Milan"), ("Milano", "Milan"), ("Minga", "Munich"),
    ("Monachium", "Munich"), ("München", "Munich"), ("Köln", "Cologne"), ("Colonia", "Cologne"), ("Coleyn", "Cologne"), ("Constance", "Konstanz"), ("Florenz", "Florence"), ("Genava", "Geneva"),
    ("Danzig", "Gdańsk"), ("Praha", "Prague"), ("Prag", "Prague"), ("Roma", "Rome"), ("Ratisbon", "Regensburg"), ("Ratisbona", "Regensburg"), ("Stalingrad", "Volgograd"), ("Tsaritsyn", "Volgograd"),
    ("Wien", "Vienna"), ("Wilna", "Vilnius"), ("Vilna", "Vilnius"), ("Augsburgh", "Augsburg"), ("Blenheim", "Blindheim"), ("Cleves", "Kleve"), ("Coblence", "Koblenz"), ("Coblenz", "Koblenz"),
    ("Cassel", "Kassel"), ("Dantzig", "Gdańsk"), ("Dessaw", "Dessau"), ("Dettingham", "Dettingen"), ("Donow", "Donau"), ("Durlack", "Durlach"), ("Embden", "Emden"), ("Friseland", "Friesland"),
    ("Frisia", "Friesland"), ("Frankford", "Frankfurt"), ("Fribourg", "Freiburg"), ("Friburgh", "Freiburg"), ("Lipswick", "Leipzig"), ("Lorraine", "Lothringen"), ("Lucerne", "Luzern"),
    ("Lunenburgh", "Lüneburg"), ("Luxemburgh", "Luxemburg"), ("Treves", "Trier"), ("Trèves", "Trier"), ("Saltsburgh", "Salzburg"), ("Frankfurt a. M.", "Frankfurt am Main"),
    ("Frankfurt a. Main", "Frankfurt am Main"), ("Frankfurt a.M.", "Frankfurt am Main"), ("Frankfurt/Main", "Frankfurt am Main"), ("Frankfurt Main", "Frankfurt am Main"),
    ("Frankfurt an der Oder", "Frankfurt/Oder"), ("Frankfurt a. d. Oder", "Frankfurt/Oder"), ("Frankfurt Oder", "Frankfurt/Oder"), ("Frankfurt a.d.O.", "Frankfurt/Oder"),
    ("Frankfurt a.d. Oder", "Frankfurt/Oder"), ("Frankfurt", "Frankfurt am Main"),
)
# What may follow the common part of two names of one place.
SUFFIX_STARTS = ("AM ", "AN ", "BEI ", "A.", "IM", "I.", "VOR ", "V.", "(", "OT ", ",", "-", "A D", "AN")
EQUAL_SCORE, ALIAS_SCORE, PARTS_LIMIT, LIMIT, CONTAINED_SCORE = 1.0, 0.99, 0.9, 0.85, 0.7
INITIAL_SCORE, LEFT_OVER_SCORE, CLASH_SCORE, REAL_SCORE = 0.95, 0.8, 0.1, 0.8
_CONTROLS = "".join(map(chr, range(33)))
_CUTS = re.compile(r"(?<=\.)|[\s\-/]+", re.ASCII)


def alias_map(pairs=CITY_ALIASES) -> dict[str, str]:
    return {a.upper(): b.upper() for a, b in pairs}


def mapped(name: str, aliases: Mapping[str, str]) -> str:
    upper = name.strip(_CONTROLS).upper()
    return aliases.get(upper, upper)


def place_words(name: str, titles: frozenset[str] = frozenset()) -> list[str]:
    """The words without titles. As in Java, a separator right behind a dot's cut isn't one: it stays with the next word, and white space is trimmed there."""
    parts, start, at = [], 0, 0
    while at <= len(name) and (m := _CUTS.search(name, at)):
        parts.append(name[start : m.start()])
        start, at = m.end(), m.end() + (m.start() == m.end())
    parts.append(name[start:])
    return [w for w in (x.strip(_CONTROLS) for x in parts) if w and w.upper() not in titles]


def initial_matches(a: str, b: str) -> bool:
    """Whether one word is a letter with a dot and the other starts with it."""
    short, long = (a, b) if len(a) < len(b) or (len(a) == len(b) == 2 and a.endswith(".")) else (b, a)
    return len(short) == 2 and short[1] == "." and long.startswith(short[0])


@dataclass
class _Parts:
    scores: list[float] = field(default_factory=list)
    initials: list[tuple[int, int]] = field(default_factory=list)
    clash: bool = False


def _best(word: str, others: list[str], taken: set[int]) -> tuple[int, float] | None:
    free = [k for k in range(len(others)) if k not in taken]
    equal = next((k for k in free if word == others[k] or fold_equal(word, others[k])), None)
    if equal is not None:
        return equal, 1.0
    scored = [(k, jaro_winkler(word, others[k])) for k in free]
    top = max(scored, key=lambda s: s[1], default=None)
    return top if top and top[1] > LIMIT else None


def parts_score(a: str, b: str, titles: frozenset[str] = frozenset()) -> float | None:
    """Mean of the words' scores, paired greedily; None if the pairing doesn't hold."""
    one, two = place_words(a, titles), place_words(b, titles)
    if not one or not two:
        return None
    parts, used1, used2 = _Parts(), set(), set()
    for k, word in enumerate(one):
        if hit := _best(word, two, used2):
            used1.add(k)
            used2.add(hit[0])
            parts.scores.append(hit[1])
    for k, word in enumerate(one):
        if k not in used1:
            j = next((j for j, other in enumerate(two) if j not in used2 and initial_matches(word, other)), None)
            if j is not None:
                used1.add(k)
                used2.add(j)
                parts.scores.append(INITIAL_SCORE)
                parts.initials.append((k, j))
    left1, left2 = len(one) - len(used1), len(two) - len(used2)
    parts.clash = left1 > 0 and left2 > 0
    parts.scores += [CLASH_SCORE if parts.clash else LEFT_OVER_SCORE] * max(left1, left2)
    few, real = min(len(one), len(two)), sum(s > REAL_SCORE for s in parts.scores)
    if sum(s >= REAL_SCORE for s in parts.scores) < few or (few > 2 and parts.clash and real < 2):
        return None
    if parts.initials and (real - len(parts.initials) < 1 or any(0 in pair for pair in parts.initials)):
        return None
    return sum(parts.scores) / len(parts.scores)


def match_city(name1: str | None, name2: str | None, aliases: Mapping[str, str], titles: frozenset[str] = frozenset()) -> float | None:
    """Probability that two names are of one place, None if they don't match."""
    if name1 is None or name2 is None:
        return None
    one, two = (n.strip(_CONTROLS).upper() for n in (name1, name2))
    if not one or not two:
        return None
    if fold_equal(one, two):
        return EQUAL_SCORE
    plain1, plain2 = folded(one, True), folded(two, True)
    short, long = sorted((plain1, plain2), key=len)
    if long.startswith(short) and long[len(short) :].strip(_CONTROLS).startswith(SUFFIX_STARTS):
        return ALIAS_SCORE
    to1, to2 = mapped(one, aliases), mapped(two, aliases)
    if to1 == to2:
        return ALIAS_SCORE
    parts = parts_score(to1, to2, titles)
    if parts is not None and parts > PARTS_LIMIT:
        return parts
    jaro = jaro_winkler(plain1, plain2)
    if jaro > PARTS_LIMIT:
        return jaro
    top = max(parts or 0.0, jaro)
    if top > LIMIT:
        return top
    few, many = sorted((one, two), key=len)  # as they are spelled, not folded
    return CONTAINED_SCORE if len(few) > 3 and few in many else None


def city_score(a: Column, b: Column, aliases: Mapping[str, str] | None = None, titles: frozenset[str] = frozenset()) -> Column:
    aliases = dict(alias_map() if aliases is None else aliases)

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([match_city(p, q, aliases, titles) for p, q in zip(x, y)], dtype="float64")

    return F.nanvl(score.asNondeterministic()(a, b), F.lit(None).cast("double"))


def map_city(c: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """The place's canonical name in upper case; null and blank as they are."""
    upper = F.upper(trim_controls(c))
    table = F.create_map(*[F.lit(x) for pair in (alias_map() if aliases is None else aliases).items() for x in pair])
    return F.when(upper == "", c).otherwise(F.coalesce(table[upper], upper))


def join_city_aliases(df: DataFrame, column: str, aliases: DataFrame, out: str = "city") -> DataFrame:
    """map_city() by a left join with a table (alias, canonical), both in upper case, for tables of any size."""
    keyed = df.withColumn("_alias", F.upper(trim_controls(F.col(column))))
    joined = keyed.join(aliases.withColumnRenamed("alias", "_alias"), "_alias", "left")
    return joined.withColumn(out, F.when(F.col("_alias") == "", F.col(column)).otherwise(F.coalesce("canonical", "_alias"))).drop("_alias", "canonical")


def city_mapping_count(aliases: Mapping[str, str] | None = None) -> int:
    return len(alias_map() if aliases is None else aliases)


def is_nobiliary_particle(c: Column, titles: list[str]) -> Column:
    return F.coalesce(F.upper(trim_controls(c)).isin([t.upper() for t in titles]) & (trim_controls(c) != ""), F.lit(False))
