"""Queries over the test tables, one for each operator, and the same in DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import similarity, text, words
from kinweave.operators import city, company
from kinweave.packaging import ship_package
from kinweave.plans import duplicates
from kinweave.sources import readers, seeds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
TITLES = ("DR", "PROF", "VON", "VAN", "DE", "DER", "LA", "THE")
SUFFIXES = ("GmbH", "AG", "Gesellschaft mit beschränkter Haftung", "Aktiengesellschaft", "KG", "GmbH & Co. KG", "")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL pieces.
def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


def _clean(x: str) -> str:
    bracket = _trim(rf"regexp_replace({_trim(x)}, '\s*\([^)]+\)\s*$', '')")
    return _trim(f"translate({bracket}, ',:;', '')")


def _upper(x: str) -> str:
    return f"upper(replace({x}, 'ß', 'SS'))"


def _swap(x: str, table: dict[str, str]) -> str:
    for a, b in table.items():
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _fold(x: str, keep: bool = False, table: dict[str, str] | None = None) -> str:
    out = f"strip_accents({_swap(_upper(x), text.EXTENDED_FOLD if table is None else table)})"
    # strip_accents also folds letters that have no decomposition; the tables have none of them.
    return out if keep else f"regexp_replace({out}, '[^A-Z0-9]', '', 'g')"


def _variants(x: str) -> str:
    return f"[{', '.join(_fold(x, table=t) for t in ({}, text.EXTENDED_FOLD, text.SIMPLE_FOLD))}]"


def _split(x: str, pattern: str) -> str:
    return f"list_filter(string_split_regex({x}, '{pattern}'), lambda w: w <> '')"


def _name_words(x: str) -> str:
    return _split(f"replace({x}, '.', '. ')", r"[\s\-]+")


def _normalized(x: str) -> str:
    parts = rf"string_split_regex(regexp_replace({_upper(_clean(x))}, '[^A-Z\s]', ' ', 'g'), '\s+')"
    stop = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
    kept = f"list_filter(list_filter({parts}, lambda w, i: w <> '' OR i = 1), lambda w: w NOT IN ({stop}))"
    return f"coalesce(CASE WHEN len(list_filter({kept}, lambda w: w <> '')) = 0 THEN '' ELSE array_to_string({kept}, ' ') END, '')"


def _key(x: str) -> str:
    return f"substr(array_to_string(list_transform(list_filter(string_split({x}, ' '), lambda w: w <> ''), lambda w: w[1]), ''), 1, {text.KEY_LENGTH})"


def _lev(a: str, b: str) -> str:
    short, long = f"least(length({a}), length({b}))", f"greatest(length({a}), length({b}))"
    return f"CASE WHEN {a} = {b} THEN 1.0 WHEN {short} = 0 OR {short} / {long} <= 0.5 THEN 0.0 ELSE 1.0 - least(levenshtein({a}, {b}), {short}) / {short} END::DOUBLE"


def _on_documents(name: str, column: Callable[[Column], Column], sql: str) -> None:
    """A query of a per-row function over all whole texts."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _table(spark, sf_dir, "documents").select("doc_id", column(F.col("text")).alias("out"))

    run.__name__ = name
    query(f"SELECT doc_id, {sql} AS out FROM documents")(run)


def _legal(x: str, plus: bool) -> str:
    lower = f"replace(lower(replace({x}, 'ẞ', 'ß')), '&', ' u ')"
    lower = f"replace({lower}, '+', ' u ')" if plus else lower
    plain = rf"""regexp_replace(regexp_replace({lower}, '[;$.,_#+*§"!?-]', ' ', 'g'), '\([^)]*\)', ' ', 'g')"""
    folded = f"list_filter(list_transform({_split(plain, chr(92) + 's+')}, lambda v: lower({_fold('v')})), lambda v: v <> '')"
    return f"array_to_string(list_transform({folded}, lambda v: CASE WHEN v = 'und' THEN 'u' ELSE v END), '|')"


_joined = lambda f: lambda c: F.array_join(f(c), "|")
_on_documents("strip_brackets", text.remove_brackets, _trim(r"regexp_replace(text, '\s*\([^)]+\)\s*$', '')"))
_on_documents("strip_punctuation", text.remove_punctuation, "translate(text, ',:;', '')")
_on_documents("clean_name", text.clean_company_name, _clean("text"))
_on_documents("fold_letters", text.fold, _fold("text"))
_on_documents("fold_keep_special", text.fold_keep_special, _fold("text", keep=True))
_on_documents("fold_variants", _joined(text.fold_variants), f"array_to_string({_variants('text')}, '|')")
_on_documents("name_words", _joined(text.name_words), f"array_to_string({_name_words('text')}, '|')")
_on_documents("plain_words", _joined(text.plain_words), rf"array_to_string({_split('''replace(text, '&', '')''', r'[\s\-/]+')}, '|')")
_on_documents("legal_words", _joined(text.legal_words), _legal("text", True))
_on_documents("legal_rule_words", _joined(lambda c: text.legal_words(c, False)), _legal("text", False))
_on_documents("normalize_name", text.normalize_name, _normalized("text"))
_on_documents("name_initials", text.initials_of, _upper(f"array_to_string(list_transform({_name_words('text')}, lambda w: w[1]), '')"))
_titles = ", ".join(f"'{t}'" for t in TITLES)
_on_documents(
    "city_words", _joined(lambda c: text.city_words(c, list(TITLES))),
    rf"array_to_string(list_filter({_split('''replace(text, '.', '. ')''', r'[\s\-/]+')}, lambda w: {_upper('w')} NOT IN ({_titles})), '|')",
)


@query(f"SELECT p_partkey, {_normalized('p_name')} AS normalized, {_key(_normalized('p_name'))} AS key FROM part")
def block_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    normalized = text.normalize_name(F.col("p_name"))
    return _table(spark, sf_dir, "part").select("p_partkey", normalized.alias("normalized")).withColumn("key", text.block_key(F.col("normalized")))


@query(f"SELECT {_key(_normalized('c_name'))} AS key, count(*) AS n, count(*) * (count(*) - 1) / 2 AS pairs FROM customer GROUP BY 1")
def block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.block_stats(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name) of the distinct part names; the id is the smallest part key."""
    return _table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id")).select("id", "name")


_NAMES = "names AS (SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY p_name)"
_SHARE = "list_bool_or(list_transform(a.words, lambda x: list_bool_or(list_transform(b.words, lambda y: starts_with(x, y) OR starts_with(y, x)))))"
_CANDIDATES = (
    f"{_NAMES}, n1 AS (SELECT id, name, {_normalized('name')} AS norm FROM names), n2 AS (SELECT *, {_key('norm')} AS key, string_split_regex(norm, '\\s+') AS words FROM n1), "
    f"pairs AS (SELECT a.id AS id1, b.id AS id2, a.name AS name1, b.name AS name2 FROM n2 a JOIN n2 b ON a.key = b.key AND a.id < b.id AND {_SHARE})"
)


@query(f"WITH {_CANDIDATES} SELECT * FROM pairs")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.candidate_pairs(part_names(spark, sf_dir))


@query(f"WITH {_NAMES} SELECT a.id AS id1, b.id AS id2, a.name AS name1, b.name AS name2 FROM names a JOIN names b ON a.id < b.id")
def exhaustive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.all_pairs(part_names(spark, sf_dir))


@query(
    f"WITH {_NAMES}, more AS (SELECT id, name FROM names UNION ALL SELECT -id, upper(replace(name, ' ', '-')) FROM names), v AS (SELECT id, name, unnest({_variants('name')}) AS f FROM more) "
    "SELECT DISTINCT a.id AS id1, b.id AS id2, a.name AS name1, b.name AS name2 FROM v a JOIN v b ON a.f = b.f AND a.id < b.id"
)
def fold_equal_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = part_names(spark, sf_dir)
    other = names.select((-F.col("id")).alias("id"), F.upper(F.replace("name", F.lit(" "), F.lit("-"))).alias("name"))
    return duplicates.fold_equal_pairs(names.unionByName(other))


_PAIRS = f"WITH {_NAMES}, pairs AS (SELECT a.id AS id1, b.id AS id2, a.name AS a, b.name AS b FROM names a JOIN names b ON a.id < b.id)"


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.all_pairs(part_names(spark, sf_dir)).withColumnsRenamed({"name1": "a", "name2": "b"})


def _on_pairs(name: str, column: Callable[[Column, Column], Column], sql: str | None) -> None:
    """A query of a pair function over all pairs of part names."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return name_pairs(spark, sf_dir).select("id1", "id2", column(F.col("a"), F.col("b")).alias("out"))

    run.__name__ = name
    query(sql and f"{_PAIRS} SELECT id1, id2, {sql} AS out FROM pairs")(run)


_rounded = lambda f: lambda a, b: F.round(f(a, b), 9)
_on_pairs("levenshtein_similarity", _rounded(similarity.levenshtein_similarity_column), f"round({_lev('a', 'b')}, 9)")
_on_pairs("jaro_winkler_similarity", _rounded(similarity.jaro_winkler_column), "round(jaro_winkler_similarity(a, b), 9)")
_on_pairs("strict_fuzzy_match", similarity.strict_fuzzy_column, f"{_fold('a')} = {_fold('b')} OR (least(length({_fold('a')}), length({_fold('b')})) >= 4 AND jaro_winkler_similarity({_fold('a')}, {_fold('b')}) >= 0.94)")
_on_pairs("equal_folded", text.equal_folded, f"list_has_any({_variants('a')}, {_variants('b')})")
_on_pairs("word_sequence_score", _rounded(company.word_sequence_column), None)
_on_pairs("compare_by_words", _rounded(words.compare_by_words_column), None)
_on_pairs("company_score", _rounded(company.company_score), None)
_on_pairs("city_score", _rounded(city.city_score), None)

# The first letters of a part's name, the first letter, and the letter with a dot, against the name.


@query(
    f"WITH p AS (SELECT p_partkey, p_name, upper(array_to_string(list_transform({_name_words('p_name')}, lambda w: w[1]), '')) AS letters FROM part) "
    "SELECT p_partkey, true AS initials, true AS letter, true AS dotted, length(p_name) > length(letters) AND length(letters) = 1 AS whole, true AS city FROM p"
)
def abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, letter = F.col("p_name"), F.substring("p_name", 1, 1)
    letters = text.initials_of(name)
    return _table(spark, sf_dir, "part").select(
        "p_partkey", text.matches_initials(name, letters).alias("initials"), text.is_abbreviation(name, letter).alias("letter"), text.is_abbreviation(name, F.concat(letter, F.lit("."))).alias("dotted"),
        text.is_abbreviation(name, letters).alias("whole"), text.is_city_abbreviation(name, F.concat(letter, F.lit("."))).alias("city"),
    )


@query(
    "WITH p AS (SELECT p_partkey, lower(p_name) AS long, lower(p_name[1] || p_name[3:4] || p_name[length(p_name):]) AS short FROM part) SELECT p_partkey, true AS kept, "
    "CASE WHEN length(long) = length(short) THEN false ELSE list_reduce(['!' || long] || string_split(reverse(short), ''), lambda rest, c: CASE WHEN rest[1] = '!' AND instr(rest[2:], c) > 0 "
    "THEN '!' || substr(rest[2:], instr(rest[2:], c) + 1) ELSE '' END)[1:1] = '!' AND long[1] = reverse(short)[1] END AS turned FROM p"
)
def likely_abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.concat(F.substring("p_name", 1, 1), F.substring("p_name", 3, 2), F.expr("right(p_name, 1)"))
    return _table(spark, sf_dir, "part").select(
        "p_partkey", similarity.likely_abbreviation_column(F.col("p_name"), short).alias("kept"), similarity.likely_abbreviation_column(F.col("p_name"), F.reverse(short)).alias("turned")
    )


@query()
def compare_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_pairs(spark, sf_dir).select("id1", "id2", words.compare_word_column(F.col("a"), F.col("b")).alias("out")).select("id1", "id2", "out.score", "out.cut")


@query()
def match_word_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = [F.split(c, " ") for c in ("a", "b")]
    return name_pairs(spark, sf_dir).select("id1", "id2", F.to_json(words.match_word_lists_column(*lists)).alias("matches"))


@query()
def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likely duplicates among the distinct part names, by blocks."""
    return duplicates.find_duplicates(part_names(spark, sf_dir), "name", "id")


@query()
def duplicate_names_exhaustive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.find_duplicates(part_names(spark, sf_dir), "name", "id", mode="exhaustive")


@query()
def duplicate_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All near-identical supplier names share one block: a row for each supplier, with its class and its number of links."""
    links = duplicates.duplicate_links(_table(spark, sf_dir, "supplier"), "s_name", "s_suppkey")
    return links.withColumnRenamed("id", "s_suppkey")


@query()
def duplicate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.duplicate_clusters(duplicate_names_exhaustive(spark, sf_dir))


def formed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, name): part names with a legal form of SUFFIXES in turn."""
    form = F.get(F.array(*[F.lit(s) for s in SUFFIXES]), (F.col("p_partkey") % len(SUFFIXES)).cast("int"))
    return _table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", F.initcap("p_name"), F.nullif(form, F.lit(""))).alias("name"))


_FORM_IDS = ("DE-GMBH", "DE-AG", "DE-GMBH", "DE-AG", "DE-KG", "DE-GMBHCOKG", None)


@query(f"SELECT p_partkey, ([{', '.join('NULL' if f is None else repr(f) for f in _FORM_IDS)}])[1 + p_partkey % {len(SUFFIXES)}] AS form FROM part")
def legal_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formed_names(spark, sf_dir).select("p_partkey", company.legal_form_column(F.col("name"), seeds.seed_rules(), seeds.seed_forms()).alias("form"))


@query("SELECT p_partkey, lower(p_name) AS bare FROM part")
def name_without_legal_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formed_names(spark, sf_dir).select("p_partkey", company.name_without_form_column(F.col("name"), seeds.seed_rules(), seeds.seed_forms()).alias("bare"))


_REWRITTEN = ("gmbh", "ag", "gmbh", "ag", "kg", "gmbh u co kg", "")


@query(f"SELECT p_partkey, trim(lower(p_name) || ' ' || ([{', '.join(map(repr, _REWRITTEN))}])[1 + p_partkey % {len(SUFFIXES)}]) AS out FROM part")
def normalize_legal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formed_names(spark, sf_dir).select("p_partkey", F.array_join(company.normalize_legal_column(F.col("name"), seeds.seed_rules()), " ").alias("out"))


_SUFFIX_LIST = sorted({s.upper() for s in readers.MORE_SUFFIXES} | {x.upper() for f in seeds.SEED_FORMS for x in f[1:3]}, key=lambda s: (-len(s), s))


@query(f"SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE s_name END AS bare, {_clean('''CASE WHEN s_suppkey % 5 = 0 THEN 'Ltd. UG' ELSE s_name || ', Ltd. (Berlin)' END''')} AS cleaned, upper(s_name) IN ('UG') AS is_form, 17 AS forms FROM supplier".replace("17", str(len(_SUFFIX_LIST))))
def strip_legal_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = readers.suffix_set(spark, spark.createDataFrame(list(seeds.SEED_FORMS), readers.FORM_SCHEMA))
    listed = [r.form for r in forms.collect()]
    name = F.expr("CASE WHEN s_suppkey % 5 = 0 THEN 'Ltd. UG' ELSE s_name || ', Ltd. (Berlin)' END")  # a name of forms alone has nothing left
    return _table(spark, sf_dir, "supplier").select(
        "s_suppkey", text.clean_and_strip_legal_form(name, listed).alias("bare"), text.clean_company_name(name).alias("cleaned"), F.upper("s_name").isin(listed).alias("is_form"), F.lit(len(listed)).alias("forms")
    )


_ALIASES = ", ".join(f"('{a.upper()}', '{b.upper()}')" for a, b in city.alias_map().items())


# Places of which some have an alias.
_PLACES = "CASE n_nationkey % 4 WHEN 0 THEN 'München' WHEN 1 THEN 'köln' WHEN 2 THEN 'Nürnberg' ELSE n_name END"


@query(f"WITH alias(a, c) AS (VALUES {_ALIASES}), n AS (SELECT n_nationkey, {_PLACES} AS n_name FROM nation) SELECT n_nationkey, n_name, coalesce(c, upper(n_name)) AS city FROM n LEFT JOIN alias ON a = upper(n_name)")
def city_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.createDataFrame(list(city.alias_map().items()), "alias string, canonical string")
    return city.join_city_aliases(_table(spark, sf_dir, "nation").select("n_nationkey", F.expr(_PLACES).alias("n_name")), "n_name", table)


@query(f"WITH alias(a, c) AS (VALUES {_ALIASES}) SELECT n_nationkey, coalesce(c, upper(trim({_PLACES}))) AS city, {city.city_mapping_count()} AS aliases FROM nation LEFT JOIN alias ON a = upper(trim({_PLACES}))")
def map_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation").select("n_nationkey", city.map_city(F.expr(_PLACES)).alias("city"), F.lit(city.city_mapping_count()).alias("aliases"))


@query(f"SELECT conv_id, turn, role, {_upper('role')} IN ({_titles}) AS particle, {_upper(chr(39) + 'von' + chr(39))} IN ({_titles}) AS von FROM conversations")
def nobiliary_particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", city.is_nobiliary_particle(F.col("role"), list(TITLES)).alias("particle"), city.is_nobiliary_particle(F.lit("von"), list(TITLES)).alias("von"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["duplicate_suppliers"](spark, sf_dir)
