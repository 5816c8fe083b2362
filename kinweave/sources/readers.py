"""Readers of names, rewrite rules, legal forms, suffixes, aliases and titles; and the cleaning of raw downloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.functions.legal_forms import LegalForm, Rule, make_forms, make_rules
from kinweave.functions.text import trim_controls

# Further suffixes of company names.
MORE_SUFFIXES = ("e.K", "eingetragener Kaufmann", "gemeinützige Gesellschaft mit beschränkter Haftung", "Ltd", "Ltd.", "UG")
FORM_SCHEMA = "legal_form_id string, short_name string, long_name string, country string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): line numbers within a file, consecutive, from one scan.

    Spark numbers rows per partition; the offsets of the partitions come from their counts.
    """
    rows = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))
    # The id's upper bits are the partition, the lower ones the row in it: its order is the file's.
    part = F.shiftright("at", 33)
    counts = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("part", before.alias("before"))
    numbered = rows.withColumn("part", part).join(F.broadcast(offsets), "part")
    return numbered.select((F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("line_no"), "value")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(id, name): one name per line, trimmed, blank lines dropped, in file order. Commas are part of names."""
    return _lines(spark, path).select(F.col("line_no").alias("id"), trim_controls(F.col("value")).alias("name")).where("name <> ''")


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("no names found")
    return df


def without_header(lines: DataFrame, column: str = "value", header: str = "companyName") -> DataFrame:
    """Drop every line that is the header."""
    return lines.where(F.col(column) != header)


def without_quotes(lines: DataFrame, column: str = "value") -> DataFrame:
    """Drop one quote at the start and one at the end of each line."""
    return lines.withColumn(column, F.regexp_replace(column, '^"|"$', ""))


def _first_comma(column: str = "value") -> tuple[F.Column, F.Column]:
    parts = F.split(column, ",", 2)
    return trim_controls(F.get(parts, 0)), trim_controls(F.get(parts, 1))


def read_rules_table(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, search, replacement): cut at the first comma; lines without one are skipped."""
    search, replacement = _first_comma()
    return _lines(spark, path).where(F.col("value").contains(",")).select("line_no", search.alias("search"), replacement.alias("replacement"))


def read_rules(spark: SparkSession, path: str) -> tuple[Rule, ...]:
    """Rewrite rules in rank order. A rule file is a few hundred lines and travels with the functions that use it."""
    rows = read_rules_table(spark, path).orderBy("line_no").collect()
    return make_rules((r.search, r.replacement) for r in rows)


def forms_from_table(table: DataFrame) -> dict[str, tuple[LegalForm, ...]]:
    """Legal forms by country from (legal_form_id, short_name, long_name, country); a dictionary-sized table."""
    return make_forms((r.legal_form_id, r.short_name, r.long_name, r.country) for r in table.collect())


def read_legal_forms(spark: SparkSession, path: str) -> DataFrame:
    """Legal forms from a JSON array. A long name that is null in the file reads as the text "null", one that is absent as null."""
    records = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<map<string,string>>")).alias("form"))
    fields = {name: F.col("form")[name] for name in ("legal_form_id", "short_name", "long_name", "country")}
    fields["long_name"] = F.when(F.map_contains_key("form", "long_name"), F.coalesce(fields["long_name"], F.lit("null")))
    return records.select(*[value.alias(name) for name, value in fields.items()])


def suffixes_of_forms(forms: DataFrame) -> DataFrame:
    """(form): short and long names in upper case, distinct; the text "null" is none."""
    names = forms.select(F.explode(F.array("short_name", "long_name")).alias("form"))
    return names.where("form is not null and form <> 'null' and form <> ''").select(F.upper("form").alias("form")).distinct()


def read_suffixes(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.upper(trim_controls(F.col("value"))).alias("form"))
    return lines.where("form <> ''").distinct()


def suffix_set(spark: SparkSession, forms: DataFrame | None = None, more: tuple[str, ...] = MORE_SUFFIXES) -> DataFrame:
    """(form): the suffixes of the forms and the further ones."""
    out = spark.createDataFrame([(m.upper(),) for m in more], "form string")
    return (out if forms is None else out.unionByName(suffixes_of_forms(forms))).distinct()


def read_city_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(alias, canonical) in upper case; comments, blank lines, the header and lines without both parts are skipped, the last of equal aliases counts."""
    alias, canonical = _first_comma()
    lines = _lines(spark, path).withColumn("value", trim_controls(F.col("value")))
    lines = lines.where(~F.col("value").startswith("#") & ~F.col("value").startswith("input_name,") & F.col("value").contains(","))
    pairs = lines.select("line_no", F.upper(alias).alias("alias"), F.upper(canonical).alias("canonical")).where("alias <> '' and canonical <> ''")
    return pairs.groupBy("alias").agg(F.max_by("canonical", "line_no").alias("canonical"))


def read_titles(spark: SparkSession, *paths: str) -> DataFrame:
    """(title): distinct titles in upper case from files with comments."""
    lines = spark.read.text(list(paths)).select(trim_controls(F.col("value")).alias("value"))
    return lines.where("value <> '' and not startswith(value, '#')").select(F.upper("value").alias("title")).distinct()


def write_matches(matches: DataFrame, path: str, format: str = "parquet") -> None:
    """Sink for pairs: any of Spark's formats; CSV and JSON round scores to four places as the printed list does."""
    out = matches if format == "parquet" else matches.withColumn("score", F.round("score", 4))
    out.write.format(format).mode("errorifexists").save(path)
