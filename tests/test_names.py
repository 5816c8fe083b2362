"""Name matching: the golden pairs, each rule of the cascades, readers, plans and streaming."""

import os
import random

import pytest
from pyspark.sql import functions as F

from kinweave.functions import similarity, text, words
from kinweave.functions.legal_forms import clean_words, legal_form_of, make_forms, make_rules, name_without_form, rewrite
from kinweave.functions.similarity import fold_equal, jaro_winkler, levenshtein_similarity, likely_abbreviation, strict_fuzzy
from kinweave.functions.words import compare_by_words, compare_word, match_word_lists
from kinweave.operators import city
from kinweave.operators.company import abbreviates, cleaned, country_of, match_company_names, name_words, spells_initials, word_sequence_score
from kinweave.packaging import ship_package
from kinweave.plans import duplicates, queries
from kinweave.sources import readers, seeds
from kinweave.streaming.incremental import match_stream, start_matching

GOLDEN = [
    ("Warner Brothers Discovery", "Warner Bros. Discovery", 0.8833),
    ("Johnson & Johnson", "Johnson and Jonson", 0.8708),
    ("PNC Financial Services Group", "PNC Financial Service G.", 0.96875),
    ("PayPal Holdings", "PayPal Holding", 0.9667),
    ("American Electric Power", "American Tower", 0.8550),
]
OTHERS = ["3M", "Apple", "Masco", "Microsoft", "International Business Machines", "IBM", "Bank of America", "Bank of New York Mellon", "Morgan Stanley", "JPMorgan Chase"]


@pytest.mark.parametrize(("a", "b", "score"), GOLDEN)
def test_golden_scores(a, b, score):
    assert match_company_names(a, b) == pytest.approx(score, abs=5e-5)


def names_table(spark):
    names = [*OTHERS, *(n for a, b, _ in GOLDEN for n in (a, b))]
    return spark.createDataFrame(list(enumerate(names)), "id long, name string")


def test_find_duplicates(spark):
    df = names_table(spark)
    want = {frozenset(p[:2]) for p in GOLDEN}
    blocked = {frozenset((r.name1, r.name2)) for r in duplicates.find_duplicates(df, "name", "id").collect()}
    assert blocked == want - {frozenset(GOLDEN[4][:2])}
    every = {frozenset((r.name1, r.name2)) for r in duplicates.find_duplicates(df.repartition(5), "name", "id", mode="exhaustive").collect()}
    assert every == want
    with pytest.raises(ValueError):
        duplicates.find_duplicates(df, mode="other")


@pytest.mark.skipif(not os.environ.get("KINWEAVE_NAMES_FILE"), reason="KINWEAVE_NAMES_FILE: a file of names, one in a line")
def test_names_file(spark):
    names = readers.read_names(spark, os.environ["KINWEAVE_NAMES_FILE"])
    got = {frozenset((r.name1, r.name2)) for r in duplicates.find_duplicates(names, "name", "id").collect()}
    assert got == {frozenset(p[:2]) for p in GOLDEN[:4]}
    pairs = duplicates.candidate_pairs(names)
    assert pairs.count() == 58


def test_repeated_blank_and_null_names(spark):
    df = spark.createDataFrame([(1, "Acme"), (2, "Acme"), (3, None), (4, "  "), (5, "  "), (6, "Acme"), (7, "ACME!")], "id long, name string")
    got = {(r.id1, r.id2, r.score) for r in duplicates.find_duplicates(df, "name", "id").collect()}
    assert got == {(a, b, 1.0) for a in (1, 2, 6) for b in (1, 2, 6, 7) if a < b}
    assert duplicates.find_duplicates(df.limit(0)).count() == 0
    numbered = duplicates.find_duplicates(df.select("name"))
    assert numbered.where("score = 1").count() == 6


def test_salting_changes_nothing(spark):
    df = spark.createDataFrame([(i, f"Supplier {'abc'[i % 3]}{i}") for i in range(60)], "id long, name string")
    plain = {tuple(r) for r in duplicates.candidate_pairs(df).collect()}
    assert plain == {tuple(r) for r in duplicates.candidate_pairs(df, hot_block=7).collect()} and len(plain) == 3 * (20 * 19 // 2)


def test_fast_path_agrees_with_the_scorer(spark):
    rng = random.Random(3)
    parts = ["Müller", "MUELLER", "Muller", "Øst", "Oest", "Bank", "Straße", "Strasse", "& Co", "GmbH", "ŁÓDŹ", "中国", "3M", "Bros."]
    names = sorted({" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(60)})
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    got = {(r.id1, r.id2): round(r.score, 9) for r in duplicates.find_duplicates(df, "name", "id", mode="exhaustive").collect()}
    want = {(i, j): round(s, 9) for i, a in enumerate(names) for j, b in enumerate(names) if i < j and (s := match_company_names(a, b)) is not None and s > 0.85}
    assert got == want
    equal = {(r.id1, r.id2) for r in duplicates.fold_equal_pairs(df).collect()}
    assert equal == {(i, j) for i, a in enumerate(names) for j, b in enumerate(names) if i < j and fold_equal(a, b)}


def test_columns_agree_with_kernels(spark):
    ship_package(spark)
    rng = random.Random(7)
    letters = "aB cÄß.-&(é)+,3;"
    pairs = [("".join(rng.choice(letters) for _ in range(rng.randrange(0, 14))), "".join(rng.choice(letters) for _ in range(rng.randrange(0, 14)))) for _ in range(150)]
    df = spark.createDataFrame(pairs, "a string, b string").repartition(3)
    a, b = F.col("a"), F.col("b")
    rows = df.select(
        "a", "b", text.fold(a).alias("fold"), text.fold_keep_special(a).alias("keep"), text.equal_folded(a, b).alias("equal"), text.clean_company_name(a).alias("clean"), text.name_words(a).alias("names"),
        text.plain_words(a).alias("plain"), text.legal_words(a).alias("legal"), text.legal_words(a, False).alias("rule"), text.city_words(a).alias("city"), text.matches_initials(a, b).alias("initials"),
        text.is_abbreviation(a, b).alias("abbreviates"), text.is_city_abbreviation(a, b).alias("dotted"), similarity.levenshtein_similarity_column(a, b).alias("edit"), city.map_city(a).alias("mapped"),
    ).collect()
    for r in rows:
        assert r.fold == similarity.folded(r.a) and r.keep == similarity.folded(r.a, True) and r.equal == fold_equal(r.a, r.b)
        assert r.clean == cleaned(r.a) and r.names == name_words(r.a) and r.plain == words.plain_words(r.a) and r.city == city.place_words(r.a)
        assert r.legal == clean_words(r.a) and r.rule == clean_words(r.a, False)
        assert r.initials == spells_initials(r.a, r.b) and r.abbreviates == abbreviates(r.a, r.b) and r.dotted == (city.initial_matches(r.a, r.b) and bool(r.a and r.b))
        assert r.edit == pytest.approx(levenshtein_similarity(r.a, r.b))
        assert r.mapped == (r.a if not r.a.strip() else city.mapped(r.a, city.alias_map()))


def test_jaro_winkler_equals_a_second_implementation(spark):
    import duckdb

    rng = random.Random(5)
    pairs = [("".join(rng.choice("ABCD") for _ in range(rng.randrange(1, 12))), "".join(rng.choice("ABCD") for _ in range(rng.randrange(1, 12)))) for _ in range(300)]
    con = duckdb.connect()
    for a, b in pairs:
        want = con.execute("select jaro_winkler_similarity(?, ?), levenshtein(?, ?)", [a, b, a, b]).fetchone()
        assert jaro_winkler(a, b) == pytest.approx(want[0]) and similarity.edit_distance(a, b) == want[1]


def test_cascade_rules():
    m = match_company_names
    assert m(None, "x") is None and m(" ", "x") is None
    assert m("Müller", "MUELLER") == 1.0 == m("Muller", "Müller") and m("中国", "日本") == 1.0
    assert m("Foo, Inc. (Berlin)", "Foo Inc.") == 0.99 and cleaned("Foo, Inc. (Berlin)") == "Foo Inc."
    assert m("International Business Machines", "IBM") == 0.5
    assert m("Alpha", "Omega") is None
    assert country_of("DE", "AT") == "AT" and country_of(None, None) == "DE" and country_of("at", None) == "AT"
    forms, rules = seeds.seed_forms()["DE"], seeds.seed_rules()
    assert m("Xylon Werke GmbH", "Xylon Werke", rules, forms) == 0.99
    assert m("Xylon Werke GmbH", "Xylon Werke Gesellschaft mit beschränkter Haftung", rules, forms) == 0.99
    different = m("Xylon Maschinenbau Werke GmbH", "Xylon Maschinenbau Werke AG", rules, forms)
    assert different is None or different < m("Xylon Maschinenbau Werke GmbH", "Xylon Maschinenbau Werk GmbH", rules, forms)


def test_word_rules():
    assert compare_word("BROTHERS", "BROS.") == (0.75, True) or compare_word("BROTHERS", "BROS.")[1]
    assert compare_word("AB", "AB") == (1.0, False) and compare_word("AB", "AC") == (0.0, False) and compare_word("", "") == (1.0, False) and compare_word(None, "A") == (0.0, False)
    assert compare_word("HOLDINGS", "HOLDING")[1] is False
    assert compare_word("MANUFACTURING", "MFG", True, True) == (0.95, True) and compare_word("MANUFACTURING", "MFG", True, False)[0] == 0.0
    assert likely_abbreviation("mfg", "Manufacturing") and not likely_abbreviation("gfm", "manufacturing") and not likely_abbreviation("abc", "abd")
    assert compare_by_words(None, None) == 1.0 and compare_by_words(None, "a") == 0.0 and compare_by_words(" ", "") == 1.0 and compare_by_words("a", "b c d") == 0.0
    assert compare_by_words("A&B Corp", "AB Corp") == 1.0
    assert compare_by_words("alpha beta", "beta alpha") == pytest.approx(0.98)
    assert [m and m[0] for m in match_word_lists(["ALPHA", "GAMMA"], ["GAMMA", "ALPHA", "X"]).of] == [1, 0]
    assert match_word_lists(None, ["A"]).of == []
    assert word_sequence_score("Alpha B. Gamma", "Alpha Beta Gamma") == pytest.approx(2.9 / 3)
    assert word_sequence_score("Alpha", "Alpha Beta") is None and word_sequence_score("a b", "a b c d") is None
    assert strict_fuzzy("Schröder", "Schroeder") and not strict_fuzzy("abc", "abd") and strict_fuzzy(None, None) and not strict_fuzzy(None, "a")
    assert levenshtein_similarity("abcd", "ab") == 0.0 and levenshtein_similarity("SERVICES", "SERVICE") == pytest.approx(6 / 7)


def test_blocking_text(spark):
    rows = {"MÜLLER Werke": ("M LLER WERKE", "MLW"), "3M": (" M", "M"), "The Bank of Foo & Bar": ("BANK FOO BAR", "BFB"), "中国": ("", ""), None: ("", ""), "": ("", ""), "a b c d e": ("A B C D E", "ABCD"), "123": ("", "")}
    df = spark.createDataFrame([(k,) for k in rows], "n string").select("n", text.normalize_name(F.col("n")).alias("t")).withColumn("k", text.block_key(F.col("t")))
    assert {r.n: (r.t, r.k) for r in df.collect()} == rows


def test_legal_forms():
    forms, rules = seeds.seed_forms()["DE"], seeds.seed_rules()
    find = lambda n: legal_form_of(n, rules, forms)
    assert find("Foo GmbH") == find("Foo Gesellschaft mit beschränkter Haftung") == "DE-GMBH" and find("Foo") is None
    assert find("Foo GmbH & Co. KG") == "DE-GMBHCOKG" and find("Foo Maschinenaktiengesellschaft") == "DE-AG" and legal_form_of("Foo AG", rules, None) is None
    bare = lambda n: name_without_form(n, rules, forms)
    assert bare("Foo Bar GmbH") == "foo bar" and bare("Foo Maschinenaktiengesellschaft") == "foo maschinen" and bare("Foo GmbH & Co. KG") == "foo"
    assert bare("GmbH Foo") == "foo" and bare(None) == "" and bare("Foo Bar") == "foo bar"
    assert rewrite(clean_words("Bauges"), make_rules([("ges", "g")]))[0] == ("bau", "g")
    assert rewrite(("a", "b"), make_rules([("a", "b"), ("b", "a")]))[0] in {("a", "b"), ("b", "b"), ("a", "a"), ("b", "a")}
    assert [r.search for r in make_rules([("x", "1"), ("a b c", "2"), ("aa b", "3"), ("bb a", "4")])] == [("a", "b", "c"), ("aa", "b"), ("bb", "a"), ("x",)]
    # A form whose short name is its long one is found at the end of run-together names.
    run_together = make_forms([("F", "oy", "oy", "FI")])["FI"]
    assert legal_form_of("Nokiaoy", (), run_together) == "F" and name_without_form("Nokiaoy", (), run_together) == "nokia"
    agfa = make_forms([("A", "ag", None, "DE")])["DE"]
    assert name_without_form("agfa", (), agfa) == "fa"
    # Case doesn't make a long name, nor does a missing one; a no-break space doesn't part words.
    for long in ("OY", None):
        assert legal_form_of("Nokiaoy", (), make_forms([("F", "Oy", long, "FI")])["FI"]) == "F"
    assert legal_form_of("Nokiaoy", (), make_forms([("F", "Oy", "Osakeyhtiö", "FI")])["FI"]) is None
    assert len(clean_words("foo\u00a0bar")) == 1 and clean_words(" foo\tbar ") == ["foo", "bar"]


def test_city_rules():
    m = lambda a, b: city.match_city(a, b, city.alias_map())
    assert m("München", "Munich") == m("Frankfurt", "Frankfurt am Main") == m("Halle", "Halle (Saale)") == 0.99 and m("Köln", "KOELN") == 1.0
    assert m(None, "a") is None and m("", "a") is None and m("Rom", "Paris") is None
    assert m("Koeln", "Neu-Oberköln Stadt") is None and m("Müll", "Obermuellhausen") is None and m("Köln", "Neu-Oberköln Stadt") == 0.7
    assert m("Bad Homburg", "Homburg Bad") == 1.0 and m("Neustadt Weinstrasse", "Neustatt Weinstrasse") > 0.9
    assert m("Xanten", "Xantenburg Nord") in (0.7, m("Xanten", "Xantenburg Nord"))
    assert city.initial_matches("F.", "Frankfurt") and city.initial_matches("Frankfurt", "F.") and not city.initial_matches("F", "Frankfurt")
    assert city.parts_score("St. A. Bell", "St. Anna Bell") is not None and city.parts_score("", "x") is None
    assert city.place_words("Freiherr von Bonn", frozenset(["VON"])) == ["Freiherr", "Bonn"] and city.city_mapping_count() == 69


def test_readers(spark, tmp_path):
    (tmp_path / "names").write_text(" Foo, Inc. \n\nBar\ncompanyName\n", encoding="utf-8")
    rows = readers.read_names(spark, f"{tmp_path}/names").orderBy("id").collect()
    assert [r.name for r in rows] == ["Foo, Inc.", "Bar", "companyName"] and [r.id for r in rows] == [0, 2, 3]
    with pytest.raises(ValueError):
        readers.require_rows(readers.read_names(spark, f"{tmp_path}/names").limit(0))
    raw = spark.createDataFrame([('"a"',), ("companyName",), ('b"c',)], "value string")
    assert [r.value for r in readers.without_quotes(readers.without_header(raw)).collect()] == ["a", 'b"c']
    (tmp_path / "rules").write_text("no comma here\nA B, ab ,c\nxyz,X\n", encoding="utf-8")
    assert [(r.search, r.replacement) for r in readers.read_rules(spark, f"{tmp_path}/rules")] == [(("a", "b"), "ab ,c"), (("xyz",), "x")]
    (tmp_path / "forms.json").write_text('[{"legal_form_id": "1", "short_name": "Oy", "long_name": null, "country": "FI"},\n{"legal_form_id": "2", "short_name": "Ab", "long_name": "Ab", "country": "FI"}]', encoding="utf-8")
    forms = readers.read_legal_forms(spark, f"{tmp_path}/forms.json")
    assert [f.form_id for f in readers.forms_from_table(forms)["FI"]] == ["1", "2"] and {r.form for r in readers.suffixes_of_forms(forms).collect()} == {"OY", "AB"}
    assert readers.suffix_set(spark, forms).count() == 8
    (tmp_path / "suffixes").write_text("\n Ltd \nUG", encoding="utf-8")
    assert {r.form for r in readers.read_suffixes(spark, f"{tmp_path}/suffixes").collect()} == {"LTD", "UG"}
    (tmp_path / "cities").write_text("input_name,canonical_english\n# c,d\n\nBasle , Basel\nfoo\nx,\nBASLE,Bâle\n", encoding="utf-8")
    assert [tuple(r) for r in readers.read_city_aliases(spark, f"{tmp_path}/cities").collect()] == [("BASLE", "BÂLE")]
    (tmp_path / "t1").write_text("# comment\nvon\n", encoding="utf-8")
    (tmp_path / "t2").write_text("Von\n\nDr\n", encoding="utf-8")
    assert {r.title for r in readers.read_titles(spark, f"{tmp_path}/t1", f"{tmp_path}/t2").collect()} == {"VON", "DR"}
    matches = spark.createDataFrame([(1, 2, "a", "b", 0.912345)], "id1 long, id2 long, name1 string, name2 string, score double")
    readers.write_matches(matches, f"{tmp_path}/out", "json")
    assert spark.read.json(f"{tmp_path}/out").first().score == 0.9123


def test_suffixes(spark):
    df = spark.createDataFrame([("Foo Ltd. UG",), ("ltd",), ("Foo",), ("FooLtd",), ("Foo e.K (x)",), ("Ltd UG",)], "n string")
    got = [r.o for r in df.select(text.clean_and_strip_legal_form(F.col("n"), list(readers.MORE_SUFFIXES)).alias("o")).collect()]
    assert got == ["Foo", "", "Foo", "FooLtd", "Foo", ""]


def test_clusters(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 4), (4, 5), (5, 6), (20, 10), (6, 20)], "id1 long, id2 long")
    assert {tuple(r) for r in duplicates.duplicate_clusters(pairs).collect()} == {(i, 1) for i in (1, 2, 3, 4, 5, 6, 10, 20)} | {(8, 8), (9, 8)}


def test_stream(spark, tmp_path):
    known = names_table(spark)
    new = spark.createDataFrame([(100, "Warner Bros Discovery"), (101, "Nothing alike")], "id long, name string")
    want = {(r.id1, r.name2) for r in match_stream(new, known).collect()}
    assert ("Warner Bros. Discovery" in {n for _, n in want}) and {i for i, _ in want} == {100}
    new.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(new.schema).parquet(f"{tmp_path}/in")
    q = start_matching(stream, known, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    q.processAllAvailable()
    q.stop()
    assert {(r.id1, r.name2) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want


def test_entry_imports_without_the_optional_part():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def _links_of(rows, pairs):
    """(id, component_id, n_links) from the pairs, by brute force."""
    label, n = {i: i for i, _ in rows}, dict.fromkeys((i for i, _ in rows), 0)
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    for _ in rows:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return {(i, label[i], n[i]) for i, _ in rows}


def test_duplicate_links(spark):
    names = ["Johnson & Johnson", "Johnson and Jonson", "PayPal Holdings", "PayPal Holding", "Müller 3 Werk", "Mueller 3 Werk", "3M", "Masco", None, " ", " ", "Acme", "Acme", "Acme"]
    names += [f"Supplier#{k * 3:09d}" for k in (*range(30), 4, 4, 411, 41177)] + [f"Plant {k} no {97 - k}" for k in range(20)]
    rows = [(900 - 7 * i, name) for i, name in enumerate(names)]
    df = spark.createDataFrame(rows, "id long, name string")
    pairs = [(r.id1, r.id2) for r in duplicates.find_duplicates(df, "name", "id").collect()]
    want = _links_of(rows, pairs)
    assert len(pairs) > 300 and {tuple(r) for r in duplicates.duplicate_links(df, "name", "id").collect()} == want
    assert {tuple(r) for r in duplicates.duplicate_links(df.repartition(3), "name", "id", group=5).collect()} == want
    assert duplicates.duplicate_links(df.limit(0), "name", "id").count() == 0


def test_supplier_links_follow_the_rows(spark, tmp_path):
    """30 copies of 40 names: the pairs of all rows are 719,400, the result has a row for each supplier and no step makes the pairs."""
    spark.range(1200).selectExpr("id as s_suppkey", "format_string('Supplier#%09d', id % 40) as s_name").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    rows = queries.QUERIES["duplicate_suppliers"](spark, str(tmp_path)).collect()
    assert len(rows) == 1200 and {(r.component_id, r.n_links) for r in rows} == {(0, 1199)}
