"""Line dedup against brute force: every line against all earlier ones."""

import random

import pytest

from kinweave.llm import line_dedup
from kinweave.llm.line_dedup import dedup_lines, line_removals, op1_lines


def near(a, b):
    """Whether a and b are one edit apart at most."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :]
    return a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


def brute(rows, edits=1, min_chars=6):
    lines = sorted(((i is None, i or 0, n, part.strip(" \t\n\r\x0b\x0c")) for i, text in rows for n, part in enumerate((text or "").split("\n"))), key=lambda x: x[:3])
    out = set()
    for k, (last, i, n, line) in enumerate(lines):
        if len(line) < min_chars:
            continue
        earlier = (x for x in lines[:k] if x[:3] < (last, i, n) and len(x[3]) >= min_chars)
        if any(line == x[3] if not edits else near(line, x[3]) for x in earlier):
            out.add((None if last else i, n))
    return out


def edited(rng, line):
    k, c = rng.randrange(len(line)), rng.choice("abäñ€𝄞")
    return rng.choice([line[:k] + c + line[k + 1 :], line[:k] + line[k + 1 :], line[:k] + c + line[k:], line])


def rows_of(seed, n=60):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé ") for _ in range(rng.randrange(4, 16))).strip() or "x" for _ in range(12)]
    rows = []
    for i in range(n):
        lines = [edited(rng, rng.choice(base)) if rng.random() < 0.8 else "".join(rng.choice("abcdefg") for _ in range(20)) for _ in range(rng.randrange(0, 6))]
        rows.append((i if i % 17 else None, "\n".join(("  " if rng.random() < 0.2 else "") + x for x in lines) if i % 13 else None))
    return rows + [rows[3], (500, ""), (501, "long " * 20000)]


def test_removals_equal_brute_force(spark):
    for seed, edits in ((1, 1), (2, 1), (3, 0), (4, 1)):
        rows = rows_of(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        removals, sizes = line_removals(df, edits, 6)
        assert {(r.doc_id, r.line) for r in removals.collect()} == brute(rows, edits)
        assert {r.doc_id for r in sizes.collect()} == {i for i, _ in rows}


def test_documents_keep_columns_and_lose_lines(spark):
    rows = [(1, "same line of some length\nother words that stay here", "a", 1), (2, "same line of some lengths\nnew and different content", "b", 2), (3, "same line of some length", "c", 3), (4, None, "d", 4), (5, "", None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, line int")
    out = {r.doc_id: r for r in dedup_lines(df, min_chars=10).collect()}
    assert set(out) == {1, 2, 4, 5}
    assert out[2].text == "new and different content" and out[2].line == 2 and out[4].text is None


def test_short_lines_lose_exact_copies_by_default(spark):
    rows = [(1, "Ietzte.\ncat\n\n7\nStteen Erachtz."), (2, "Ietzte.\ncar\n\n7\nStteen Erachtz.\nStteen Erachtx."), (3, "cat\n8\nIetzte!")]
    removals, _ = line_removals(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.doc_id, r.line) for r in removals.collect()} == {(2, 0), (2, 3), (2, 4), (2, 5), (3, 0), (3, 2)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    removals, sizes = line_removals(df)
    assert removals.count() == 0 and sizes.count() == 0 and dedup_lines(df).count() == 0


def test_rows_that_share_an_id_keep_their_own_lines(spark):
    rows = [(5, "a line that both rows have\nonly in the first one"), (5, "something else altogether\na line that both rows have\nonly in the second one"), (None, "a line that both rows have\nand null"), (None, "and nul")]
    out = sorted(r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert sum("a line that both rows have" in x for x in out) == 1
    assert sum("only in the" in x for x in out) == 2 and sum("something else" in x for x in out) == 1 and sum("and nul" in x for x in out) == 1


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(i, t) for i, t in rows_of(9) if i is not None]
    rows = list({i: (i, t) for i, t in rows}.values())
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    gone = brute(rows, 1, 6) | brute(rows, 0, 1)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.removed_lines) for r in op1_lines(spark, str(tmp_path)).collect()}
    for i, text in rows:
        lines = sorted(n for d, n in gone if d == i)
        assert got[i] == (len((text or "").split("\n")), len(lines), ",".join(map(str, lines)))


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, None), (1, "")]])
def test_nothing_to_remove(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert line_removals(df)[0].count() == 0 and dedup_lines(df).count() == len(rows)


def test_texts_are_hashed_together(monkeypatch):
    """Many texts take a few array steps, with the rows that each has alone."""
    made = []
    monkeypatch.setattr(line_dedup, "_Hasher", lambda *args, real=line_dedup._Hasher: made.append(1) or real(*args))
    texts = [b"", b"\n", b" \t ", "é b\r\nc\x0bd\x85e\n".encode(), b"one line\n\n two \n", b"x" * 70_000, "ü\n".encode() * 30_000, *(b"text %d\nof lines" % k for k in range(300))]
    together = line_dedup._line_rows(texts, 1)
    assert len(made) <= 8
    alone = [line_dedup._line_rows([t], 1) for t in texts]
    rows = {(k, *r[1:]) for k, one in enumerate(alone) for r in zip(*(v.tolist() for v in one.values()), strict=True)}
    assert rows == set(zip(*(v.tolist() for v in together.values()), strict=True)) and len(rows) == len(together["row"])
