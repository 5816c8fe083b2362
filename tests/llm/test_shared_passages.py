"""Passages of many words that documents share, against brute force over all windows of words."""

import random
from collections import defaultdict
from pathlib import Path

import pytest

from kinweave.llm.shared_passages import covered
from kinweave.llm.suffix_dedup import dedup_substrings, op3_suffix

DATA = Path("/root/testdata/sf0.001")


def brute(texts, n):
    """Words of each text in windows of n words that another text has, too."""
    split = [(t or "").encode().split() for t in texts]
    where = defaultdict(set)
    for row, words in enumerate(split):
        for i in range(len(words) - n + 1):
            where[tuple(words[i : i + n])].add(row)
    out = []
    for words in split:
        inside = set()
        for i in range(len(words) - n + 1):
            if len(where[tuple(words[i : i + n])]) > 1:
                inside |= set(range(i, i + n))
        out.append(len(inside))
    return out


def mixed(seed, letters):
    rng = random.Random(seed)
    words = lambda n: [rng.choice(letters) for _ in range(n)]
    passages = [words(n) for n in (4, 5, 6, 7, 9, 14, 30)]
    texts = [rng.choice([" ", "\n", "  "]).join(sum((rng.choice([rng.choice(passages), words(rng.randrange(1, 12))]) for _ in range(rng.randrange(0, 6))), [])) for _ in range(70)]
    twice = words(8)
    return texts + [None, "", "a", " ".join([*twice, "only", "here", *twice]), "é 𝄞 " * 9, "é\t𝄞\n" * 9, " ".join(passages[6]), " ".join(passages[6])]


@pytest.mark.parametrize(("seed", "letters", "n"), [(1, "ab", 9), (2, [f"w{k}" for k in range(40)], 6), (3, [f"w{k}" for k in range(4000)], 6)])
def test_equals_brute_force(spark, seed, letters, n):
    import kinweave.llm.shared_passages as module
    from kinweave.llm.suffix_dedup import _texts

    texts = mixed(seed, letters)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_shared_words for r in module.shared_words(_texts(df), words=n, gram=3).collect()}
    assert [got.get(k, 0) for k in range(len(texts))] == brute(texts, n)
    assert any(got.values())


def test_short_passages_of_over_50_words(spark):
    """Such a passage has under 400 bytes: it stays in the text, and n_shared_words tells of it."""
    rng = random.Random(7)
    own = lambda n: [f"{rng.randrange(10**6):06d}" for _ in range(n)]
    one, less = own(51), own(50)
    rows = [own(30) + one + own(40), one + own(60), own(90), own(20) + less + own(20), less, own(30) * 3]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_shared_words) for r in dedup_substrings(df, words=51).collect()}
    assert [got[k] for k in range(6)] == [(0, 51), (0, 51), (0, 0), (0, 0), (0, 0), (629, 0)]


def test_rows_without_ids(spark):
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(None, text), (None, "nothing like it " * 20), (3, text.replace(" ", "\n")), (3, "other"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_shared_words) for r in dedup_substrings(df, words=51).collect()) == [(0, 0), (0, 0), (0, 60), (3, 0), (3, 60)]
    assert dedup_substrings(df.limit(0), words=51).count() == 0


def test_covered():
    assert covered([(0, 0b1), (3, 0b101), (20, 0b1)], 4) == 9 + 4


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_query_on_documents(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    want = {r.doc_id: w for r, w in zip(rows, brute([r.text for r in rows], 51), strict=True)}
    assert {r.doc_id: r.n_shared_words for r in op3_suffix(spark, str(DATA)).collect()} == want
    assert any(want.values())
