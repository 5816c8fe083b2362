"""Suffix-array dedup against brute force over all windows."""

import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from kinweave.llm.suffix_dedup import blind_trie_order, cut_text, dedup_substrings, deep_shallow, op3_suffix

DATA = Path("/root/testdata/sf0.001")


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, kept) of each text."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 2, dtype=np.int8)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = 1
        inner = gone[1:-1] if len(t) else gone[:0]
        out.append((len(t), int(inner.sum()), int((np.diff(gone) == 1).sum()), bytes(np.frombuffer(t, np.uint8)[inner == 0]) if len(t) else b""))
    return out


def texts_of(seed, alphabet="ab "):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [word(rng.randrange(15, 90)) for _ in range(6)]
    texts = ["".join(rng.choice([rng.choice(shared), word(rng.randrange(1, 60))]) for _ in range(rng.randrange(0, 7))) for _ in range(60)]
    base = word(150)
    for _ in range(12):
        k = rng.randrange(len(base))
        texts.append(base[:k] + rng.choice("xyzé") + base[k + 1 :])
    return texts + [base, base, None, "", "a" * 200, "short", "é€𝄞" * 20]


@pytest.mark.parametrize(("seed", "alphabet", "hot"), [(1, "ab ", 2000), (2, "abcdefghij", 2000), (3, "abcdefghij", 1), (4, "ab", 2)])
def test_equals_brute_force(spark, seed, alphabet, hot):
    texts = texts_of(seed, alphabet)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, gram string, block int").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in dedup_substrings(df, length=40, anchor=12, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute([(t or "").encode() for t in texts], 40)


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "abcdefghij" * 3 + "xyz" * 10), (1, "abcdefghij" * 3 + "xyz" * 10), (1, "another text of the same name, not repeated anywhere"), (None, "zyxw" * 3 + "nothing else like it at all here"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed) for r in dedup_substrings(df, length=40, anchor=10).collect())
    assert got == sorted((n, gone) for n, gone, _, _ in brute([(t or "").encode() for _, t in rows], 40))
    assert dedup_substrings(df.limit(0)).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_query_on_documents(spark):
    import hashlib

    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    want = {r.doc_id: w for r, w in zip(rows, brute([(r.text or "").encode() for r in rows], 400), strict=True)}
    for r in op3_suffix(spark, str(DATA)).collect():
        n, gone, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, gone, spans, hashlib.sha256(kept).hexdigest())


def test_blind_tries_sort():
    rng = random.Random(5)
    for _ in range(200):
        keys = [bytes(rng.choice(b"ab\0\xff") for _ in range(6)) for _ in range(rng.randrange(1, 30))]
        order = blind_trie_order([(k, i) for i, k in enumerate(keys)])
        assert [keys[c[0]] for c in order] == sorted(set(keys))
        assert sorted(i for c in order for i in c) == list(range(len(keys)))


def test_deep_shallow_classes():
    data = b"the cat sat on the mat, the cat sat on the hat; " * 2
    starts = np.arange(len(data) - 20 + 1)
    got = sorted(sorted(c.tolist()) for c in deep_shallow(data, starts, np.zeros(len(starts), dtype=np.int64), 20, 8))
    by = {}
    for s in starts.tolist():
        by.setdefault(data[s : s + 20], []).append(s)
    assert got == sorted(v for v in by.values() if len(v) > 1)


def test_cut_merges_runs():
    assert cut_text(b"0123456789abcdef", [(2, 3), (4, 4), (10, 10)], 3) == (8, 2, b"01789def")
