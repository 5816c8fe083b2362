"""LM scoring: base scores against a plain count, the model against its formulas and held-out text."""

import math
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from kinweave.llm.class_model import class_count, exchange, score_texts, tokens_of, train, word_counts

DATA = Path("/root/testdata/sf0.001")


def plain(rows):
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        words = tokens(t)
        out.append((i, held(i), len(words), sum(counts[w] > 0 for w in words), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)))
    return out


def check(got, want):
    got, want = sorted(got, key=str), sorted(want, key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("lookup", [1 << 18, 40])
def test_base_scores(spark, lookup):
    texts = ["The cat sat on the mat", None, "", " \t\n", "the CAT sat\x0bagain", "Ünïcode wörds wörds", "a b c " * 3000]
    rows = [(i, texts[i % len(texts)] and texts[i % len(texts)] + f" w{i % 5}") for i in range(60)] + [(3, "the cat"), (3, "the cat"), (None, "nobody")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n long").repartition(3)
    out = score_texts(df, head_words=6, classes=4, lookup=lookup).collect()
    check([tuple(r)[:6] for r in out], plain(rows))
    assert all(r.perplexity > 0 for r in out)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_model_beats_the_base_on_held_out_documents(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    out = score_texts(df).collect()
    check([tuple(r)[:6] for r in out], plain([(r.doc_id, r.text) for r in df.collect()]))
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.05 * sum(r.n_tokens for r in held)


def test_probabilities_sum_to_one(spark):
    texts = ["red green blue red", "one two three one two", "red blue", "two one"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = word_counts(df)
    model = train(df, counts, head_words=3, classes=3)
    assert np.allclose((10**model.transitions).sum(1), 1)
    rows = counts.toPandas()
    classes = model.classes[model.units.of(rows["word"].to_numpy(np.int64).view(np.uint64), rows["form"].to_numpy(np.int64))]
    for c in range(3):
        mass = ((rows["n"].to_numpy()[classes == c] + 1).sum() + 1) / 10 ** model.spread[c]
        assert math.isclose(mass, 1)


def test_words_outside_the_head_are_classed_by_their_own_bigrams(spark):
    # All end alike, so by their ending the ten rare words would share one class and both orders one score.
    rng = np.random.default_rng(5)
    word = lambda kind: f"{kind}{rng.integers(3) if rng.random() < 0.8 else rng.integers(3, 8)}xyz"
    rows = [(i, " ".join(word("ab"[k % 2]) for k in range(40))) for i in range(100)]
    rows += [(1000, "a5xyz b5xyz a6xyz b6xyz"), (1001, "a5xyz a6xyz b5xyz b6xyz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scores = {r.doc_id: r.score for r in score_texts(df, head_words=6, classes=4).collect()}
    assert scores[1000] > scores[1001] + 1
    training = df.where("doc_id < 1000").select("text")
    counts = word_counts(training)
    model = train(training, counts, head_words=6, classes=4)
    rows = counts.toPandas()
    _, classes = model.lexicon.find(rows["word"].to_numpy(np.int64).view(np.uint64), rows["form"].to_numpy(np.int64))
    for c in range(4):
        assert math.isclose(((rows["n"].to_numpy()[classes == c] + 1).sum() + 1) / 10 ** model.spread[c], 1)


def test_classes_grow_with_the_words():
    assert class_count(100) == 64 and class_count(1_000_000) == 200


def test_exchange_separates_alternating_units():
    # Units 1-4 are followed by 5-8 only, and the other way round.
    rng = np.random.default_rng(3)
    pairs = Counter()
    for _ in range(5000):
        a, b = int(rng.integers(1, 5)), int(rng.integers(5, 9))
        pairs[a, b] += 1
        pairs[b, int(rng.integers(1, 5))] += 1
    keys = sorted(pairs)
    of = exchange(np.array([k[0] for k in keys]), np.array([k[1] for k in keys]), np.array([pairs[k] for k in keys]), 9, classes=3)
    assert len(set(of[1:5])) == 1 and len(set(of[5:9])) == 1 and of[1] != of[5]


def test_tokens_and_empty_table(spark):
    hashes, form, of = tokens_of([b"a b", b"", b"A"])
    assert of.tolist() == [0, 0, 0, 1, 2, 2] and (form < 0).tolist() == [False, False, True, True, False, True] and hashes[0] == hashes[4]
    assert score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
