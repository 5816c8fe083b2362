"""The Jaccard join against brute force over all pairs."""

import random
from pathlib import Path

import pytest

from kinweave.llm import shared
from kinweave.llm.jaccard_join import jaccard_classes, one_of_each

DATA = Path("/root/testdata/sf0.001")


def shingles(text, n):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    n = min(n, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute(rows, n, percent):
    """Class of each row as the smallest doc_id, by union of all linked pairs."""
    sets = [shingles(text, n) for _, text in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    return sorted(((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)), key=str)


def copies(seed):
    """Groups whose members differ from each other, more and less than the threshold; chains; equal and odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(4))
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(8):
        base = [word() for _ in range(rng.randrange(5, 90))] + (passage if rng.random() < 0.6 else [])
        now = base
        for _ in range(rng.randrange(1, 14)):
            now = list(now if rng.random() < 0.5 else base)
            for _ in range(rng.randrange(0, 3)):
                now[rng.randrange(len(now))] = word()
            texts.append(" ".join(now))
    texts += [None, "", " \n\t", "one", "One", "two words", "TWO  words", "two words x", "a b c d", texts[0].upper() + "\n"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    return rows + [(3, texts[5]), (3, texts[3]), (None, texts[7]), (None, "all alone in here"), (None, "and alone in there")]


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 3, 90), (2, 5, 80), (3, 3, 90)])
def test_classes_equal_brute_force(spark, seed, n, percent):
    rows = copies(seed)
    df = spark.createDataFrame([(*row, "x") for row in rows], "doc_id long, text string, n string").repartition(5)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_classes(df, n, percent).collect()), key=str)
    assert got == brute(rows, n, percent)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_classes_on_documents(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_classes(df).collect()), key=str)
    assert got == brute(rows, 3, 90)


def test_one_stays_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(5, text, "a"), (2, text + " more", "b"), (9, "other words are here now", "c"), (None, None, "d")], "doc_id long, text string, p string")
    assert {r.p for r in one_of_each(df).collect()} == {"b", "c", "d"}
    assert jaccard_classes(df.limit(0)).count() == 0
    assert one_of_each(df.limit(0)).count() == 0


def test_one_stays_by_rows_not_by_ids(spark):
    t, u = " ".join(f"t{i}" for i in range(30)), " ".join(f"u{i}" for i in range(30))
    rows = [(5, t, "a"), (5, t, "a"), (3, u, "b"), (5, u + " x", "c"), (None, "null ids take part in this as well", "d"), (None, "null ids take part in this as well", "e"), (8, "", "f"), (8, "", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _rep string")
    got = sorted((r.doc_id or -1, r._rep) for r in one_of_each(df).collect())
    assert got[1:] == [(3, "b"), (5, "a"), (8, "f"), (8, "f")] and got[0][0] == -1 and len(got) == 5
    assert one_of_each(df).columns == df.columns


def test_large_group_of_near_copies(spark):
    """Every copy has edits of its own, so most pairs do not link and classes are many."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows = []
    for i in range(120):
        now = list(base if i % 3 else base[:30] + base[:15] + base[45:])
        for _ in range(rng.randrange(0, 6)):
            now[rng.randrange(len(now))] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(now)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for n, percent in ((3, 90), (2, 70)):
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_classes(df, n, percent).collect()), key=str)
        assert got == brute(rows, n, percent)


def test_components_of_small_and_large_graphs(spark, monkeypatch):
    """A small graph is settled in one task, with three tables at most; the loop of a large one gives the same."""
    rng = random.Random(5)
    edges = [(rng.randrange(400) - 50, rng.randrange(400) - 50) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1100)]
    label = {i: i for edge in edges for i in edge}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    df, made = spark.createDataFrame(edges, "a long, b long"), []
    monkeypatch.setattr(shared, "written", lambda df, name, real=shared.written: made.append(name) or real(df, name))
    assert {tuple(r) for r in shared.connected(spark, df, "t").collect()} == set(label.items()) and len(made) <= 3
    assert shared.connected(spark, df.limit(0), "t").count() == 0
    monkeypatch.setattr(shared, "SMALL_GRAPH", 0)
    assert {tuple(r) for r in shared.connected(spark, df, "t").collect()} == set(label.items())


def test_texts_that_no_comparison_asks_for_are_not_shuffled(spark):
    """Two of many long texts are near copies: what is shuffled stays under the size of the texts, also where no join is small enough for a broadcast."""
    rng = random.Random(11)
    words = [f"{rng.getrandbits(40):010x}" for _ in range(20_000)]
    texts = [" ".join(rng.choice(words) for _ in range(3000)) for _ in range(200)]
    rows = [*enumerate(texts), (200, texts[0] + " and"), (200, texts[0] + " and")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()
    context, broadcast = spark.sparkContext._jsc.sc(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def shuffled():
        context.listenerBus().waitUntilEmpty(30_000)
        executors = context.statusStore().executorList(False)
        return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))

    before = shuffled()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.doc_id: r.component_id for r in jaccard_classes(df).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert got == {i: 0 if i == 200 else i for i, _ in rows}
    assert shuffled() - before < sum(len(text) for _, text in rows)
