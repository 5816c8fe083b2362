"""The pipeline against a brute-force version of its stages, on the smallest tables."""

import hashlib
import re
from pathlib import Path

import pytest

import corpus_pipeline
from kinweave.llm.mixing import SEED
from kinweave.llm.quality import QualityRules, judge, line_verdict
from tests.llm.test_jaccard_join import brute as brute_classes
from tests.llm.test_line_dedup import brute as brute_lines

DATA = Path("/root/testdata/sf0.001")


def good_lines(text):
    """The text without lines that break a rule or repeat an earlier one."""
    seen, out = set(), []
    for line in text.split("\n"):
        words = line.encode().split()
        if not words or not (line in seen or line_verdict(line.encode(), words, QualityRules())):
            out.append(line)
        if words:
            seen.add(line)
    return "\n".join(out)


def leak_words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def grams(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_targets(sizes, weights=(3, 1, 2)):
    """Share by weight, clamp, share the excess again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else left * weight[s] / free for s in order}
        over = {s for s in order if s not in full and target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


def brute_mix(docs):
    sized = [(i, source, len((text or "").encode().split())) for i, text, source in docs]
    totals = {}
    for _, source, size in sized:
        totals[source] = totals.get(source, 0) + size
    targets, out = brute_targets(totals), []
    for source, total in totals.items():
        key = lambda d: hashlib.md5("|".join([str(SEED), str(d[0]), *([] if source is None else [source]), str(d[2])]).encode()).hexdigest()
        epochs = int(targets[source] // total) if total else 0
        rest, at = int(targets[source] - epochs * total), 0
        for i, _, size in sorted((d for d in sized if d[1] == source), key=key):
            out.append((i, size, total, round(targets[source], 6), epochs * size + max(0, min(size, rest - at))))
            at += size
    return sorted(out)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_pipeline_equals_brute_force(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    items = [grams(leak_words(r.text)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    docs = [(i, good_lines(text), source) for i, text, source in rows if judge((text or "").encode())[6]]
    assert any(text != before for (_, text, _), (_, before, _) in zip(docs, (r for r in rows if judge((r[1] or "").encode())[6])))
    gone = brute_lines([(i, t) for i, t, _ in docs], 1, 20)
    cut = []
    for i, text, source in docs:
        left = "\n".join(line for n, line in enumerate(text.split("\n")) if (i, n) not in gone)
        if left.split() or not any(i == g for g, _ in gone):
            cut.append((i, left, source))
    stay = {i for i, _, c in brute_classes([(i, t) for i, t, _ in cut], 5, 80) if i == c}
    kept = [d for d in cut if d[0] in stay]
    clean = [d for d in kept if not any(len(x & grams(leak_words(d[1]))) >= 0.8 * len(x) for x in items if x)]
    got = sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in corpus_pipeline.run(spark, str(DATA)).collect())
    assert got == brute_mix(clean)
    assert len(clean) < len(kept) < len(cut) < len(rows)
