"""LM scoring with a Brown class-based bigram model.

Tokens are the words of the ASCII-lower-cased text and one end per document. Exchange clustering assigns
words to classes: P(word | previous) = P(class | previous word's class) * P(word | class), with

    P(b | a)    = (n(a, b) + PRIOR * P(b)) / (n(a) + PRIOR)      class transitions
    P(w | b)    = (c(w) + 1) / (c(b) + v(b) + 1)                 word emissions, one share for unseen words

where v(b) is the number of distinct words of the class. The classes are found in two steps:

1. Seed: the HEAD_WORDS commonest words, each by itself, and all other words by their ending (FORMS groups) are
   clustered on the driver by exchange over their bigrams, which gives the first classes and their transitions.
2. Every other word with MIN_COUNT training tokens or more is moved by itself: the workers count its own bigrams
   with the classes before and after it, these are summed per word, and it takes the class under which its own
   tokens are likeliest, the class tables held fixed meanwhile. Transitions and emissions are then counted
   again over all training documents with the classes that came out.

The number of classes grows with these words (class_count). Only rarer words, whose few tokens say little, and
unseen ones have the class of their ending.

A hash and a class of each word that has its own class are sent to the workers, 10 bytes a word, and so are
the counts of the LOOKUP commonest words (a fixed size); the other words of a document are joined with the
full table of counts.

Defined cases: a null or empty text has one token, its end; a null doc_id is a training document; repeated
rows count and are scored each for itself; without training documents all counts are 0 and the scores
follow the formulas; an empty table gives an empty result; other columns are ignored; texts are scored
whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.shared import arrow_map, prefix_sums, ship_package, substring_hashes, table, text_bytes, word_bounds, written

HEAD_WORDS = 1024
FORMS = 512
#: Classes at least; their number grows with the words that have their own.
CLASSES = 64
#: Training tokens from which a word has a class by its own bigrams; of 2, 3, 5 and 10 the best on held-out documents.
MIN_COUNT = 2
LOOKUP = 1 << 18
PRIOR = 20.0
SWEEPS = 8
#: The hash of the end token; words hash to other values but by a chance of 1 in 2 ** 64.
END = 0x1D8AF066C5A1B3E7
_BLOB = 1 << 19
_FLUSH = 1 << 21


def _blobs(column: pa.Array) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in text_bytes(column):
        held.append(text)
        size += len(text)
        if size > _BLOB:
            yield held
            held, size = [], 0
    if held:
        yield held


def tokens_of(texts: list[bytes], forms: int = FORMS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, form, text) of the tokens of several texts, in order; an end has form -1."""
    blob = b"\n".join(texts).lower()
    buf = np.frombuffer(blob, dtype=np.uint8)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    starts, ends = word_bounds(buf)
    owner = np.searchsorted(begins, starts, "right") - 1
    per_text = np.bincount(owner, minlength=len(texts))
    size = len(starts) + len(texts)
    words_at = np.arange(len(starts)) + owner
    hashes, form, of = np.full(size, END, dtype=np.uint64), np.full(size, -1, dtype=np.int64), np.repeat(np.arange(len(texts)), per_text + 1)
    if len(starts):
        sums = prefix_sums(buf)
        hashes[words_at] = substring_hashes(sums, starts, ends)
        form[words_at] = (substring_hashes(sums, np.maximum(starts, ends - 3), ends) % np.uint64(forms)).astype(np.int64)
    return hashes, form, of


def word_counts(training: DataFrame) -> DataFrame:
    """(word, form, n) over all documents: each task counts what it holds before the shuffle."""
    ship_package(training.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts: list[np.ndarray], forms: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            words, at, n = np.unique(np.concatenate(parts), return_index=True, return_counts=True)
            form = np.concatenate(forms)[at]
            for k in range(0, len(words), 100_000):
                cut = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(words[cut].view(np.int64)), pa.array(form[cut], pa.int32()), pa.array(n[cut], pa.int64())], names=["word", "form", "n"])

        parts, forms, size = [], [], 0
        for batch in batches:
            for texts in _blobs(batch.column("text")):
                hashes, form, _ = tokens_of(texts)
                parts.append(hashes)
                forms.append(form)
                size += len(hashes)
                if size > _FLUSH:
                    yield from flush(parts, forms)
                    parts, forms, size = [], [], 0
        if parts:
            yield from flush(parts, forms)

    return training.select("text").mapInArrow(count, "word long, form int, n long").groupBy("word", "form").agg(F.sum("n").alias("n"))


def commonest(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, form, n) of the commonest words, ``most`` at most: a cut on the count, found from a histogram, not a sort."""
    steps = counts.groupBy(F.floor(F.log2("n") * 16).cast("int").alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).collect()
    held, least = 0, None
    for row in sorted(steps, key=lambda r: -r.step):
        held += row.words
        if held > most:
            break
        least = row.least
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = counts.where(F.col("n") >= least).toArrow()
    words = rows["word"].to_numpy().view(np.uint64)
    order = np.argsort(words)
    return words[order], rows["form"].to_numpy().astype(np.int64)[order], rows["n"].to_numpy()[order]


@dataclass(frozen=True)
class Units:
    """Unit 0 is the end, then the head words in order of their hash, then the forms."""

    words: np.ndarray
    forms: int

    @property
    def size(self) -> int:
        return 1 + len(self.words) + self.forms

    def of(self, hashes: np.ndarray, form: np.ndarray) -> np.ndarray:
        out = 1 + len(self.words) + form
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            out = np.where(self.words[at] == hashes, 1 + at, out)
        return np.where(form < 0, 0, out)


def unit_bigrams(training: DataFrame, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, n) of neighbouring units; a document's first token follows an end."""
    ship_package(training.sparkSession)
    shared = training.sparkSession.sparkContext.broadcast(units)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = shared.value
        counts = np.zeros(units.size**2, dtype=np.int32)
        for batch in batches:
            for texts in _blobs(batch.column("text")):
                hashes, form, _ = tokens_of(texts, units.forms)
                unit = units.of(hashes, form)
                codes, n = np.unique(np.concatenate(([0], unit[:-1])) * units.size + unit, return_counts=True)
                counts[codes] += n.astype(np.int32)
        at = np.flatnonzero(counts)
        for k in range(0, len(at), 200_000):
            cut = at[k : k + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.int64()), pa.array(counts[cut], pa.int64())], names=["code", "n"])

    rows = training.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    code, n = rows["code"].to_numpy(), rows["n"].to_numpy()
    order = np.argsort(code)
    return code[order] // units.size, code[order] % units.size, n[order]


def class_count(n_words: int) -> int:
    """Classes for so many words with their own: the cube root, so that the table of transitions grows slower than the words."""
    return max(CLASSES, math.ceil(2 * n_words ** (1 / 3)))


@dataclass(frozen=True)
class Lexicon:
    """Words that have a class by themselves, in order of their hash; any other token has the class of its unit."""

    words: np.ndarray
    classes: np.ndarray
    units: Units
    unit_classes: np.ndarray

    def find(self, hashes: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the words or -1, class) of each token; equal tokens are looked up once."""
        if not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        each, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        classes = self.unit_classes[self.units.of(each, form[first])].astype(np.int64)
        place = np.full(len(each), -1, dtype=np.int64)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, each), len(self.words) - 1)
            own = (self.words[at] == each) & (form[first] >= 0)
            place = np.where(own, at, -1)
            classes = np.where(own, self.classes[at], classes)
        return place[back], classes[back]


def own_words(counts: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, form, n) of all words with ``least`` tokens or more, in order of their hash."""
    rows = counts.where(F.col("n") >= least).where("form >= 0").selectExpr("word", "cast(form as smallint) form", "n").toArrow()
    words = rows["word"].to_numpy().view(np.uint64)
    order = np.argsort(words)
    return words[order], rows["form"].to_numpy()[order], rows["n"].to_numpy()[order]


def moved_words(training: DataFrame, lexicon: Lexicon, transitions: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """The class of each word of the lexicon under which its own tokens are likeliest; a head word keeps its class.

    Distributed: a worker counts (word, class before or after), equal ones are summed, and all of a word's come to one row.
    """
    ship_package(training.sparkSession)
    classes = len(spread)
    context = training.sparkSession.sparkContext
    shared = context.broadcast(lexicon)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, parts, size = shared.value, [], 0
        head = np.isin(lexicon.words, lexicon.units.words)

        def flush() -> Iterator[pa.RecordBatch]:
            codes, n = np.unique(np.concatenate(parts), return_counts=True)
            for k in range(0, len(codes), 200_000):
                cut = codes[k : k + 200_000]
                columns = [pa.array((cut // (2 * classes)).astype(np.int32)), pa.array((cut % (2 * classes)).astype(np.int32)), pa.array(n[k : k + 200_000], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["place", "side", "n"])

        for batch in batches:
            for texts in _blobs(batch.column("text")):
                hashes, form, _ = tokens_of(texts, lexicon.units.forms)
                place, of = lexicon.find(hashes, form)
                at = np.flatnonzero(place >= 0)
                at = at[~head[place[at]]]
                # An own word is never the last token, which is an end; before the first one stands an end, of class 0.
                base = place[at] * (2 * classes)
                parts += [base + np.where(at > 0, of[at - 1], 0), base + classes + of[at + 1]]
                size += 2 * len(at)
                if size > 2 * _FLUSH:
                    yield from flush()
                    parts, size = [], 0
        if size:
            yield from flush()

    # log10 of a token's part by class: before a class, after one, and the class's own emission, which one side pays.
    weight = context.broadcast(np.concatenate((transitions - spread, transitions.T)))

    def choose(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start in range(0, batch.num_rows, 1000):
            rows = batch.slice(start, 1000)
            sides = rows.column("sides")
            of, flat = np.repeat(np.arange(len(rows)), sides.value_lengths().to_numpy()), sides.flatten()
            codes = of * (2 * classes) + flat.field("side").to_numpy()
            own = np.bincount(codes, flat.field("n").to_numpy(), len(rows) * 2 * classes).reshape(len(rows), 2 * classes)
            likely = own @ weight.value
            likely[:, 0] = -np.inf
            yield pa.RecordBatch.from_arrays([rows.column("place"), pa.array(likely.argmax(1), pa.int16())], names=["place", "class"])

    pairs = training.select("text").mapInArrow(count, "place int, side int, n long").repartition("place").groupBy("place", "side").agg(F.sum("n").alias("n"))
    per_word = pairs.groupBy("place").agg(F.collect_list(F.struct("side", "n")).alias("sides"))
    rows = arrow_map(per_word, choose, "place int, class smallint").toArrow()
    out = lexicon.classes.copy()
    out[rows["place"].to_numpy()] = rows["class"].to_numpy()
    return out


def class_bigrams(training: DataFrame, lexicon: Lexicon, classes: int) -> np.ndarray:
    """Counts of (class, class after it) over all training documents."""
    ship_package(training.sparkSession)
    shared = training.sparkSession.sparkContext.broadcast(lexicon)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, counts = shared.value, np.zeros(classes * classes, dtype=np.int64)
        for batch in batches:
            for texts in _blobs(batch.column("text")):
                hashes, form, _ = tokens_of(texts, lexicon.units.forms)
                _, of = lexicon.find(hashes, form)
                counts += np.bincount(np.concatenate(([0], of[:-1])) * classes + of, minlength=classes * classes)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["code", "n"])

    rows = training.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    return np.bincount(rows["code"].to_numpy(), rows["n"].to_numpy(), classes * classes).reshape(classes, classes)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(left: np.ndarray, right: np.ndarray, n: np.ndarray, size: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit: every sweep moves each unit to the class that raises the class bigram likelihood most.

    Unit 0, the end, keeps class 0 to itself. Starts with the units dealt out by frequency.
    """
    total = np.bincount(left, n, size) + np.bincount(right, n, size)
    order = np.argsort(-total, kind="stable")
    order = order[order != 0]
    of = np.zeros(size, dtype=np.int64)
    of[order] = 1 + np.arange(len(order)) % (classes - 1)
    table = np.bincount(of[left] * classes + of[right], n, classes * classes).reshape(classes, classes)
    rows, columns = table.sum(1), table.sum(0)
    out_bounds = np.searchsorted(left, np.arange(size + 1))
    by_right = np.argsort(right, kind="stable")
    in_left, in_n = left[by_right], n[by_right]
    in_bounds = np.searchsorted(right[by_right], np.arange(size + 1))
    every = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for unit in order:
            o, i = slice(out_bounds[unit], out_bounds[unit + 1]), slice(in_bounds[unit], in_bounds[unit + 1])
            to, from_ = right[o], in_left[i]
            itself = n[o][to == unit].sum()
            after = np.bincount(of[to], n[o], classes)
            before = np.bincount(of[from_], in_n[i], classes)
            now = of[unit]
            after[now] -= itself
            before[now] -= itself
            if not after.any() and not before.any() and not itself:
                continue
            out_sum, in_sum = after.sum() + itself, before.sum() + itself
            table[now] -= after
            table[:, now] -= before
            table[now, now] -= itself
            rows[now] -= out_sum
            columns[now] -= in_sum
            plain = _xlogx(table)
            gain = (_xlogx(table + after) - plain).sum(1) + (_xlogx(table + before[:, None]) - plain).sum(0)
            # The own entry of a class changes once by both sides and the unit's pairs with itself.
            own = np.diagonal(table)
            gain += _xlogx(own + after + before + itself) - _xlogx(own + after) - _xlogx(own + before) + _xlogx(own)
            gain -= _xlogx(rows + out_sum) - _xlogx(rows) + _xlogx(columns + in_sum) - _xlogx(columns)
            gain[0] = -np.inf
            best = int(every[np.argmax(gain)])
            if gain[best] <= gain[now] + 1e-9 * abs(gain[now]):
                best = int(now)
            moved += best != now
            of[unit] = best
            table[best] += after
            table[:, best] += before
            table[best, best] += itself
            rows[best] += out_sum
            columns[best] += in_sum
        if moved * 200 < len(order):
            break
    return of


@dataclass(frozen=True)
class ClassModel:
    lexicon: Lexicon
    #: log10 P(b | a).
    transitions: np.ndarray
    #: log10 (c(b) + v(b) + 1).
    spread: np.ndarray
    #: The commonest words, by hash, with their counts.
    words: np.ndarray
    counts: np.ndarray
    n_tokens: int
    n_words: int

    @property
    def units(self) -> Units:
        return self.lexicon.units

    @property
    def classes(self) -> np.ndarray:
        """Class of each unit."""
        return self.lexicon.unit_classes

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Per text: tokens, known tokens and sum of log10(c + 1) among the commonest words, and class part of the score; then (text, word, times) of the other words."""
        hashes, form, of = tokens_of(texts, self.units.forms)
        _, classes = self.lexicon.find(hashes, form)
        part = self.transitions[np.concatenate(([0], classes[:-1])), classes] - self.spread[classes]
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            common = self.words[at] == hashes
            n = np.where(common, self.counts[at], 0)
        else:
            common, n = np.zeros(len(hashes), dtype=bool), np.zeros(len(hashes), dtype=np.int64)
        size = len(texts)
        tail = np.flatnonzero(~common)
        order = tail[np.lexsort((hashes[tail], of[tail]))]
        new = np.concatenate(([True], (of[order][1:] != of[order][:-1]) | (hashes[order][1:] != hashes[order][:-1]))) if len(order) else np.zeros(0, dtype=bool)
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(order)))
        return (
            np.bincount(of, minlength=size), np.bincount(of, n > 0, size).astype(np.int64), np.bincount(of, np.log10(n + 1.0), size), np.bincount(of, part, size),
            of[order][at], hashes[order][at], times,
        )


def _log_tables(table: np.ndarray, class_n: np.ndarray, class_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the transitions, and log10 (c(b) + v(b) + 1)."""
    prior = (class_n + 1) / (class_n.sum() + len(class_n))
    return np.log10((table + PRIOR * prior) / (table.sum(1, keepdims=True) + PRIOR)), np.log10(class_n + class_words + 1)


def train(training: DataFrame, counts: DataFrame, head_words: int = HEAD_WORDS, classes: int | None = None, lookup: int = LOOKUP, min_count: int = MIN_COUNT) -> ClassModel:
    """Fit the model to all rows of (text); counts: word_counts() of them, written. classes: class_count() of the own words by default."""
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("words")).first()
    words, form, n = commonest(counts, lookup)
    plain = np.flatnonzero(form >= 0)
    head = np.sort(plain[np.lexsort((words[plain], -n[plain]))][:head_words])
    units = Units(words[head], FORMS)
    own, own_form, own_n = own_words(counts, min_count)
    classes = classes or class_count(len(own))
    left, right, pairs = unit_bigrams(training, units)
    of = exchange(left, right, pairs, units.size, classes)
    per_form = counts.where("form >= 0").groupBy("form").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()
    unit_n, unit_words = np.zeros(units.size), np.zeros(units.size)
    for row in per_form:
        unit_n[1 + len(head) + row.form], unit_words[1 + len(head) + row.form] = row.n, row.words
    np.subtract.at(unit_n, 1 + len(head) + form[head], n[head])
    np.subtract.at(unit_words, 1 + len(head) + form[head], 1)
    unit_n[1 : 1 + len(head)], unit_words[1 : 1 + len(head)] = n[head], 1
    unit_n[0], unit_words[0] = totals.tokens - unit_n.sum(), totals.tokens > 0
    class_n, class_words = np.bincount(of, unit_n, classes), np.bincount(of, unit_words, classes)
    table = np.bincount(of[left] * classes + of[right], pairs, classes * classes).reshape(classes, classes)
    transitions, spread = _log_tables(table, class_n, class_words)
    seed = of[units.of(own, own_form.astype(np.int64))]
    lexicon = Lexicon(own, seed.astype(np.int16), units, of)
    if len(own):
        moved = moved_words(training, lexicon, transitions, spread)
        lexicon = Lexicon(own, moved, units, of)
        class_n += np.bincount(moved, own_n, classes) - np.bincount(seed, own_n, classes)
        class_words += np.bincount(moved, minlength=classes) - np.bincount(seed, minlength=classes)
        transitions, spread = _log_tables(class_bigrams(training, lexicon, classes), class_n, class_words)
    return ClassModel(lexicon, transitions, spread, words, n, int(totals.tokens), int(totals.words))


def score_texts(documents: DataFrame, head_words: int = HEAD_WORDS, classes: int | None = None, lookup: int = LOOKUP, min_count: int = MIN_COUNT) -> DataFrame:
    """Train on the documents that are not held out and score all: see op9_lm's columns, and perplexity."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    training = texts.where("not held_out").select("text")
    counts = written(word_counts(training), "lm-counts")
    model = train(training, counts, head_words, classes, lookup, min_count)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    tail_type = pa.list_(pa.struct([("word", pa.int64()), ("times", pa.int64())]))

    def kernel(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = 0
        for part in _blobs(batch.column("text")):
            rows = batch.slice(at, len(part))
            at += len(part)
            n_tokens, known, logs, class_part, of, words, times = shared.value(part)
            offsets = np.searchsorted(of, np.arange(len(part) + 1))
            pairs = pa.StructArray.from_arrays([pa.array(words.view(np.int64)), pa.array(times, pa.int64())], names=["word", "times"])
            tail = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs).cast(tail_type)
            columns = [rows.column("doc_id"), rows.column("held_out"), pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(logs, pa.float64()), pa.array(class_part, pa.float64()), tail]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "known", "logs", "class_part", "tail"])

    ship_package(documents.sparkSession)
    schema = "doc_id long, held_out boolean, n_tokens long, known long, logs double, class_part double, tail array<struct<word:long,times:long>>"
    local = written(arrow_map(texts, kernel, schema).withColumn("row", F.monotonically_increasing_id()), "lm-local")
    rest = local.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.times").join(counts.select("word", "n"), "word")
    rest = rest.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs"), F.sum("times").alias("more_known"))
    joined = local.drop("tail").join(rest, "row", "left")
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    base = logs - F.col("n_tokens") * F.lit(math.log10(model.n_tokens + model.n_words + 1))
    score = logs + F.col("class_part")
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
