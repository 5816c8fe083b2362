"""Quality rules, line-first: judge every line, remove the failing ones, then judge what is left of the document.

A line fails when it is boilerplate (a fixed phrase, or an earlier line of the document again), navigation
(many short items between separators, or a long row of links) or badly punctuated (too many symbols, or
shouting: mostly capitals with exclamation marks) or hardly says anything (one word over and over, or
words doubled all along). Blank lines pass. A document is rejected when its base
counts fail, or when the failing lines hold more than ``max_lost`` of its words; ``keep_good`` hands the
others on without their failing lines.

Defined cases: a null or blank text has no words and fails the base rule (fewer than 10 words); repeated
rows are judged each for itself; an empty table gives an empty result; other columns of the input are
left alone. Texts of any length are judged whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kinweave.llm.shared import arrow_map, shingle_hashes, table, text_bytes, word_hashes

SYMBOLS = b"#*$%&|<>"
BOILERPLATE = re.compile(
    rb"cookie polic|we use cookies|accept (all )?cookies|enable javascript|javascript is (disabled|required)|all rights reserved|terms of (use|service)|privacy policy"
    rb"|click here|read more|sign in to|log in to|subscribe (now|to our)|share (this )?on|follow us on|lorem ipsum|add to cart|skip to (main )?content",
    re.IGNORECASE,
)
_ITEM_SEPARATOR = re.compile(rb"\s(?:[|>/]|\xc2\xb7|\xc2\xbb|\xe2\x80\xa2)(?=\s)")


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 10
    max_repeat_percent: int = 20
    #: Symbols per word from which a line is junk.
    max_symbols_per_word: float = 0.3
    #: Separators per word from which a line of 4 or more words is navigation.
    max_separators_per_word: float = 0.25
    #: Share of capitals among the ASCII letters, with an exclamation mark for every other word, that is shouting.
    max_capitals: float = 0.7
    #: Share of a line's words that its commonest word may have, in lines of 10 or more words.
    max_one_word: float = 0.5
    #: Share of a line's words that may equal the word before, in lines of 8 or more words.
    max_doubled: float = 0.4
    #: Share of a document's words that the failing lines may hold.
    max_lost: float = 0.5


_OTHER_WORDS = bytes(c for c in range(256) if c not in SYMBOLS)
_CONTINUATION = bytes(range(0x80, 0xC0))
_CAPITALS = bytes(c for c in range(256) if not 65 <= c <= 90)
_SMALL = bytes(c for c in range(256) if not 97 <= c <= 122)


def line_verdict(line: bytes, words: list[bytes], rules: QualityRules) -> str:
    """The rule that a line breaks, or '' if none. Repeats of earlier lines are found by the caller."""
    n = len(words)
    if not n:
        return ""
    if len(line.translate(None, _OTHER_WORDS)) > rules.max_symbols_per_word * n and n >= 3:
        separators = len(_ITEM_SEPARATOR.findall(line))
        return "navigation" if separators > rules.max_separators_per_word * n else "punctuation"
    if n >= 4 and len(_ITEM_SEPARATOR.findall(line)) > rules.max_separators_per_word * n:
        return "navigation"
    if n <= 30 and BOILERPLATE.search(line):
        return "boilerplate"
    if n >= 3 and 2 * line.count(b"!") > n:
        capitals, small = len(line.translate(None, _CAPITALS)), len(line.translate(None, _SMALL))
        if capitals > rules.max_capitals * (capitals + small):
            return "punctuation"
    if n >= 10 and max(Counter(words).values()) > rules.max_one_word * n:
        return "boilerplate"
    if n >= 8 and sum(map(eq, words, words[1:])) > rules.max_doubled * n:
        return "boilerplate"
    return ""


def repeated_words(hashes: np.ndarray, window: int = 5) -> int:
    """Words that lie in a window of ``window`` words that the text has twice or more."""
    windows = shingle_hashes(hashes, window)
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    ordered = windows[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(windows), dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    steps = np.zeros(len(hashes) + 1, dtype=np.int64)
    at = np.flatnonzero(hit)
    steps[at] += 1
    np.subtract.at(steps, at + window, 1)
    return int((np.cumsum(steps[:-1]) > 0).sum())


def judge(text: bytes, rules: QualityRules = QualityRules()) -> tuple[int, int, int, int, int, bool, bool, int, int, bytes]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_bad_lines, n_lost_words, and the text of the lines that pass."""
    words = text.split()
    n_words = len(words)
    word_chars = len(b"".join(words).translate(None, _CONTINUATION))
    n_symbols = len(text.translate(None, _OTHER_WORDS))
    seen: set[bytes] = set()
    good: list[bytes] = []
    n_dup = n_bad = lost = 0
    for line in text.split(b"\n"):
        parts = line.split()
        if not parts:
            good.append(line)
            continue
        again = line in seen
        seen.add(line)
        n_dup += again
        if again or line_verdict(line, parts, rules):
            n_bad += 1
            lost += len(parts)
        else:
            good.append(line)
    n_repeat = repeated_words(word_hashes(text)) if n_words > 5 else 0
    base_failed = n_words < rules.min_words or 100 * n_repeat > rules.max_repeat_percent * n_words
    kept = not base_failed and lost <= rules.max_lost * n_words
    return n_words, word_chars, n_symbols, n_dup, n_repeat, base_failed, kept, n_bad, lost, b"\n".join(good)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_bad_lines", "n_lost_words")
_TYPES = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2


def quality_verdicts(documents: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """doc_id and COUNTS for every document."""

    def kernel(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [judge(text, rules) for text in text_bytes(batch.column("text"))]
        columns = [pa.array([row[i] for row in rows], type=kind) for i, kind in enumerate(_TYPES)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *COUNTS])

    kinds = ", ".join(f"{name} {'boolean' if kind == pa.bool_() else 'long'}" for name, kind in zip(COUNTS, _TYPES, strict=True))
    return arrow_map(documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), kernel, f"doc_id long, {kinds}")


def keep_good(documents: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that pass, their failing lines removed, with all their columns; one pass over the texts, without a join."""
    at = documents.columns.index("text")

    def kernel(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        judged = [judge(text, rules) for text in text_bytes(batch.column(at).cast(pa.string()))]
        kind = batch.schema.field(at).type
        cleaned = pa.array([row[-1] for row in judged], type=pa.binary()).cast(pa.string()).cast(kind)
        yield batch.set_column(at, batch.schema.field(at), cleaned).filter(pa.array([row[6] for row in judged], type=pa.bool_()))

    return arrow_map(documents, kernel, documents.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"))
