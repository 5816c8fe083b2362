"""Passages of over 50 words that stand in more than one document, whatever their length in bytes.

Equality is that of words, so white space between them doesn't count. The windows of WORDS words that
can repeat are chosen as in suffix_dedup, by winnowed anchors, and compared by hashes of 128 bits:

1. Of every window the anchor is its GRAM words with the smallest hash, so equal windows have equal anchors.
   Anchors that stand in one row only own no shared window; smallest and largest row are partial sums.
2. Blocks (the words of an anchor's run of windows) that are equal become one, with its smallest and largest row.
3. The windows of different blocks of an anchor are compared one by one: a window is shared if its smallest
   and largest row differ. Both sums and the join back to the blocks are per window, so no anchor is held at once.

Nothing is cut out here. A row that is there twice shares its passages with itself, as in suffix_dedup.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.shared import arrow_map, forget, sequence_sums, substring_hashes, text_bytes, word_hashes, written
from kinweave.llm.winnowing import block_hashes, runs_of_anchors

WORDS = 51
GRAM = 16


def _anchor_rows(texts: DataFrame, words: int, gram: int) -> DataFrame:
    def kernel(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            columns: list[list[np.ndarray]] = [[], [], [], []]
            owners = []
            for row, text in enumerate(text_bytes(part.column("text"))):
                hashes = word_hashes(text)
                if len(hashes) >= words:
                    sums = sequence_sums(hashes)
                    grams, first, last, _ = runs_of_anchors(sums, words, gram)
                    for kept, new in zip(columns, (grams.view(np.int64), block_hashes(sums, first, last, words).view(np.int64), first, last), strict=True):
                        kept.append(new)
                    owners.append(np.full(len(grams), row))
            if owners:
                g, b, first, last = (np.concatenate(c) for c in columns)
                rows = pa.array(np.concatenate(owners))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(rows) for c in ("row", "doc_id", "mark")), pa.array(g), pa.array(b), pa.array(first, pa.int32()), pa.array(last, pa.int32())],
                    names=["row", "doc_id", "mark", "gram", "block", "first", "last"],
                )

    rows = texts.withColumn("row", F.monotonically_increasing_id())
    return arrow_map(rows, kernel, "row long, doc_id long, mark long, gram long, block long, first int, last int")


def _windows(texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(gram, block, low, high, at, window): the hash of each window of the wanted blocks."""

    def kernel(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(batch.num_rows):
            sums = sequence_sums(word_hashes(batch.column("text")[i].as_py()))
            asked = batch.column("wanted").slice(i, 1).flatten()
            first, last = (asked.field(c).to_numpy().astype(np.int64) for c in ("first", "last"))
            sizes = last - first + 1
            rows = np.repeat(np.arange(len(first)), sizes)
            at = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            start = first[rows] + at
            taken = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [*(asked.field(c).take(taken) for c in ("gram", "block", "low", "high")), pa.array(at, pa.int32()), pa.array(substring_hashes(sums, start, start + words).view(np.int64))],
                names=["gram", "block", "low", "high", "at", "window"],
            )

    per_document = wanted.groupBy(F.col("doc_id").alias("of"), F.col("mark").alias("of_mark")).agg(F.collect_list(F.struct("gram", "block", "low", "high", "first", "last")).alias("wanted"))
    joined = texts.join(per_document, texts["doc_id"].eqNullSafe(F.col("of")) & (texts["mark"] == F.col("of_mark")))
    return arrow_map(joined.select("text", "wanted"), kernel, "gram long, block long, low long, high long, at int, window long")


def covered(runs: list[tuple[int, int]], words: int) -> int:
    """Words that the windows cover; a run is its first window and the bits of those after it that count."""
    starts = np.unique([first + k for first, bits in runs for k in range(bits.bit_length()) if bits >> k & 1])
    return int(np.minimum(np.diff(starts), words).sum()) + words if len(starts) else 0


def shared_words(texts: DataFrame, words: int = WORDS, gram: int = GRAM) -> DataFrame:
    """(doc_id, mark, n_shared_words): words of each text of (doc_id, text, mark) in passages of ``words`` or more that another row has, too; texts without any have no row."""
    if not 1 <= gram < words <= gram + 62:
        raise ValueError("gram: under words, by 62 at most")
    every = written(_anchor_rows(texts, words, gram), "passage-anchors")
    grams = written(every.groupBy("gram").agg(F.min("row").alias("low"), F.max("row").alias("high")).where("low < high").select("gram"), "passage-grams")
    anchors = written(every.join(grams, "gram"), "passage-shared")
    forget(every, grams)
    blocks = anchors.groupBy("gram", "block").agg(F.min("row").alias("low"), F.max("row").alias("high"), F.min(F.struct("doc_id", "mark", "first", "last")).alias("place"))
    blocks = written(blocks, "passage-blocks")
    crowds = written(blocks.groupBy("gram").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1").select("gram"), "passage-crowds")
    windows = written(_windows(texts, blocks.join(crowds, "gram").select("gram", "block", "low", "high", "place.*"), words), "passage-windows")
    common = written(windows.groupBy("gram", "window").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("gram", "window"), "passage-common")
    found = windows.where("low = high").join(common, ["gram", "window"]).groupBy("gram", "block").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("bits"))
    # Every window of a block of two rows is shared.
    whole = blocks.where("low < high").select("gram", "block", F.expr("shiftleft(1L, place.last - place.first + 1) - 1").alias("bits"))
    bits = written(whole.unionByName(found), "passage-bits")
    forget(blocks, crowds, windows, common)
    per_document = anchors.join(bits, ["gram", "block"]).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("first", "bits")).alias("runs"))

    def kernel(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts = [covered([(r["first"], r["bits"]) for r in runs], words) for runs in batch.column("runs").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(counts, pa.int64())], names=["doc_id", "mark", "n_shared_words"])

    out = written(arrow_map(per_document, kernel, "doc_id long, mark long, n_shared_words long"), "passage-words")
    forget(anchors, bits)
    return out
