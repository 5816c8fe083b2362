"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that starts anywhere else as well.

A full suffix array of the corpus would shuffle every suffix. Here only the windows that can repeat are
sorted, and exactly:

1. Winnowing. Of every window of ``length`` bytes the anchor is its substring of ANCHOR bytes with the
   smallest hash, the leftmost of equal ones. Equal windows have equal anchors at equal offsets. Each
   anchor owns a run of windows; the run's bytes are its block, of at most 2 * length - ANCHOR bytes.
2. Anchors whose hash occurs once in the corpus own no repeated window; their counts are partial sums.
   Blocks that are equal become one with a count, so copies never meet as rows.
3. The blocks that are left are sorted per anchor hash: all their windows as suffixes, deep-shallow.
   A multikey quicksort, eight bytes a step over whole arrays, goes down to SHALLOW bytes; the suffixes
   that still agree are put in order by blind tries (Patricia tries that compare each suffix once).
   Windows that agree over ``length`` bytes and count two or more places are repeated.
   Anchors with more than HOT blocks are dealt out by the bytes that SLICE neighbouring windows share,
   so a passage in a third of all documents spreads over many tasks.
4. The windows found are put back in place, merged into runs and cut out.

Passages of over 50 words that another document has, too, are counted beside that, by shared_passages: most of 51
words have fewer than ``length`` bytes, so they stay in the text.

Defined cases: a null text is empty; rows with the same doc_id are documents of their own, told apart by
their bytes, and a row that is there twice repeats itself; texts under ``length`` bytes lose nothing; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.shared import arrow_map, forget, prefix_sums, ship_package, table, text_bytes, written
from kinweave.llm.shared_passages import WORDS, shared_words
from kinweave.llm.winnowing import block_hashes, runs_of_anchors

LENGTH = 400
ANCHOR = 128
SHALLOW = 32
#: Distinct blocks of an anchor from which it is dealt out by slices of SLICE windows.
HOT = 2000
SLICE = 16
#: Bytes of blocks that are sorted at once, about.
SORT_BYTES = 4 << 20


def anchors_of(text: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(anchor hash, block hash, first window, last window, anchor's place) of every anchor's run of windows."""
    sums = prefix_sums(np.frombuffer(text, dtype=np.uint8))
    grams, first, last, place = runs_of_anchors(sums, length, anchor)
    return grams, block_hashes(sums, first, last, length), first, last, place


def _texts(documents: DataFrame) -> DataFrame:
    return documents.selectExpr("cast(doc_id as long) doc_id", "cast(coalesce(text, '') as binary) text").withColumn("mark", F.xxhash64("text"))


def _anchor_rows(texts: DataFrame, length: int, anchor: int) -> DataFrame:
    def kernel(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start in range(0, batch.num_rows, 128):
            part = batch.slice(start, 128)
            columns: list[list[np.ndarray]] = [[], [], [], [], []]
            owners = []
            for row, text in enumerate(text_bytes(part.column("text"))):
                if len(text) >= length:
                    found = anchors_of(text, length, anchor)
                    for kept, new in zip(columns, found, strict=True):
                        kept.append(new.astype(np.int64) if new.dtype != np.uint64 else new.view(np.int64))
                    owners.append(np.full(len(found[0]), row))
            if owners:
                g, b, first, last, anchor_at = (np.concatenate(c) for c in columns)
                rows = pa.array(np.concatenate(owners))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(rows), part.column("mark").take(rows), pa.array(g), pa.array(b), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(anchor_at, pa.int32())],
                    names=["doc_id", "mark", "gram", "block", "first", "last", "anchor"],
                )

    return arrow_map(texts, kernel, "doc_id long, mark long, gram long, block long, first int, last int, anchor int")


def _cut_blocks(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(part, gram, block, copies, at, content): the wanted blocks' bytes; those of hot anchors in slices that begin at window ``at`` of the block."""

    def kernel(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(batch.num_rows):
            text, rows = batch.column("text")[i].as_py(), []
            for w in batch.column("wanted")[i].as_py():
                first, last = w["first"], w["last"]
                block = text[first : last + length]
                if not w["hot"]:
                    rows.append((w["gram"], w["gram"], w["block"], w["copies"], 0, block))
                    continue
                # Slices are counted from the anchor, so equal windows fall into slices of equal shared bytes.
                offset = w["anchor"] - first
                for low in range((offset - (last - first)) // SLICE * SLICE, offset + 1, SLICE):
                    start, stop = max(0, offset - (low + SLICE - 1)), min(last - first, offset - low)
                    if start <= stop:
                        core = block[offset - low : offset - low - SLICE + 1 + length]
                        part = int.from_bytes(hashlib.blake2b(core, digest_size=8, salt=(low & 0xFFFF).to_bytes(2, "big")).digest(), "big", signed=True)
                        rows.append((part, w["gram"], w["block"], w["copies"], start, block[start : stop + length]))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                for k in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + 4096], strict=True), kinds, strict=True)], names=["part", "gram", "block", "copies", "at", "content"])

    per_document = wanted.groupBy(F.col("doc_id").alias("of"), F.col("mark").alias("of_mark")).agg(F.collect_list(F.struct("gram", "block", "copies", "first", "last", "anchor", "hot")).alias("wanted"))
    joined = texts.join(per_document, texts["doc_id"].eqNullSafe(F.col("of")) & (texts["mark"] == F.col("of_mark")))
    # A row that is there twice gives its blocks twice; they have copies, and the same runs are merged at the end.
    return arrow_map(joined.select("text", "wanted"), kernel, "part long, gram long, block long, copies long, at int, content binary")


class _Leaf:
    """Suffixes that agree over the whole length; the first stands for all."""

    __slots__ = ("key", "members")

    def __init__(self, key: bytes, member: int):
        self.key, self.members = key, [member]


class _Fork:
    """An inner node: the place of the first byte that differs, and the branches by that byte."""

    __slots__ = ("place", "branches")

    def __init__(self, place: int, branches: dict):
        self.place, self.branches = place, branches


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two different strings of equal length."""
    low, high = 0, len(a)
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def blind_trie_order(suffixes: list[tuple[bytes, int]]) -> list[list[int]]:
    """Classes of equal suffixes in sorted order. All strings have one length.

    A suffix goes down blindly, looking at the forking places only, to some leaf; one comparison with
    that leaf's string tells where they part, and there it branches off.
    """
    root: _Leaf | _Fork = _Leaf(*suffixes[0])
    for key, member in suffixes[1:]:
        node = root
        while type(node) is _Fork:
            node = node.branches.get(key[node.place]) or next(iter(node.branches.values()))
        if node.key == key:
            node.members.append(member)
            continue
        place = _common(node.key, key)
        above, node = None, root
        while type(node) is _Fork and node.place < place:
            above, node = node, node.branches[key[node.place]]
        if type(node) is _Fork and node.place == place:
            node.branches[key[place]] = _Leaf(key, member)
            continue
        probe = node
        while type(probe) is _Fork:
            probe = next(iter(probe.branches.values()))
        fork = _Fork(place, {probe.key[place]: node, key[place]: _Leaf(key, member)})
        if above is None:
            root = fork
        else:
            above.branches[key[above.place]] = fork
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if type(node) is _Leaf:
            out.append(node.members)
        else:
            stack += [node.branches[b] for b in sorted(node.branches, reverse=True)]
    return out


def deep_shallow(data: bytes, starts: np.ndarray, group: np.ndarray, length: int, shallow: int = SHALLOW) -> Iterator[np.ndarray]:
    """Sort the suffixes at ``starts`` within their groups by ``length`` bytes; yields the classes of two or more equal ones, as indexes."""
    buf = np.frombuffer(data + bytes(8), dtype=np.uint8)
    words = np.lib.stride_tricks.sliding_window_view(buf, 8)
    index, group = np.arange(len(starts)), group.copy()
    for depth in range(0, min(shallow, length // 8 * 8), 8):
        if not len(index):
            return
        key = np.ascontiguousarray(words[starts[index] + depth]).view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((key, group))
        index, group, key = index[order], group[order], key[order]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])))
        group = np.cumsum(new)
        sizes = np.bincount(group)
        several = sizes[group] > 1
        index, group = index[several], group[several]
    if not len(index):
        return
    bounds = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    places = starts[index].tolist()
    members = index.tolist()
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        suffixes = [(data[p : p + length], m) for p, m in zip(places[low:high], members[low:high])]
        for same in blind_trie_order(suffixes):
            if len(same) > 1:
                yield np.array(same)


def _sort_buffer(rows: list[tuple], length: int) -> Iterator[tuple[int, int, int, int]]:
    """(gram, block, first, last): runs of repeated windows of the blocks, counted from a block's start."""
    alone: dict[int, int] = {}
    for row in rows:
        alone[row[0]] = alone.get(row[0], 0) + 1
    data, starts, owner, part_no = [], [], [], []
    at, parts = 0, {}
    for k, (part, _, _, copies, _, content) in enumerate(rows):
        windows = len(content) - length + 1
        if alone[part] == 1:
            # One block with its copies is in order as it is.
            continue
        data.append(content)
        starts.append(np.arange(at, at + windows))
        owner.append(np.full(windows, k))
        part_no.append(np.full(windows, parts.setdefault(part, len(parts))))
        at += len(content)
    repeated: dict[int, np.ndarray] = {}
    if starts:
        joined = b"".join(data)
        places, owners = np.concatenate(starts), np.concatenate(owner)
        base = {int(o): int(s[0]) for o, s in zip((o[0] for o in owner), starts)}
        for same in deep_shallow(joined, places, np.concatenate(part_no), length):
            for k, place in zip(owners[same].tolist(), places[same].tolist()):
                if k not in repeated:
                    repeated[k] = np.zeros(len(rows[k][5]) - length + 1, dtype=bool)
                repeated[k][place - base[k]] = True
    for k, (_, gram, block, copies, first, content) in enumerate(rows):
        windows = len(content) - length + 1
        if copies > 1:
            yield gram, block, first, first + windows - 1
        elif k in repeated:
            steps = np.diff(np.concatenate(([0], repeated[k].astype(np.int8), [0])))
            for low, high in zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist()):
                yield gram, block, first + low, first + high - 1


def _sort_windows(blocks: DataFrame, length: int) -> DataFrame:
    ship_package(blocks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            out = list(_sort_buffer(rows, length))
            for k in range(0, len(out), 20_000):
                columns = zip(*out[k : k + 20_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["gram", "block", "low", "high"])

        held, size = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                for row in zip(*(c.to_pylist() for c in batch.slice(k, 1024).columns), strict=True):
                    if size > SORT_BYTES and row[0] != held[-1][0]:
                        yield from give(held)
                        held, size = [], 0
                    held.append(row)
                    size += len(row[5])
        if held:
            yield from give(held)

    dealt = blocks.repartition("part").sortWithinPartitions("part")
    return dealt.select("part", "gram", "block", "copies", "at", "content").mapInArrow(run, "gram long, block long, low int, high int")


def repeated_windows(texts: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """(doc_id, mark, low, high): runs of window starts whose window stands elsewhere, too."""
    every = written(_anchor_rows(texts, length, anchor), "suffix-anchors")
    # Counts are written before they are joined: both sides of the join are plain exchanges then, and Spark can split a hot anchor.
    grams = written(every.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "suffix-grams")
    anchors = written(every.join(grams, "gram"), "suffix-shared")
    forget(every, grams)
    blocks = anchors.groupBy("gram", "block").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "mark", "first", "last", "anchor")).alias("place"))
    blocks = written(blocks, "suffix-blocks")
    crowds = written(blocks.groupBy("gram").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1"), "suffix-crowds")
    # Blocks without another under their anchor need no sorting: they repeat if they have copies.
    met = blocks.join(crowds, "gram", "left").select("gram", "block", "copies", "place.*", F.coalesce("crowd", F.lit(1)).alias("crowd"))
    single = met.where("crowd = 1 and copies > 1").select("gram", "block", F.lit(0).alias("low"), (F.col("last") - F.col("first")).alias("high"))
    several = met.where("crowd > 1").withColumn("hot", F.col("crowd") > hot)
    found = _sort_windows(_cut_blocks(texts, several, length), length)
    runs = written(single.unionByName(found), "suffix-runs")
    forget(blocks, crowds)
    placed = anchors.join(runs, ["gram", "block"])
    return placed.select("doc_id", "mark", (F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high")).alias("high"))


def cut_text(text: bytes, runs: list[tuple[int, int]], length: int) -> tuple[int, int, bytes]:
    """(bytes removed, maximal removed runs, what is left) of a text whose windows ``runs`` (first, last) are repeated."""
    kept, at, removed, spans = [], 0, 0, 0
    end = -1
    for low, high in sorted(runs):
        start, stop = low, high + length
        if start > end:
            kept.append(text[max(at, 0) : start])
            spans += 1
            removed += stop - start
            end = stop
        elif stop > end:
            removed += stop - end
            end = stop
        at = end
    kept.append(text[max(at, 0) :])
    return removed, spans, b"".join(kept)


def dedup_substrings(documents: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT, words: int | None = None) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept (binary): what is left after the repeated bytes are cut out.

    With ``words``, n_shared_words as well: the words in passages of that many words or more that another document has, too.
    """
    if not 8 <= anchor < length:
        raise ValueError("anchor: from 8 to under length")
    texts = _texts(documents)
    passages = shared_words(texts, words) if words else None
    runs = repeated_windows(texts, length, anchor, hot)
    per_document = runs.groupBy(F.col("doc_id").alias("of"), F.col("mark").alias("of_mark")).agg(F.collect_list(F.struct("low", "high")).alias("runs"))
    joined = texts.join(per_document, texts["doc_id"].eqNullSafe(F.col("of")) & (texts["mark"] == F.col("of_mark")), "left").select(texts["doc_id"], texts["mark"], "text", "runs", F.lit(0).cast("long").alias("n_shared_words"))
    if passages is not None:
        known = passages.select(F.col("doc_id").alias("of"), F.col("mark").alias("of_mark"), F.col("n_shared_words").alias("found"))
        joined = joined.join(known, joined["doc_id"].eqNullSafe(F.col("of")) & (joined["mark"] == F.col("of_mark")), "left").withColumn("n_shared_words", F.coalesce("found", "n_shared_words"))
    joined = joined.select("doc_id", "text", "runs", "n_shared_words")

    def kernel(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            texts_, runs_ = part.column("text").to_pylist(), part.column("runs").to_pylist()
            cut = [cut_text(t, [(r["low"], r["high"]) for r in rs or ()], length) for t, rs in zip(texts_, runs_, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(t) for t in texts_], pa.int64()), pa.array([c[0] for c in cut], pa.int64()), pa.array([c[1] for c in cut], pa.int64()), pa.array([c[2] for c in cut], pa.binary()), part.column("n_shared_words")],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_shared_words"],
            )

    out = arrow_map(joined, kernel, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, n_shared_words long")
    return out if words else out.drop("n_shared_words")


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup_substrings(table(spark, sf_dir, "documents"), words=WORDS)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_shared_words")
