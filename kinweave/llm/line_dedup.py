"""Line dedup: a deletion-neighbourhood join of lines within one edit, keeping the earliest.

Lines are the \\n-split parts of a text without white space at both ends; lines of fewer than ``min_chars``
code points, by default the blank ones, are left alone. A line is removed when an earlier line, by (doc_id,
row, line number), equals it or, where both have ``near_chars`` code points or more, lies within ``max_edits``
(0 or 1) insertions, deletions or substitutions of a code point. All is judged on the input, so of a chain
a, b, c with a-b and b-c in reach only a stays.

1. Every line gets a 128-bit hash; equal lines are brought together and only the earliest goes on.
2. A line is cut into SEGMENTS parts. Two lines in reach agree in all but one, cut for the shorter one's
   length. Each line gives a key for each part that may differ: the joint hash of what stands before and
   behind it, once cut for its own length and once for one less. Keys that one line has alone are dropped,
   and so are lines without a key left. This loses no pair.
3. The rest emit their deletion variants as hashed keys: each line without one code point, in the parts
   that the shared keys leave open, keyed with the place (substitutions) or without it (insertions, where
   the shorter line is its own variant). Per variant key and kind only the earliest line is aggregated,
   so a key with a third of all rows is a partial minimum, and no pairs are formed.
4. A line whose variant group has an earlier line is verified against that one by edit distance.

Defined cases: a null text has one empty line; rows go by a hash of all their columns, so rows that share a
doc_id are told apart, and those that are equal in every column stand at the same places and don't remove
each other's lines; a null doc_id comes after all others; an empty table gives an empty result; other columns
are kept by ``dedup_lines`` and ignored by ``line_removals``. Lines of any length are treated whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.shared import arrow_map, forget, mix, powers, row_keys, table, text_bytes, written

MIN_CHARS = 1
#: From here on lines one edit apart are joined; in shorter ones an edit makes another word or number ("cat", "car").
NEAR_CHARS = 6
#: Parts of a line of which one may differ.
SEGMENTS = 4
#: Keys under which lines may be shared: broadcast up to so many, which is checked, and shuffled beyond.
BROADCAST_KEYS = 1_000_000
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_INVERSES = tuple(pow(base, -1, 2**64) for base in _BASES)
#: Rows of one Arrow batch that the kernels give out at most.
_ROWS = 50_000


class _Hasher:
    """Substring hashes of an array of code points, with one of two bases."""

    def __init__(self, codes: np.ndarray, which: int = 0):
        self.which = which
        self.values = mix(codes.astype(np.uint64) + np.uint64(1 + which)) | np.uint64(1)
        self.sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(self.values * powers(_BASES[which], len(codes)), out=self.sums[1:])

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * powers(_INVERSES[self.which], len(self.sums))[starts]

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(self.raw(starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _codes(text: bytes) -> np.ndarray:
    return np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)


def line_bounds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all lines, white space at both ends left out."""
    breaks = np.flatnonzero(codes == 10)
    starts, ends = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(codes)]))
    solid = np.flatnonzero(~((codes == 32) | ((codes >= 9) & (codes <= 13))))
    first, last = np.searchsorted(solid, starts), np.searchsorted(solid, ends) - 1
    some = first <= last
    padded = np.append(solid, 0)
    return np.where(some, padded[np.minimum(first, len(solid))], starts), np.where(some, padded[np.maximum(last, 0)] + 1, starts)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def cuts(size: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the part of a line of that size begins and ends."""
    return size * part // SEGMENTS, size * (part + 1) // SEGMENTS


def _joint(hasher: _Hasher, starts: np.ndarray, ends: np.ndarray, part: int, longer: int) -> np.ndarray:
    """The hash of a line but for one part; longer: 1 for the part of a line that has one code point less."""
    size = ends - starts - longer
    low, high = cuts(size, part)
    head, tail = hasher(starts, starts + low), hasher(ends - (size - high), ends)
    return _signed(mix(mix(head ^ np.uint64(part + 1)) + tail + size.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)))


#: Code points that are hashed at once, about: texts are joined up to so many, a longer one goes alone.
_AT_ONCE = 1 << 16


def _line_rows(texts: list[bytes], min_chars: int) -> dict[str, np.ndarray]:
    """For each text a row with line -1 and size its number of lines; a row for each line that takes part."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("row", "line", "size", "h1", "h2", *_KEYS)}
    held, size = [], 0
    for row, text in enumerate(texts):
        held.append(text)
        size += len(text)
        if size >= _AT_ONCE or row + 1 == len(texts):
            for k, v in _joined_rows(held, row + 1 - len(held), min_chars).items():
                out[k].append(v)
            held, size = [], 0
    return {k: np.concatenate(v).astype(np.int64) if v else np.zeros(0, dtype=np.int64) for k, v in out.items()}


def _joined_rows(texts: list[bytes], first_row: int, min_chars: int) -> dict[str, np.ndarray]:
    """_line_rows() of a few texts, which are numbered from first_row, as one array of code points."""
    # A line feed never stands inside another code point, so the lines of the joined texts are those of each in turn.
    codes = _codes(b"\n".join(texts))
    starts, ends = line_bounds(codes)
    n_lines = np.array([text.count(b"\n") + 1 for text in texts])
    row = np.repeat(np.arange(len(texts)), n_lines)
    line = np.arange(len(starts)) - np.repeat(np.cumsum(n_lines) - n_lines, n_lines)
    lines = np.flatnonzero(ends - starts >= max(1, min_chars))
    starts, ends = starts[lines], ends[lines]
    one, two = _Hasher(codes, 0), _Hasher(codes, 1)
    got = {"row": row[lines] + first_row, "line": line[lines], "size": ends - starts, "h1": _signed(one(starts, ends)), "h2": _signed(two(starts, ends))}
    got |= {f"k{longer}{part}": _joint(one, starts, ends, part, longer) for longer in (0, 1) for part in range(SEGMENTS)}
    heads = {k: np.zeros(len(texts), dtype=np.int64) for k in got}
    heads |= {"row": np.arange(len(texts)) + first_row, "line": np.full(len(texts), -1), "size": n_lines}
    return {k: np.concatenate((heads[k], got[k])) for k in got}


_PLACE = "struct<last:boolean,doc_id:long,mark:long,line:int>"
_PLACE_TYPE = pa.struct([("last", pa.bool_()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("line", pa.int32())])
#: k0: the line's own parts, k1: those of a line with one code point less.
_KEYS = tuple(f"k{longer}{part}" for longer in (0, 1) for part in range(SEGMENTS))
_HASHES = ("h1", "h2", *_KEYS)


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), row_keys(documents)[0].alias("mark"), F.col("text").cast("string").alias("text"))


def _hash_lines(documents: DataFrame, min_chars: int) -> DataFrame:
    def kernel(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            rows = _line_rows(list(text_bytes(part.column("text"))), min_chars)
            of = pa.array(rows["row"])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(of), part.column("mark").take(of), pa.array(rows["line"], pa.int32()), pa.array(rows["size"], pa.int32()), *(pa.array(rows[k]) for k in _HASHES)],
                names=["doc_id", "mark", "line", "size", *_HASHES],
            )

    return arrow_map(_rows(documents), kernel, "doc_id long, mark long, line int, size int, " + ", ".join(f"{k} long" for k in _HASHES))


def deletion_variants(line: str, first: int, last: int) -> np.ndarray:
    """Hashes of the line without its code point at each place first .. last - 1."""
    codes = _codes(line.encode())
    hasher, at, n = _Hasher(codes), np.arange(first, last), len(codes)
    zero = np.zeros_like(at)
    head = hasher.raw(zero, at)
    tail = hasher.raw(at + 1, zero + n) * powers(_BASES[0], n + 1)[at]
    return mix(head + tail + np.uint64((n - 1) * 0xD6E8FEB86659FD93 % 2**64))


def whole_hash(line: str) -> int:
    """The hash of a line among the variants of longer ones."""
    codes = _codes(line.encode())
    return int(_Hasher(codes)(np.array([0]), np.array([len(codes)]))[0])


def _variant_rows(line: str, flags: int) -> list[tuple[int, np.ndarray]]:
    """(kind, variant keys) of one line: kind 0 substitutions, 1 variants of a longer line, 2 a shorter line itself.

    Flags, three bits for each part: all else is shared 1 with a line as long, 2 with a longer, 4 with a shorter one.
    """
    n, same, longer, shorter = len(line), [], [], False
    for part in range(SEGMENTS):
        bits = flags >> 3 * part & 7
        if bits & 1:
            low, high = cuts(n, part)
            same.append(mix(deletion_variants(line, low, high) ^ mix(np.arange(low, high).astype(np.uint64) + np.uint64(1 << 40))))
        if bits & 4:
            low, high = cuts(n - 1, part)
            longer.append(deletion_variants(line, low, high + 1))
        shorter |= bool(bits & 2)
    out = [(0, np.concatenate(same))] if same else []
    if longer:
        out.append((1, np.unique(np.concatenate(longer))))
    if shorter:
        out.append((2, np.array([whole_hash(line)], dtype=np.uint64)))
    return out


def _emit_variants(survivors: DataFrame) -> DataFrame:
    def kernel(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, kinds, owners, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            taken = pa.array(np.concatenate(owners))
            return pa.RecordBatch.from_arrays(
                [pa.array(_signed(np.concatenate(keys))), pa.array(np.concatenate(kinds), pa.int8()), batch.column("first").take(taken)], names=["variant", "kind", "first"]
            )

        for i in range(batch.num_rows):
            for kind, found in _variant_rows(batch.column("content")[i].as_py(), batch.column("flags")[i].as_py()):
                keys.append(found)
                kinds.append(np.full(len(found), kind))
                owners.append(np.full(len(found), i))
                held += len(found)
            if held > _ROWS:
                yield flush()
                keys, kinds, owners, held = [], [], [], 0
        if held:
            yield flush()

    return arrow_map(survivors.select("content", "flags", "first"), kernel, f"variant long, kind tinyint, first {_PLACE}")


def line_removals(documents: DataFrame, max_edits: int = 1, min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, line) of every line to remove, and (doc_id, mark, n_lines) of every row; mark: a hash of the row."""
    if max_edits not in (0, 1):
        raise ValueError("max_edits: 0 or 1")
    every = written(_hash_lines(documents, min_chars), "lines")
    sizes = written(every.where("line = -1").select("doc_id", "mark", F.col("size").alias("n_lines")), "line-counts")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark", "line")
    lines = every.where("line >= 0").withColumn("place", place)
    distinct = written(lines.groupBy("h1", "h2", "size").agg(F.min("place").alias("first"), *[F.first(k).alias(k) for k in _KEYS]), "lines-distinct")
    again = lines.select("h1", "h2", "size", "place").join(distinct.select("h1", "h2", "size", "first"), ["h1", "h2", "size"]).where("place > first").select("place.doc_id", "place.mark", "place.line")
    again = written(again.distinct(), "lines-again")
    forget(every)
    if max_edits == 0:
        return again, sizes

    # Which of its keys a line shares, and with what: as long (1), longer (2), shorter (4), shifted by the part.
    kinds = [F.struct(F.col(k).alias("key"), F.lit(2 * int(k[2:]) + int(k[1])).alias("kind")) for k in _KEYS]
    keys = distinct.where(F.col("size") >= near_chars).select("h1", F.explode(F.array(*kinds)).alias("k")).select("h1", "k.*")
    less = F.col("kind") % 2
    # A key that only longer lines have joins none: two of them need not be in reach of each other.
    ends = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(less).alias("n_long")).where("n > 1 and n > n_long")
    ends = written(ends, "line-shared-keys")
    if ends.count() <= BROADCAST_KEYS:
        ends = F.broadcast(ends)
    n_short = F.col("n") - F.col("n_long")
    bits = F.when(less == 0, F.when(n_short > 1, 1).otherwise(0) + F.when(F.col("n_long") > 0, 2).otherwise(0)).otherwise(F.when(n_short > 0, 4).otherwise(0))
    shared = keys.join(ends, "key").select("h1", (bits * F.pow(F.lit(8), F.floor(F.col("kind") / 2))).cast("int").alias("bits")).where("bits > 0")
    flags = shared.groupBy("h1").agg(F.bit_or("bits").alias("flags"))
    # Two lines with the same first hash would share their flags, which only makes more variants.
    survivors = distinct.join(flags, "h1").select("h1", "h2", "size", "first", "flags")

    def cut_out(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, wanted = batch.column("text"), batch.column("wanted")
        for i in range(batch.num_rows):
            codes = _codes((texts[i].as_py() or "").encode())
            starts, stops = line_bounds(codes)
            rows = [w for w in wanted[i].as_py() if w["first"]["line"] < len(starts)]
            # Of rows with the same doc_id, the one that has the line that was hashed.
            content = [codes[starts[w["first"]["line"]] : stops[w["first"]["line"]]].tobytes().decode("utf-32-le") for w in rows]
            good = [(w, c) for w, c in zip(rows, content, strict=True) if len(c) == w["size"] and np.uint64(whole_hash(c)).astype(np.int64) == w["h1"]]
            if good:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([w["h1"] for w, _ in good], pa.int64()), pa.array([w["h2"] for w, _ in good], pa.int64()), pa.array([w["flags"] for w, _ in good], pa.int32()),
                        pa.array([w["first"] for w, _ in good], _PLACE_TYPE), pa.array([c for _, c in good], pa.string()),
                    ],
                    names=["h1", "h2", "flags", "first", "content"],
                )

    per_document = survivors.groupBy(F.col("first.doc_id").alias("of"), F.col("first.mark").alias("of_mark")).agg(F.collect_list(F.struct("h1", "h2", "flags", "size", "first")).alias("wanted"))
    texts = _rows(documents)
    fetched = texts.join(per_document, texts["doc_id"].eqNullSafe(F.col("of")) & (texts["mark"] == F.col("of_mark"))).select("text", "wanted")
    survivors = written(arrow_map(fetched, cut_out, f"h1 long, h2 long, flags int, first {_PLACE}, content string").dropDuplicates(["h1", "h2"]), "lines-survivors")
    forget(distinct)
    variants = written(_emit_variants(survivors), "line-variants")
    # Two longer lines that share a variant need not be in reach of each other, so they are held against shorter ones alone.
    firsts = variants.groupBy("variant").agg(*[F.min(F.when(F.col("kind") == kind, F.col("first"))).alias(name) for kind, name in enumerate(("same", "longer", "shorter"))], F.count(F.lit(1)).alias("n"))
    firsts = written(firsts.where("n > 1").drop("n").withColumnRenamed("variant", "key"), "line-firsts")
    other = F.when(F.col("kind") == 0, F.col("same")).when(F.col("kind") == 1, F.col("shorter")).otherwise(F.col("longer"))
    pairs = variants.join(firsts, variants["variant"] == firsts["key"]).select("first", other.alias("earliest")).where("earliest < first").distinct()
    text_of = survivors.select(F.col("first").alias("at"), "content")
    verified = (
        pairs.join(text_of.withColumnRenamed("content", "a"), pairs["first"] == text_of["at"]).select("first", "earliest", "a")
        .join(text_of.withColumnRenamed("content", "b"), F.col("earliest") == F.col("at"))
        .where(F.levenshtein("a", "b", max_edits) >= 0)
        .select("first.doc_id", "first.mark", "first.line")
    )
    out = written(again.unionByName(verified).distinct(), "line-removals")
    forget(again, survivors, variants, firsts)
    return out, sizes


def dedup_lines(documents: DataFrame, max_edits: int = 1, min_chars: int = MIN_CHARS, drop_emptied: bool = True, near_chars: int = NEAR_CHARS) -> DataFrame:
    """The documents with all their columns, removed lines cut from the text; without those that lose all their words by it, unless told to keep them."""
    removals, _ = line_removals(documents, max_edits, min_chars, near_chars)
    gone = removals.groupBy(F.col("mark").alias("_line_dedup_mark")).agg(F.sort_array(F.collect_list("line")).alias("_line_dedup_gone"))
    marked = documents.select("*", row_keys(documents)[0].alias("_line_dedup_of"))
    joined = marked.join(gone, F.col("_line_dedup_of") == F.col("_line_dedup_mark"), "left")
    parts = F.col("_line_dedup_parts")
    joined = joined.withColumn("_line_dedup_parts", F.when(F.col("_line_dedup_gone").isNotNull(), F.split(F.col("text").cast("string"), "\n", -1)))
    places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_line_dedup_gone"))
    kept = F.array_join(F.transform(places, lambda i: F.get(parts, i)), "\n")
    text = F.when(F.col("_line_dedup_gone").isNull(), F.col("text")).otherwise(kept)
    cut = joined.withColumn("text", text)
    if drop_emptied:
        cut = cut.where(F.col("_line_dedup_gone").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return cut.select(*(f"`{c}`" for c in documents.columns))


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents."""
    removals, sizes = line_removals(table(spark, sf_dir, "documents"))
    gone = removals.groupBy(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark")).agg(F.count(F.lit(1)).alias("n_removed"), F.array_join(F.sort_array(F.collect_list("line")).cast("array<string>"), ",").alias("removed_lines"))
    joined = sizes.join(gone, sizes["doc_id"].eqNullSafe(gone["gone_id"]) & (sizes["mark"] == gone["gone_mark"]), "left")
    return joined.select("doc_id", F.col("n_lines").cast("long"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed_lines", F.lit("")).alias("removed_lines"))
