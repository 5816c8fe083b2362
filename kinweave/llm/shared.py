"""Helpers that the operators share: written intermediate tables, Arrow mapping, word and hash kernels."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from kinweave.packaging import ship_package

#: Words are runs of bytes that are none of these; bytes.split() separates at the same six.
SPACE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: The same as a Java or RE2 pattern.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, local mode gets a temporary one; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = Path(tempfile.mkdtemp(prefix="kinweave-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table into the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kinweave/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kinweave_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that written() has made, once nothing reads them any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._kinweave_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def row_keys(df: DataFrame) -> list[Column]:
    """Two hashes of a whole row, 128 bits together; only rows that are equal in every column agree in both."""
    whole = [F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`") for f in df.schema.fields]
    return [F.xxhash64(*whole).alias("_row_1"), F.xxhash64(F.lit(20), *whole, F.lit(1)).alias("_row_2")]


def arrow_map(df: DataFrame, kernel: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a kernel for one batch at a time."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from kernel(batch)

    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    for value in column.cast(pa.binary()).to_pylist() if len(column) < 65 else _slices(column):
        yield value or b""


def _slices(column: pa.Array) -> Iterator[bytes | None]:
    binary = column.cast(pa.binary())
    for start in range(0, len(binary), 64):
        yield from binary.slice(start, 64).to_pylist()


_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACE_BYTES)] = True
_RANDOM = np.random.default_rng(20240607)
_BYTE_VALUES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


@functools.lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64, n of them."""
    return _powers(base, max(1 << 17, 1 << max(0, n - 1).bit_length()))[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sequence_sums(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums of an array of 64-bit hashes; substring_hashes() needs them."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(_BASE, len(values)), out=sums[1:])
    return sums


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """The same of a byte array."""
    return sequence_sums(_BYTE_VALUES[buf])


def substring_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end], equal for equal substrings wherever they stand."""
    n = len(sums)
    raw = (sums[ends] - sums[starts]) * powers(_INVERSE, n)[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[buf]
    steps = np.diff(inside)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, in order."""
    buf = np.frombuffer(text, dtype=np.uint8)
    starts, ends = word_bounds(buf)
    return substring_hashes(prefix_sums(buf), starts, ends) if len(starts) else np.zeros(0, dtype=np.uint64)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows over a sequence of word hashes."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    size = len(words) - n + 1
    out = mix(words[:size] + np.uint64(n))
    for k in range(1, n):
        out = mix(out ^ words[k : k + size])
    return out


#: Distinct edges up to which one task finds the components by itself.
SMALL_GRAPH = 200_000


def components_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component) of a whole graph (a, b) in arrays: labels hook to the smallest around them, and jump to that one's, until none changes."""
    parts = [(np.array(batch.column("a")), np.array(batch.column("b"))) for batch in batches if batch.num_rows]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        least, low = np.minimum(label[u], label[v]), label.copy()
        for place in (u, v, label[u], label[v]):
            np.minimum.at(low, place, least)
        low = low[low]
        if (low == label).all():
            break
        label = low
    for start in range(0, len(ids), 100_000):
        cut = slice(start, start + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(ids[cut]), pa.array(ids[label[cut]])], names=["id", "component"])


def connected(spark: SparkSession, edges: DataFrame, name: str) -> DataFrame:
    """Components of an undirected graph (a, b): returns (id, component) with the smallest id, for each id that has an edge.

    Each round points every node at the smallest node among its neighbours and its own label, then at
    that one's label (hook and jump); both aggregate partially, so a hub doesn't land in one task.
    The loop ends when no label changes. A small graph takes one task instead of the loop, whose stages each
    cost the driver memory.
    """
    edges = written(edges.selectExpr("least(a, b) a", "greatest(a, b) b").distinct(), f"{name}-edges")
    if edges.count() <= SMALL_GRAPH:
        ship_package(spark)
        out = written(edges.coalesce(1).mapInArrow(components_of, "id long, component long"), f"{name}-components")
        forget(edges)
        return out
    both = written(edges.selectExpr("a as id", "b as other").unionByName(edges.selectExpr("b as id", "a as other")).distinct(), f"{name}-graph")
    forget(edges)
    labels = written(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("label")), f"{name}-labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("label").alias("near"))
        hooked = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("new"))
        # A node's label may itself have found a smaller one: hand that on to all who carry the label.
        root = hooked.groupBy(F.col("label").alias("root")).agg(F.min("new").alias("down"))
        jump = labels.select(F.col("id").alias("new"), F.col("label").alias("onward"))
        moved = (
            hooked.join(root, hooked.label == root.root, "left")
            .join(jump, "new", "left")
            .select("id", F.least("new", F.coalesce("down", "new"), F.coalesce("onward", "new")).alias("label"), F.col("label").alias("old"))
        )
        moved = written(moved, f"{name}-round")
        forget(labels)
        labels = moved
        if moved.where("label < old").isEmpty():
            forget(both)
            return labels.select("id", F.col("label").alias("component"))
