"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions.

``mixture_targets`` clamps every source at ``max_epochs`` times its size and hands the excess to the
other sources in proportion to their weights until none is above; the fixed point is one water level
``x`` with ``target = min(cap, x * weight)``. Over the sources ordered by cap / weight, the levels that
assume all earlier sources full rise until the first one that holds and fall after it, so it is the
largest that holds.

``mix_sources`` then repeats whole documents ``floor(target / size)`` times and takes the fractional
repetition in a seeded order of the documents, the last one in part, so that a source's words meet its
target to a word. The running sums are taken over fixed hash slices of a source first and inside one
slice second, so a source with a third of all rows is spread over many tasks.

Defined cases: a null text counts 0 words; a null source is a source of its own, after all others; a
source without words gets target 0; repeated rows count as often as they stand; rows with equal
doc_id, source and size get their shares in either order; an empty table gives an empty result; further columns of the
input are ignored unless named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.llm.shared import WORD_PATTERN, table, written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = 17
SLICE_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def mixture_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> (source, source_size, weight, target); one row per source in both."""
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    table_of_weights = F.array(*[F.lit(float(w)) for w in weights])
    sources = sizes.withColumn("weight", F.get(table_of_weights, (rank % len(weights)).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # The level if all sources before this one are full and this one is not.
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    levels = sources.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share))).withColumn("level", level)
    open_level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything)
    water = levels.withColumn("water", open_level)
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("water") * F.col("weight")))
    return water.select("source", "source_size", "weight", target.alias("target"))


def mix_sources(
    documents: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED, slice_digits: int = SLICE_DIGITS
) -> DataFrame:
    """Return per document doc_id, source, size, source_size, target, taken: the words the mix takes, repeats counted."""
    sized = documents.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("source"), F.col("size").cast("string")))
    sized = written(sized.withColumn("draw", draw), "mix-sizes")
    sized = sized.withColumn("slice", F.substring("draw", 1, slice_digits))
    per_slice = sized.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    totals = per_slice.groupBy("source").agg(F.sum("slice_size").alias("source_size"))
    targets = mixture_targets(totals, weights, share, max_epochs)
    in_order = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.withColumn("slice_start", F.coalesce(F.sum("slice_size").over(in_order), F.lit(0)))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    offsets = offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select(
        F.col("o.source").alias("of_source"), F.col("o.slice").alias("of_slice"), "slice_start", "source_size", "target"
    )
    joined = sized.join(offsets, same(sized, {"source": offsets["of_source"]}) & (sized["slice"] == offsets["of_slice"]))
    within = Window.partitionBy("source", "slice").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("slice_start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("start")))
    return (
        joined.withColumn("start", start)
        .withColumn("epochs", epochs)
        .withColumn("rest", rest)
        .select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))
    )


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = {
    "op6_mix": rf"""
    WITH sized AS (
        SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD_PATTERN}')), 0)::BIGINT AS size FROM documents),
    drawn AS (
        SELECT *, md5(concat_ws('|', '{SEED}', doc_id::VARCHAR, source, size::VARCHAR)) AS draw FROM sized),
    sources AS (
        SELECT source, sum(size)::BIGINT AS source_size,
               ({list(WEIGHTS)})[1 + (row_number() OVER (ORDER BY source IS NULL, source::BLOB) - 1) % {len(WEIGHTS)}] AS weight
        FROM sized GROUP BY source),
    capped AS (SELECT *, source_size * {MAX_EPOCHS}::DOUBLE AS cap FROM sources),
    levels AS (
        SELECT *, ((SELECT sum(source_size) FROM sources)::BIGINT * {SHARE}::DOUBLE - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
        FROM capped WINDOW w AS (ORDER BY cap / weight, source IS NULL, source::BLOB)),
    targets AS (
        SELECT *, coalesce(least(cap, weight * (SELECT max(level) FROM levels WHERE level * weight <= cap)), cap)::DOUBLE AS target FROM levels),
    shares AS (
        SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM targets),
    placed AS (
        SELECT d.doc_id, d.size, s.source_size, s.target, s.epochs, floor(s.target - s.epochs * s.source_size)::BIGINT AS rest,
               coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin_at
        FROM drawn d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source)
    SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - begin_at)))::BIGINT AS taken FROM placed
    """,
}
