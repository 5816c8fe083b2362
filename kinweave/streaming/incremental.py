"""Streams of names against a table of known ones. An extension over the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions import text
from kinweave.plans.duplicates import blocked_names, score_pairs


def match_stream(stream: DataFrame, known: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Score each (id, name) of a stream or table against the known (id, name) with the same block key.

    A stream-static join on the key: stateless, so it runs in append mode without a watermark.
    """
    new = blocked_names(stream).select(F.col("id").alias("id1"), F.col("name").alias("name1"), F.col("key").alias("key1"), F.col("words").alias("words1"))
    old = blocked_names(known).select(F.col("id").alias("id2"), F.col("name").alias("name2"), F.col("key").alias("key2"), F.col("words").alias("words2"))
    pairs = new.join(old, (F.col("key1") == F.col("key2")) & text.share_word(F.col("words1"), F.col("words2"))).select("id1", "id2", "name1", "name2")
    return score_pairs(pairs, threshold)


def start_matching(stream: DataFrame, known: DataFrame, path: str, checkpoint: str, threshold: float = 0.85):
    """Write the matches of a stream as Parquet, exactly once for each input row."""
    return match_stream(stream, known, threshold).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").start(path)
