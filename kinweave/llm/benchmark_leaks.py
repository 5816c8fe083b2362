"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Texts are lower-cased and cut into words at everything but letters and digits; shingles are SHINGLE words.
The items are partitioned by their number of shingles (powers of two). Inside a partition an item's sketch
is its bottom-k MinHash: the k shingles with the smallest hashes, k from the partition's upper size. An
item of n shingles that a document contains to the share ``threshold`` misses at most (1 - threshold) * n
of them, so at least ``k - floor((1 - threshold) * n)`` of its sketch are among the document's shingles:
the candidate test needs that many and loses no match. The verification counts shared shingles as words.

The sketches are broadcast when there are at most BROADCAST_ROWS of them, which is checked; beyond that
the document shingles are shuffled. Only SQL functions are used.

An item of fewer words than SHINGLE has one shingle, all its words. Documents are also cut into windows of
so many words then, for the sizes that some item has.

Defined cases: null texts and texts without words match nothing; a null doc_id is a document's name like any
other; rows that share a doc_id are held against the items each for itself, and find_leaks() reports the best
containment, once; without_leaks() drops the rows that hold an item, not others of their doc_id; items with
equal texts are both reported; empty tables give an empty result; other columns of either input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.shared import forget, row_keys, table, written

SHINGLE = 5
THRESHOLD = 0.8
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text.cast("string")), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _windows(words: Column, size: int, make) -> Column:
    """make(words, i) at each window start, none for texts of fewer words. words must be a column of its own: a lambda evaluates what it holds at every step."""
    starts = F.sequence(F.lit(0), F.size(words) - F.lit(size))
    return F.when(F.size(words) >= size, F.transform(starts, lambda i: make(words, i)))


def hashed_shingles(words: Column, size: int = SHINGLE) -> Column:
    return F.array_distinct(_windows(words, size, lambda w, i: F.xxhash64(*[F.get(w, i + k) for k in range(size)])))


def spelled_shingles(words: Column, size: int = SHINGLE) -> Column:
    return F.array_distinct(_windows(words, size, lambda w, i: F.array_join(F.slice(w, i + 1, size), " ")))


def _of_sizes(shingles, words: Column, sizes: list[int]) -> Column:
    """The shingles of all these sizes."""
    parts = [F.coalesce(shingles(words, n), F.array().cast("array<bigint>" if shingles is hashed_shingles else "array<string>")) for n in sizes]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def _of_item(shingles, words: Column) -> Column:
    """An item's shingles: of SHINGLE words, or all its words as one."""
    short = F.when(F.size(words) == 1, shingles(words, 1))
    for n in range(2, SHINGLE):
        short = short.when(F.size(words) == n, shingles(words, n))
    return short.otherwise(shingles(words))


def item_sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, shingle, needed): each item's bottom-k shingle hashes and how many of them a document must have."""
    hashes = items.withColumn("hashes", F.array_sort(_of_item(hashed_shingles, F.col("words")))).where("hashes is not null")
    n = F.size("hashes")
    upper = F.pow(F.lit(2), F.floor(F.log2(n)) + 1) - 1
    may_miss = lambda size: F.floor(F.round((1 - threshold) * size, 9)).cast("int")
    k = F.least(n, 2 * may_miss(upper) + 2)
    sized = hashes.select("item_id", "hashes", k.alias("k"), may_miss(n).alias("may_miss"))
    sketch = F.slice("hashes", F.lit(1), F.col("k"))
    return sized.select("item_id", F.explode(sketch).alias("shingle"), F.greatest(F.lit(1), F.col("k") - F.col("may_miss")).alias("needed"))


def _leaking_rows(documents: DataFrame, benchmark: DataFrame, threshold: float, broadcast_rows: int) -> DataFrame:
    """(doc_id, _row_1, _row_2, item_id, n_shingles, n_found) of the rows that hold an item; rows that are equal in every column are one."""
    keys = ["_row_1", "_row_2"]
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"), *row_keys(documents))
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words"))
    sketches = written(item_sketches(items, threshold), "leak-sketches")
    # SHINGLE sizes at most: those under it that some item needs, and SHINGLE.
    short = items.where(F.size("words").between(1, SHINGLE - 1)).select(F.size("words").alias("n")).distinct().collect()
    sizes = sorted({SHINGLE, *(r.n for r in short)})
    few = F.broadcast(sketches) if sketches.count() <= broadcast_rows else sketches
    shingles = texts.select(*keys, words_of(F.col("text")).alias("words")).select(*keys, F.explode(_of_sizes(hashed_shingles, F.col("words"), sizes)).alias("shingle"))
    candidates = (
        shingles.join(few, "shingle")
        .distinct()
        .groupBy(*keys, "item_id")
        .agg(F.count(F.lit(1)).alias("hits"), F.min("needed").alias("needed"))
        .where("hits >= needed")
        .select(*keys, "item_id")
    )
    candidates = written(candidates, "leak-candidates")
    forget(sketches)
    spelled = items.select("item_id", _of_item(spelled_shingles, F.col("words")).alias("item_shingles"))
    suspects = candidates.select(*keys).distinct().join(texts, keys).dropDuplicates(keys).select("doc_id", *keys, words_of(F.col("text")).alias("words"))
    suspects = suspects.select("doc_id", *keys, _of_sizes(spelled_shingles, F.col("words"), sizes).alias("doc_shingles"))
    pairs = candidates.join(suspects, keys).join(spelled, "item_id")
    counted = pairs.select("doc_id", *keys, "item_id", F.size("item_shingles").alias("n_shingles"), F.size(F.array_intersect("item_shingles", "doc_shingles")).alias("n_found"))
    return counted.where(F.col("n_found") >= F.round(F.col("n_shingles") * threshold, 9))


def find_leaks(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found): items of which a document holds threshold or more of the distinct shingles."""
    rows = _leaking_rows(documents, benchmark, threshold, broadcast_rows)
    return rows.groupBy("doc_id", "item_id").agg(F.max("n_shingles").alias("n_shingles"), F.max("n_found").alias("n_found"))


def without_leaks(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents that hold no benchmark item, with all their columns."""
    leaks = _leaking_rows(documents, benchmark, threshold, BROADCAST_ROWS).select("_row_1", "_row_2").distinct()
    names = [f"`{c}`" for c in documents.columns]
    return documents.select("*", *row_keys(documents)).join(leaks, ["_row_1", "_row_2"], "left_anti").select(*names)


def op7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("n_shingles").cast("long"), F.col("n_found").cast("long"))


def _windows_sql(source: str, key: str) -> str:
    """(key, s): distinct windows of SHINGLE words, and of texts with fewer words all of them."""
    return f"""SELECT DISTINCT {key}, s FROM (SELECT {key}, unnest(list_transform(range(greatest(len(w) - {SHINGLE - 1}, 1)), lambda k: array_to_string(w[k + 1 : k + {SHINGLE}], ' '))) AS s
           FROM {source} WHERE len(w) > 0)"""


ORACLE = {
    "op7_leaks": rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w FROM documents),
    i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w FROM benchmark),
    short AS (SELECT DISTINCT len(w) AS size FROM i WHERE len(w) BETWEEN 1 AND {SHINGLE - 1}),
    ds AS ({_windows_sql("(SELECT r, w FROM d WHERE len(w) >= " + str(SHINGLE) + ")", "r")}
           UNION SELECT r, s FROM (SELECT r, unnest(list_transform(range(len(w) - size + 1), lambda k: array_to_string(w[k + 1 : k + size], ' '))) AS s FROM d JOIN short ON len(w) >= size)),
    ish AS ({_windows_sql("i", "item_id")}),
    n AS (SELECT item_id, count(*) AS n_shingles FROM ish GROUP BY item_id),
    found AS (SELECT r, item_id, n_shingles, count(*) AS n_found FROM ds JOIN ish USING (s) JOIN n USING (item_id) GROUP BY r, item_id, n_shingles)
    SELECT doc_id, item_id, n_shingles, max(n_found) AS n_found FROM found JOIN d USING (r)
    WHERE n_found >= round(n_shingles * {THRESHOLD}, 9) GROUP BY doc_id, item_id, n_shingles
    """,
}
