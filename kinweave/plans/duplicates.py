"""Duplicate names: normalize, block, pair, prefilter, score, filter.

The stages are DataFrame operations; only pairs that pass the prefilter reach Python. Distinct names are
paired, and rows of equal names are brought back by a join, so a name that is there a million times is
scored once. Foldings that are equal need no scoring (score 1.0) and are found in the JVM. Hot blocks are cut into groups, and
each pair of groups is a key of its own in the join; what is left to score is dealt out evenly over the workers.
"""

from __future__ import annotations

import functools
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.config import DEFAULT_COUNTRY, DUPLICATE_SCORE
from kinweave.functions import text
from kinweave.functions.legal_forms import LegalForm, Rule
from kinweave.operators.company import company_score, match_company_names
from kinweave.packaging import ship_package
from kinweave.plans.links import tile_links

#: Names of a group, about: a block of more is cut, so that no key of the join makes more than the square of it.
HOT_BLOCK = 500
#: Names of a group, about, where pairs are counted in arrays and not made.
TILE_GROUP = 2000


def with_ids(df: DataFrame, name_col: str, id_col: str | None) -> DataFrame:
    """(id, name). Without an id column rows are numbered by name: a stable order, not the input's."""
    if id_col is not None:
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(name_col).cast("string").alias("name"))
    counts = df.groupBy(F.col(name_col).cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    first = counts.withColumn("id", F.coalesce(F.sum("n").over(Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return first.select(F.explode(F.sequence(F.col("id"), F.col("id") + F.col("n") - 1)).alias("id"), "name")


def blocked_names(names: DataFrame) -> DataFrame:
    """(id, name, normalized, key, words)."""
    normalized = names.withColumn("normalized", text.normalize_name(F.col("name")))
    return normalized.withColumn("key", text.block_key(F.col("normalized"))).withColumn("words", F.split("normalized", r"\s+"))


def block_stats(names: DataFrame) -> DataFrame:
    """(key, n, pairs): sizes of the blocks."""
    return blocked_names(names).groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("pairs", F.col("n") * (F.col("n") - 1) / 2)


def _sided(names: DataFrame, side: str, columns: Sequence[str]) -> DataFrame:
    return names.select(*[F.col(c).alias(f"{c}{side}") for c in columns])


def candidate_pairs(names: DataFrame, hot_block: int = HOT_BLOCK) -> DataFrame:
    """(id1, id2, name1, name2) with id1 < id2: pairs of one block that share a word or the beginning of one."""
    blocked = blocked_names(names)
    sizes = blocked.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    cuts = sizes.select("key", F.ceil(F.col("n") / hot_block).cast("int").alias("groups"))
    mine, every = F.pmod(F.xxhash64("id"), F.col("groups")).cast("int"), F.sequence(F.lit(0), F.col("groups") - 1)
    grouped = blocked.join(cuts, "key").withColumn("mine", mine).withColumn("other", F.explode(every))
    columns = ("id", "name", "key", "words", "mine", "other")
    left, right = _sided(grouped, "1", columns), _sided(grouped, "2", columns)
    pair = (F.col("key1") == F.col("key2")) & (F.col("mine1") == F.col("other2")) & (F.col("other1") == F.col("mine2")) & (F.col("id1") < F.col("id2"))
    return left.join(right, pair & text.share_word(F.col("words1"), F.col("words2"))).select("id1", "id2", "name1", "name2")


def all_pairs(names: DataFrame) -> DataFrame:
    """Every pair with id1 < id2. Quadratic: for up to some ten thousand names."""
    left, right = _sided(names, "1", ("id", "name")), _sided(names, "2", ("id", "name"))
    return left.join(right, F.col("id1") < F.col("id2")).select("id1", "id2", "name1", "name2")


def fold_equal_pairs(names: DataFrame) -> DataFrame:
    """(id1, id2, name1, name2) of names that are equal under some folding: an equi-join on the foldings."""
    variants = names.select("id", "name", F.explode(F.array_distinct(text.fold_variants(F.col("name")))).alias("folded"))
    left, right = _sided(variants, "1", ("id", "name", "folded")), _sided(variants, "2", ("id", "name", "folded"))
    return left.join(right, (F.col("folded1") == F.col("folded2")) & (F.col("id1") < F.col("id2"))).select("id1", "id2", "name1", "name2").distinct()


def score_pairs(pairs: DataFrame, threshold: float = DUPLICATE_SCORE, rules: Sequence[Rule] = (), forms: dict[str, Sequence[LegalForm]] | None = None) -> DataFrame:
    """Pairs with a score over the threshold."""
    spark = pairs.sparkSession
    ship_package(spark)
    # Pairs are small rows and dear to score: left to their size, all of them would come to one worker.
    pairs = pairs.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    upper = lambda c: F.upper(text.trim_controls(F.col(c)))
    equal = (upper("name1") != "") & (upper("name2") != "") & text.equal_folded(upper("name1"), upper("name2"))
    known = pairs.withColumn("equal", F.coalesce(equal, F.lit(False)))
    # Names that are equal when folded are not sent to Python: their names are null there.
    asked = [F.when(~F.col("equal"), F.col(c)) for c in ("name1", "name2")]
    scored = known.withColumn("score", F.when(F.col("equal"), F.lit(1.0)).otherwise(company_score(*asked, rules, forms)))
    return scored.where(F.col("score") > threshold).drop("equal")


def find_duplicates(
    df: DataFrame, name_col: str = "name", id_col: str | None = None, threshold: float = DUPLICATE_SCORE, mode: str = "blocked",
    rules: Sequence[Rule] = (), forms: dict[str, Sequence[LegalForm]] | None = None, expand: bool = True,
) -> DataFrame:
    """(id1, id2, name1, name2, score) of names that are likely the same company's; id1 < id2.

    mode "blocked" pairs names with equal block keys, "exhaustive" all. With expand=False a name that
    several rows have appears with its smallest id only, and pairs of equal names are left out.
    Scores depend on the order of a pair; equal names on several rows take the order of their smallest ids.
    """
    rows = with_ids(df, name_col, id_col).where("name is not null")
    names = rows.groupBy("name").agg(F.min("id").alias("id")).select("id", "name")
    if mode not in ("blocked", "exhaustive"):
        raise ValueError("mode: blocked or exhaustive")
    pairs = candidate_pairs(names) if mode == "blocked" else all_pairs(names)
    scored = score_pairs(pairs, threshold, rules, forms)
    if not expand:
        return scored.select("id1", "id2", "name1", "name2", "score")
    one, two = _sided(rows, "_a", ("id", "name")), _sided(rows, "_b", ("id", "name"))
    different = scored.join(one, F.col("name1") == F.col("name_a")).join(two, F.col("name2") == F.col("name_b"))
    swap = F.col("id_a") > F.col("id_b")
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    different = different.select(pick("id_a", "id_b").alias("id1"), pick("id_b", "id_a").alias("id2"), pick("name1", "name2").alias("name1"), pick("name2", "name1").alias("name2"), "score")
    same = one.join(two, (F.col("name_a") == F.col("name_b")) & (F.col("id_a") < F.col("id_b")) & (text.trim_controls(F.col("name_a")) != ""))
    same = same.select(F.col("id_a").alias("id1"), F.col("id_b").alias("id2"), F.col("name_a").alias("name1"), F.col("name_b").alias("name2"), F.lit(1.0).alias("score"))
    return different.unionByName(same.where(F.col("score") > threshold))


def _name_checkpoints(spark: SparkSession) -> None:
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="kinweave-"))


def _verdict(name1: str, name2: str, threshold: float, rules: tuple[Rule, ...], forms: Sequence[LegalForm] | None) -> bool:
    score = match_company_names(name1, name2, rules, forms)
    return score is not None and score > threshold


def duplicate_links(
    df: DataFrame, name_col: str = "name", id_col: str | None = None, threshold: float = DUPLICATE_SCORE, rules: Sequence[Rule] = (), forms: dict[str, Sequence[LegalForm]] | None = None, group: int = TILE_GROUP,
) -> DataFrame:
    """(id, component_id, n_links), a row for each row: the links are the pairs of find_duplicates() in its blocked mode, which are not made.

    component_id is the smallest id that links reach. Rows without a name, or with a blank one, link with nothing.
    """
    spark = df.sparkSession
    _name_checkpoints(spark)
    ship_package(spark)
    rows = with_ids(df, name_col, id_col)
    names = rows.where(F.col("name").isNotNull() & (text.trim_controls(F.col("name")) != "")).groupBy("name").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"))
    names = names.withColumn("node", F.monotonically_increasing_id()).checkpoint()
    blocked = blocked_names(names)
    cuts = blocked.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / group).cast("int").alias("groups"))
    mine, every = F.pmod(F.xxhash64("node"), F.col("groups")).cast("int"), F.sequence(F.lit(0), F.col("groups") - 1)
    dealt = blocked.join(cuts, "key").withColumn("mine", mine).withColumn("other", F.explode(every))
    dealt = dealt.select("node", F.coalesce("id", F.lit(0)).alias("id"), "name", "words", "weight", "mine", "key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))
    # Tiles are small and dear: left to their size, all of them would come to one worker.
    parts = 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = tuple((forms or {}).get(DEFAULT_COUNTRY, ())) or None
    rules = tuple(rules)
    verdict = functools.partial(_verdict, threshold=threshold, rules=rules, forms=own)
    relabel, what = not rules and not own, (threshold, rules, own)
    found = dealt.repartition(parts, "key", "lo", "hi").groupBy("key", "lo", "hi").applyInArrow(lambda tile: tile_links(tile, verdict, relabel, what), "node long, other long, n long").checkpoint()
    clusters = duplicate_clusters(found.where("other is not null").selectExpr("node as id1", "other as id2")).withColumnRenamed("id", "node")
    counts = found.where("n > 0").groupBy("node").agg(F.sum("n").alias("n"))
    classed = names.join(clusters, "node", "left").withColumn("class", F.coalesce("cluster", "node"))
    least = classed.groupBy("class").agg(F.min("id").alias("least"))
    same = F.col("weight") - 1 if threshold < 1 else F.lit(0)
    classed = classed.join(least, "class").join(counts, "node", "left").select(F.col("name").alias("of"), "least", (F.coalesce("n", F.lit(0)) + same).alias("n"))
    joined = rows.join(classed, F.col("name") == F.col("of"), "left")
    return joined.select("id", F.coalesce("least", "id").alias("component_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))


def duplicate_clusters(matches: DataFrame) -> DataFrame:
    """(id, cluster) of the matched ids: connected pairs share the smallest id. An extension.

    Each round a node takes the smallest label around it and then that one's label, which halves long chains;
    it ends when no label moves. Labels are checkpointed in spark.checkpoint.dir, which a cluster must name.
    """
    _name_checkpoints(matches.sparkSession)
    edges = matches.selectExpr("id1 as id", "id2 as other").unionByName(matches.selectExpr("id2 as id", "id1 as other")).distinct().checkpoint()
    labels = edges.groupBy("id").agg(F.least("id", F.min("other")).alias("cluster")).checkpoint()
    while True:
        near = edges.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("cluster").alias("near"))
        hooked = labels.join(near, "id").select("id", F.col("cluster").alias("old"), F.least("cluster", "near").alias("new"))
        onward = labels.select(F.col("id").alias("new"), F.col("cluster").alias("onward"))
        step = hooked.join(onward, "new").select("id", F.least("new", "onward").alias("cluster"), "old").checkpoint()
        labels = step.select("id", "cluster")
        if step.where("cluster < old").isEmpty():
            return labels


def score_column(name1: Column, name2: Column) -> Column:
    """match_company_names() without legal forms, for use in select()."""
    return company_score(name1, name2)
