"""N-gram Jaccard join with set relations: block-skipped index lists, answers derived from similar sets.

Sets are distinct word n-grams of the ASCII-lower-cased text, as 64-bit hashes; a shorter text is one
shingle. Two documents link when 100 * intersection >= percent * union; the result is the connected class.

1. Equal sets become one set (128-bit sum hashes), however many documents have it.
2. Shingles are ordered: those that stand out of a sketch of all shingles last, the others by their rarest
   word, which bounds how rare they are, then by hash. A set is indexed under its prefix, long enough that
   two sets that link share NEED shingles of both prefixes, and at each of these neither has too few
   shingles left (positional bound). Pairs with fewer shared ones are never looked at.
3. Each index list names one of its sets as pivot: the one whose prefix meets most other sets, which is the
   nearest to what the list's sets have in common. A set is held against the pivot that shares most of its
   prefix; if they link or nearly do, that pivot is its home and the difference (added, dropped) is kept.
   Sets without a home have a second round among themselves.
4. Two sets x, y of one home p need no list: |x ^ y| = |Ax| + |Ay| - 2 |Ax & Ay| of their differences Ax, Ay
   to p. If both link with p they are in one class; else they must share a part of their differences, so the
   differences get prefixes of their own, and only sets that share such a shingle meet. In a group of near
   copies with edits of their own hardly any do, so the work follows the group's size, not its square.
5. The index lists are cut into blocks by size class, position class and home. A pair of blocks is skipped
   as a whole when sizes or positions rule it out, or when all is one class or one home; only blocks that
   survive are paired entry by entry. A pair (x, y) with x at home p is answered through p: y is held
   against p once for all x of the home, and each answer follows from the two differences.

Defined cases: null texts and texts without words have the empty set, link with nothing and are classes of
their own; rows with the same doc_id count as documents of their own that share a name; an empty table
gives an empty result; other columns are ignored. Long texts are shingled whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.shared import WORD_PATTERN, arrow_map, connected, forget, mix, row_keys, ship_package, shingle_hashes, table, text_bytes, word_hashes, written

#: Counters of the sketch of words and of the one of shingles; fixed, whatever the input.
WORD_SKETCH = 1 << 19
SHINGLE_SKETCH = 1 << 22
#: A shingle's counter is of note in a task when it is over so many times the mean one, and so high at least.
STANDS_OUT = 4
#: Shared prefix shingles of a candidate pair, less only for sets that have fewer.
NEED = 3
ROUNDS = 2
#: Sets that one row group of a comparison holds against its pivot at most, about.
CHUNK = 512
#: Bits of the filter that keeps the texts no comparison asks for out of the shuffles; fixed, whatever the input.
FILTER_BITS = 1 << 25


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    words = word_hashes(text.lower())
    if not len(words):
        return words
    return np.unique(shingle_hashes(words, min(n, len(words))))


def prefix_length(size: int, percent: int) -> int:
    """Two sets that link share min(NEED, least) shingles of both prefixes; least: what a partner must share at least."""
    least = -(-percent * size // 100)
    return size - least + min(NEED, least)


def _slots(hashes: np.ndarray, size: int) -> np.ndarray:
    return (hashes & np.uint64(size - 1)).astype(np.int64)


def shingle_order(documents: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words of all documents fall on each word counter, and a level for each shingle counter: 0, or above by the logarithm of what stands out."""
    ship_package(documents.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_seen, shingles_seen = np.zeros(WORD_SKETCH, dtype=np.int64), np.zeros(SHINGLE_SKETCH, dtype=np.int32)
        for batch in batches:
            for text in text_bytes(batch.column("text")):
                words = word_hashes(text.lower())
                np.add.at(words_seen, _slots(words, WORD_SKETCH), 1)
                np.add.at(shingles_seen, _slots(shingle_hashes(words, n), SHINGLE_SKETCH), 1)
        least = max(STANDS_OUT, STANDS_OUT * shingles_seen.sum(dtype=np.int64) / SHINGLE_SKETCH)
        for kind, seen, from_ in ((0, words_seen, 1), (1, shingles_seen, least)):
            at = np.flatnonzero(seen >= from_)
            for k in range(0, len(at), 100_000):
                cut = at[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cut), kind), pa.int32()), pa.array(cut, pa.int32()), pa.array(seen[cut], pa.int64())], names=["kind", "counter", "n"])

    rows = documents.selectExpr("cast(text as string) text").mapInArrow(count, "kind int, counter int, n long").groupBy("kind", "counter").agg(F.sum("n").alias("n")).toArrow()
    kind, counter, seen = (rows[c].to_numpy() for c in ("kind", "counter", "n"))
    words, levels = np.zeros(WORD_SKETCH, dtype=np.int64), np.zeros(SHINGLE_SKETCH, dtype=np.uint8)
    words[counter[kind == 0]] = seen[kind == 0]
    levels[counter[kind == 1]] = np.minimum(255, np.round(4 * np.log2(seen[kind == 1])))
    return words, levels


def ranked_set(text: bytes, n: int, words_seen: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes, and their places in the order rare to common."""
    words = word_hashes(text.lower())
    if not len(words):
        return words, np.zeros(0, dtype=np.int64)
    n = min(n, len(words))
    tokens, at = np.unique(shingle_hashes(words, n), return_index=True)
    rarity = words_seen[_slots(words, WORD_SKETCH)]
    rarest = rarity[: len(words) - n + 1]
    for k in range(1, n):
        rarest = np.minimum(rarest, rarity[k : k + len(rarest)])
    return tokens, np.lexsort((rarest[at], levels[_slots(tokens, SHINGLE_SKETCH)]))


def _prefixes(documents: DataFrame, n: int, percent: int, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(order)

    def kernel(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words_seen, levels = shared.value
        sizes, first, second, prefixes = [], [], [], []
        for text in text_bytes(batch.column("text")):
            tokens, rank = ranked_set(text, n, words_seen, levels)
            sizes.append(len(tokens))
            first.append(mix(tokens).sum(dtype=np.uint64).astype(np.int64))
            second.append(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64))
            prefixes.append(tokens[rank[: prefix_length(len(tokens), percent)]].view(np.int64))
        made = [pa.array(sizes, pa.int32()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "_row_1", "_row_2")), *made], names=["doc_id", "_row_1", "_row_2", "n", "h1", "h2", "prefix"])

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *row_keys(documents))
    return arrow_map(rows, kernel, "doc_id long, _row_1 long, _row_2 long, n int, h1 long, h2 long, prefix array<long>")


def _linked(common: Column, a: Column, b: Column, percent: int) -> Column:
    return common.cast("long") * (100 + percent) >= (a + b).cast("long") * percent


def _bound(a: Column, b: Column, percent: int) -> Column:
    """Sets of a and b shingles link when they differ in so many at most, times 100 + percent."""
    return (a + b).cast("long") * (100 - percent)


def _may_link(a: str, b: str, percent: int) -> Column:
    """Length and positional bounds of two entries with columns n and pos under the prefixes a and b; they hold at the first NEED shared shingles of sets that link."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    left = F.least(na - F.col(f"{a}.pos"), nb - F.col(f"{b}.pos")) + (NEED - 1)
    return _linked(left, na, nb, percent) & (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent)


def _needed(n: Column, percent: int) -> Column:
    """Shared prefix shingles that a set of n needs with a partner, at least."""
    return F.least(F.lit(NEED), F.ceil(n * percent / 100))


def _among(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose ``key``, a hash, is one of the table ``wanted``, and few others, which share a bit of the filter with one: a join must follow."""
    place = f"{key} & {FILTER_BITS - 1}L"
    filled = wanted.groupBy(F.expr(f"shiftright({place}, 6)").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({key} & 63L as int))")).alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    bits[filled["word"].to_numpy()] = filled["bits"].to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def may_be(hashes: pa.Array) -> pa.Array:
        at = _slots(hashes.to_numpy(zero_copy_only=False).view(np.uint64), FILTER_BITS)
        return pa.array((shared.value[at >> 6] >> (at & 63)) & 1 == 1)

    ship_package(rows.sparkSession)
    return rows.where(may_be(key))


def _differences(documents: DataFrame, places: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """(x, p, nx, np, added, dropped) of the pairs (x, p, most) that differ in ``most`` shingles or fewer: x has the added ones over p and lacks the dropped ones.

    ``places`` has the row keys of each set's text. Texts are read from the documents, those of the pairs only: to shuffle all
    of them takes more than all the rest. The texts of each p's sets come to it in chunks, so a p with many of them is spread
    over tasks; a task holds one p at a time.
    """
    crowd = pairs.groupBy("p").agg(F.count(F.lit(1)).alias("crowd"))
    dealt = pairs.join(crowd, "p").select("x", "p", "most", F.pmod(F.xxhash64("x"), F.ceil(F.col("crowd") / CHUNK)).cast("long").alias("chunk"))
    wanted = dealt.select(F.col("x").alias("rep"), "p", "chunk", "x", "most").unionByName(
        dealt.select("p", "chunk").distinct().select(F.col("p").alias("rep"), "p", "chunk", F.lit(None).cast("long").alias("x"), F.lit(None).cast("long").alias("most"))
    )
    wanted = written(wanted.join(places.select("rep", "_row_1", "_row_2"), "rep").drop("rep"), "jaccard-wanted")
    texts = documents.select(F.col("text").cast("string").alias("text"), *row_keys(documents))
    rows = _among(texts, "_row_1", wanted).join(wanted, ["_row_1", "_row_2"]).select("p", "chunk", "x", "most", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(found: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["x", "p", "nx", "np", "added", "dropped"])

        at, pivot, found, held = None, None, [], 0
        for batch in batches:
            ids = [batch.column(c).to_pylist() for c in ("p", "chunk", "x", "most")]
            for p, chunk, x, most, text in zip(*ids, text_bytes(batch.column("text"))):
                tokens = shingle_set(text, n)
                if x is None:
                    at, pivot = (p, chunk), tokens
                elif at == (p, chunk):
                    common = np.intersect1d(tokens, pivot, assume_unique=True)
                    if len(tokens) + len(pivot) - 2 * len(common) <= most:
                        added, dropped = np.setdiff1d(tokens, common, assume_unique=True), np.setdiff1d(pivot, common, assume_unique=True)
                        found.append((x, p, len(tokens), len(pivot), added.view(np.int64), dropped.view(np.int64)))
                        held += len(added) + len(dropped) + 8
                if held > 1 << 18:
                    yield give(found)
                    found, held = [], 0
        if found:
            yield give(found)

    dealt_out = rows.repartition("p", "chunk").sortWithinPartitions("p", "chunk", F.col("x").asc_nulls_first())
    found = dealt_out.mapInArrow(run, "x long, p long, nx int, np int, added array<long>, dropped array<long>")
    # A row of the documents that is there twice gives its answers twice.
    found = written(found.distinct(), "jaccard-differences")
    forget(wanted)
    return found


def _homes(entries: DataFrame, documents: DataFrame, places: DataFrame, n: int, percent: int) -> DataFrame:
    """(x, p, nx, np, added, dropped, linked): each set's home, where it has one; a pivot without another home is its own."""
    homes, open_entries = None, entries
    for turn in range(ROUNDS):
        nearness = F.floor(-1000 * F.col("shared") / F.col("length"))
        pivot = F.struct(nearness.alias("nearness"), F.xxhash64(F.lit(turn), "rep").alias("draw"), "rep", "n", "pos")
        lists = written(open_entries.groupBy("token").agg(F.min(pivot).alias("p"), F.count(F.lit(1)).alias("size")).where("size > 1").select("token", "p"), "jaccard-pivots")
        tries = open_entries.alias("e").join(lists, "token").where((F.col("e.rep") != F.col("p.rep")) & _may_link("e", "p", percent))
        tries = tries.select(F.col("e.rep").alias("x"), F.col("e.n").alias("nx"), F.col("p.rep").alias("p"), F.col("p.n").alias("np"))
        tries = tries.groupBy("x", "nx", "p", "np").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= _needed(F.least("nx", "np"), percent))
        nearest = tries.groupBy("x", "nx").agg(F.max(F.struct("shared", F.xxhash64(F.lit(turn), "p").alias("draw"), "p", "np")).alias("to"))
        most = F.floor(2 * _bound(F.col("nx"), F.col("to.np"), percent) / (100 + percent))
        tries = written(nearest.select("x", "to.p", most.cast("long").alias("most")), "jaccard-tries")
        common = F.col("nx") - F.size("added")
        tried = _differences(documents, places, tries, n).withColumn("linked", _linked(common, F.col("nx"), F.col("np"), percent))
        forget(lists, tries)
        none = F.array().cast("array<long>")
        pivots = tried.select("p", "np").distinct().join(tried.select(F.col("x").alias("p")), "p", "left_anti")
        pivots = pivots.select(F.col("p").alias("x"), "p", F.col("np").alias("nx"), "np", none.alias("added"), none.alias("dropped"), F.lit(True).alias("linked"))
        found = tried.unionByName(pivots)
        homes = found if homes is None else homes.unionByName(found)
        if turn + 1 < ROUNDS:
            left = written(open_entries.join(found.select(F.col("x").alias("rep")), "rep", "left_anti"), "jaccard-homeless")
            open_entries = left
    forget(left)
    return homes


def _answers_at_home(homes: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of sets of one home that link and are in different classes, by prefixes of their differences."""
    classed = homes.join(classes.withColumnRenamed("id", "x"), "x", "left").withColumn("class", F.coalesce("component", "x"))
    open_homes = classed.groupBy("p").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least < most").select("p")
    members = written(classed.join(open_homes, "p").select("x", "p", "nx", "np", "added", "dropped", "linked", "class"), "jaccard-members")
    size = F.size("added") + F.size("dropped")
    # What the difference must share with the one of any set of another class, at least.
    if_linked = F.floor((size * (100 + percent) + (F.size("dropped") - F.size("added")) * (100 - percent)) / (2 * (100 + percent))) + 1
    if_not = F.greatest(F.lit(1), F.ceil(size - F.col("nx") * (100 - percent) / percent))
    length = size - F.when(F.col("linked"), if_linked).otherwise(if_not) + 1
    ordered = F.concat(F.array_sort("added"), F.array_sort("dropped"))
    index = members.select("x", "p", "nx", "class", size.alias("size"), F.posexplode(F.slice(ordered, F.lit(1), F.greatest(length, F.lit(0)).cast("int"))).alias("pos", "token"))
    lists = index.groupBy("p", "token").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least < most").select("p", "token")
    index = written(index.join(lists, ["p", "token"]), "jaccard-difference-index")
    c = F.col
    left = F.least(c("a.size") - c("a.pos"), c("b.size") - c("b.pos"))
    fits = 2 * left * (100 + percent) >= (c("a.size") + c("b.size")) * (100 + percent) - _bound(c("a.nx"), c("b.nx"), percent)
    pairs = index.alias("a").join(index.alias("b"), (c("a.p") == c("b.p")) & (c("a.token") == c("b.token")) & (c("a.x") < c("b.x")) & (c("a.class") != c("b.class")) & fits)
    pairs = pairs.select(c("a.x").alias("x"), c("b.x").alias("y")).distinct()
    mine = members.select("x", c("nx"), c("added").alias("ax"), c("dropped").alias("dx"))
    other = members.select(c("x").alias("y"), c("nx").alias("ny"), c("added").alias("ay"), c("dropped").alias("dy"))
    held = pairs.join(mine, "x").join(other, "y")
    found = written(held.where(_through(percent)).select(c("x").alias("a"), c("y").alias("b")), "jaccard-home-answers")
    forget(members, index)
    return found


def _through(percent: int) -> Column:
    """Whether sets of nx and ny shingles link, by their differences (ax, dx) and (ay, dy) to one and the same set."""
    size = F.size("ax") + F.size("dx") + F.size("ay") + F.size("dy")
    apart = size - 2 * (F.size(F.array_intersect("ax", "ay")) + F.size(F.array_intersect("dx", "dy")))
    return apart.cast("long") * (100 + percent) <= _bound(F.col("nx"), F.col("ny"), percent)


def _cross_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """(x, nx, hx, y, ny, hy): pairs of different classes and homes that a list and the bounds allow, by way of block pairs."""
    c = F.col
    one_home = F.min(F.coalesce("home", "rep")) == F.max(F.coalesce("home", "rep"))
    open_lists = entries.groupBy("token").agg(F.min("class").alias("least"), F.max("class").alias("most"), one_home.alias("one_home")).where("least < most and not one_home").select("token")
    open_lists = written(open_lists, "jaccard-open-lists")
    size_class = F.floor(F.log(c("n")) / F.log(F.lit(100 / percent)))
    block = F.struct(size_class.alias("size_class"), F.floor(F.log2(c("pos") + 1)).alias("pos_class"), "home")
    entries = written(entries.join(open_lists, "token").withColumn("block", block), "jaccard-open")
    blocks = entries.groupBy("token", "block").agg(
        F.min("n").alias("n"), F.max("n").alias("most"), F.max(c("n") - c("pos")).alias("left"), F.min("class").alias("c0"), F.max("class").alias("c1")
    )
    fits = _linked(F.least("a.left", "b.left") + (NEED - 1), c("a.n"), c("b.n"), percent) & (c("a.most") * 100 >= c("b.n") * percent) & (c("b.most") * 100 >= c("a.n") * percent)
    one_class = (c("a.c0") == c("a.c1")) & (c("b.c0") == c("b.c1")) & (c("a.c0") == c("b.c0"))
    same_home = F.coalesce(c("a.block.home") == c("b.block.home"), F.lit(False))
    paired = blocks.alias("a").join(blocks.alias("b"), (c("a.token") == c("b.token")) & (c("a.block") <= c("b.block")) & fits & ~one_class & ~same_home)
    paired = paired.select(c("a.token").alias("token"), c("a.block").alias("block_a"), c("b.block").alias("block_b"))
    left = paired.alias("q").join(entries.alias("a"), (c("q.token") == c("a.token")) & (c("q.block_a") == c("a.block"))).select("a.*", "q.block_b")
    ordered = (c("a.block") < c("b.block")) | (c("a.rep") < c("b.rep"))
    # A set and its own pivot have met before.
    met = F.coalesce(c("a.home") == c("b.rep"), F.lit(False)) | F.coalesce(c("b.home") == c("a.rep"), F.lit(False))
    both = left.alias("a").join(
        entries.alias("b"),
        (c("a.token") == c("b.token")) & (c("a.block_b") == c("b.block")) & (c("a.class") != c("b.class")) & ordered & ~met & _may_link("a", "b", percent),
    )
    one, two = (F.struct(c(f"{k}.rep").alias("rep"), c(f"{k}.n").alias("n"), c(f"{k}.home").alias("home")) for k in "ab")
    pairs = both.select(F.least(one, two).alias("x"), F.greatest(one, two).alias("y"))
    shared = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("shared")).where(c("shared") >= _needed(F.least("x.n", "y.n"), percent))
    out = written(shared.select(c("x.rep").alias("x"), c("x.n").alias("nx"), c("x.home").alias("hx"), c("y.rep").alias("y"), c("y.n").alias("ny"), c("y.home").alias("hy")), "jaccard-cross")
    forget(open_lists, entries)
    return out


def _answers_between(pairs: DataFrame, homes: DataFrame, documents: DataFrame, places: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): the pairs of _cross_pairs() that link. One side is answered through its home, which the other is held against once for all sets of that home."""
    c = F.col
    mine, swap = c("hx").isNotNull(), c("hx").isNull() & c("hy").isNotNull()
    turned = pairs.select(
        F.when(swap, c("y")).otherwise(c("x")).alias("x"), F.when(swap, c("ny")).otherwise(c("nx")).alias("nx"), F.when(swap, c("x")).otherwise(c("y")).alias("y"),
        F.when(swap, c("nx")).otherwise(c("ny")).alias("ny"), F.when(mine, c("hx")).when(swap, c("hy")).otherwise(c("x")).alias("p"),
    )
    kept = homes.select("x", "p", F.col("added").alias("ax"), F.col("dropped").alias("dx"))
    none = F.array().cast("array<long>")
    turned = turned.join(kept, ["x", "p"], "left").select("x", "nx", "y", "ny", "p", F.coalesce("ax", none).alias("ax"), F.coalesce("dx", none).alias("dx"))
    turned = written(turned, "jaccard-turned")
    most = F.floor((F.size("ax") + F.size("dx")) + _bound(c("nx"), c("ny"), percent) / (100 + percent))
    against = written(turned.groupBy(c("y").alias("x"), "p").agg(F.max(most).cast("long").alias("most")), "jaccard-against")
    differences = _differences(documents, places, against, n)
    held = differences.select(c("x").alias("y"), "p", c("added").alias("ay"), c("dropped").alias("dy"))
    found = written(turned.join(held, ["y", "p"]).where(_through(percent)).select(c("x").alias("a"), c("y").alias("b")), "jaccard-cross-answers")
    forget(turned, against, differences)
    return found


def _classes(documents: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, _row_1, _row_2, n, h1, h2) of all documents, and (h1, h2, size, doc, class) of all sets that are not empty."""
    every = written(_prefixes(documents, n, percent, shingle_order(documents, n)), "jaccard-prefixes")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row_1", "_row_2")
    reps = every.where("n > 0").groupBy("h1", "h2", "n").agg(F.min(place).alias("place"), F.first("prefix").alias("prefix"))
    reps = written(reps.select("h1", "h2", "n", F.col("place.doc_id").alias("doc"), "place._row_1", "place._row_2", "prefix"), "jaccard-reps")
    rows = written(every.select("doc_id", "_row_1", "_row_2", "n", "h1", "h2"), "jaccard-rows")
    forget(every)
    # A set's rep is its smallest doc_id. Where that is null or names several sets, a negative hash tells them apart.
    several = written(reps.where("doc is not null").groupBy("doc").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1"), "jaccard-repeated-ids")
    own = F.col("doc").isNotNull() & F.col("sets").isNull()
    reps = reps.join(several, "doc", "left").withColumn("rep", F.when(own, F.col("doc")).otherwise(-1 - F.shiftrightunsigned(F.xxhash64("h1", "h2"), 1))).drop("sets")

    exploded = reps.select("rep", "n", F.posexplode("prefix").alias("pos", "token"))
    # Aggregates that are joined on a hot token are written first: both sides of the join are plain exchanges then, which Spark can split.
    lists = written(exploded.groupBy("token").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("token"), "jaccard-lists")
    met = written(exploded.join(lists, "token"), "jaccard-met")
    enough = met.groupBy("rep").agg(F.count(F.lit(1)).alias("shared"), F.first("n").alias("n")).where(F.col("shared") >= _needed(F.col("n"), percent)).select("rep", "shared")
    enough = written(enough.join(reps.select("rep", F.size("prefix").alias("length"), "_row_1", "_row_2"), "rep"), "jaccard-enough")
    entries = written(met.join(enough.select("rep", "shared", "length"), "rep"), "jaccard-entries")
    forget(lists, met)

    homes = _homes(entries, documents, enough, n, percent)
    links = homes.where("linked and x <> p").selectExpr("x as a", "p as b")
    classes = connected(documents.sparkSession, links, "jaccard-classes")
    at_home = _answers_at_home(homes, classes, percent)
    state = enough.select("rep").join(homes.select(F.col("x").alias("rep"), F.col("p").alias("home")), "rep", "left")
    state = state.join(classes.withColumnRenamed("id", "rep"), "rep", "left").select("rep", "home", F.coalesce("component", "rep").alias("class"))
    placed = written(entries.select("rep", "n", "pos", "token").join(state, "rep"), "jaccard-placed")
    cross = _cross_pairs(placed, percent)
    between = _answers_between(cross, homes, documents, enough, n, percent)
    forget(entries, placed, cross, enough)
    # The second graph has classes as its nodes.
    of = classes.select(F.col("id"), "component")
    edges = at_home.unionByName(between)
    edges = edges.join(of.withColumnsRenamed({"id": "a", "component": "ca"}), "a", "left").join(of.withColumnsRenamed({"id": "b", "component": "cb"}), "b", "left")
    edges = edges.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).distinct()
    merged = connected(documents.sparkSession, edges, "jaccard-merged").withColumnsRenamed({"id": "class", "component": "merged"})
    named = reps.select("h1", "h2", "n", "doc", "rep").join(of.withColumnRenamed("id", "rep"), "rep", "left").withColumn("class", F.coalesce("component", "rep"))
    named = named.join(merged, "class", "left").select("h1", "h2", F.col("n").alias("size"), "doc", F.coalesce("merged", "class").alias("class"))
    return rows, named


def _with_class(rows: DataFrame, named: DataFrame) -> DataFrame:
    same = (rows["h1"] == named["h1"]) & (rows["h2"] == named["h2"]) & (rows["n"] == named["size"])
    return rows.where("n > 0").join(named, same)


def jaccard_classes(documents: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id for every document."""
    rows, named = _classes(documents, n, percent)
    # Names of classes are their smallest doc_id.
    names = named.groupBy("class").agg(F.min("doc").alias("component_id"))
    named = named.join(names, "class").select("h1", "h2", "size", "component_id")
    joined = _with_class(rows, named).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone)


def one_of_each(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents with all their columns, of each class only one row: the one with the smallest doc_id, null last; rows without words stay, all of them.

    It goes by rows, not by ids: of rows that are equal in every column one stays, and a row is not lost because another one has its doc_id.
    """
    rows, named = _classes(documents, n, percent)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row_1", "_row_2")
    firsts = _with_class(rows, named.drop("doc")).groupBy("class").agg(F.min(place).alias("place"))
    stay = written(firsts.select("place._row_1", "place._row_2"), "jaccard-stay")
    one = documents.select("*", *row_keys(documents)).join(stay, ["_row_1", "_row_2"]).dropDuplicates(["_row_1", "_row_2"])
    wordless = F.coalesce(~F.col("text").cast("string").rlike(WORD_PATTERN), F.lit(True))
    names = [f"`{c}`" for c in documents.columns]
    return one.select(*names).unionByName(documents.where(wordless).select(*names))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


ORACLE = {
    "op10_jaccard": r"""
    WITH RECURSIVE rows AS (
        SELECT row_number() OVER () AS r, doc_id,
               regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    words AS (SELECT r, unnest(w) AS w, unnest(range(len(w))) AS k FROM rows WHERE len(w) >= 3),
    shingles AS (
        SELECT DISTINCT r, s FROM (SELECT r, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS s FROM words WINDOW o AS (PARTITION BY r ORDER BY k)) WHERE s IS NOT NULL
        UNION ALL SELECT r, array_to_string(w, ' ') FROM rows WHERE len(w) BETWEEN 1 AND 2),
    sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
    sized AS (SELECT r, s, n FROM shingles JOIN sizes USING (r)),
    links AS (
        SELECT a.r AS a, b.r AS b FROM sized a JOIN sized b ON a.s = b.s AND a.r < b.r AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
        GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
    edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach(r, place) AS (SELECT r, r FROM rows UNION SELECT reach.r, edges.b FROM reach JOIN edges ON reach.place = edges.a)
    SELECT rows.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other.doc_id) AS component_id
    FROM reach JOIN rows USING (r) JOIN rows other ON other.r = reach.place LEFT JOIN sizes ON sizes.r = rows.r
    GROUP BY rows.r, rows.doc_id
    """,
}
