"""Secret scans: fixed shapes, and sliding-window entropy of candidate strings per character class.

Base kinds: ``assign`` (a key word, a sign and a value of 6+ characters), ``access`` (AKIA and 16+
capitals or digits) and ``hex`` (24+ lower-case hexadecimal characters). The added kind ``entropy`` takes
candidate strings, runs of 20+ characters of the base-64 alphabet, classes them by the characters they
use (hexadecimal, one-case alphanumeric, base-64), slides a window of WINDOW characters over them and
keeps the running counts of its characters: a step adds one character and drops one, and the sum of
count * log2(count) moves by the two changed terms. A candidate whose highest window entropy reaches its
class's threshold is a secret, unless an allow-list pattern clears it (identifiers made of words, paths,
dotted names, runs of digits, versions, hashes of all-zero bytes and sample keys).

Everything is built of SQL functions. A text without a candidate costs three pattern searches.

Defined cases: a null or empty text has no spans and the hash of the empty string; spans are code points,
end exclusive; repeated rows are scanned each; an empty table gives an empty result; other columns of the
input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.shared import table

# The base shapes.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Class pattern and entropy in bits from which a window of WINDOW characters is a secret.
CLASSES = (("^[0-9a-fA-F]+$", 3.0), ("^(?:[0-9a-z]+|[0-9A-Z]+)$", 3.5), ("^.*$", 3.7))
ALLOWED = (
    r"^[A-Za-z]+$",  # words run together
    r"^[0-9]+$",  # numbers
    r"^[a-z]+(?:[/_-][a-z]+)*[0-9]{0,4}$",  # slugs and paths
    r"^[A-Z]+(?:[_-][A-Z]+)*[0-9]{0,4}$",  # constants
    r"^(?:[A-Z]?[a-z]+)+[0-9]{0,4}$",  # camel case
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",  # UUIDs
    r"(?i)example|sample|dummy|placeholder",
    r"^[=_+/-]+$",  # rules
)


def _at(matches: Column, gaps: Column) -> Column:
    """Array of (start, end, text) of matches that stand between gaps, in code points."""
    step = F.filter(
        F.zip_with(matches, gaps, lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m).alias("size"), m.alias("text"))), lambda m: m["text"].isNotNull()
    )
    spans = F.aggregate(
        step,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out")),
        lambda done, m: F.struct(
            (done["at"] + m["gap"] + m["size"]).alias("at"),
            F.concat(done["out"], F.array(F.struct((done["at"] + m["gap"]).alias("start"), (done["at"] + m["gap"] + m["size"]).alias("end"), m["text"].alias("text")))).alias("out"),
        ),
    )
    return spans["out"]


_NONE = "array<struct<start:int,end:int,text:string>>"


def find_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, text)."""
    found = _at(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_NONE))


def max_window_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """Highest Shannon entropy in bits of a window of characters, by incremental counts.

    The state holds a count for each ASCII code and the sum of count * log2(count) over the window.
    """
    chars = F.transform(F.split(candidate, ""), lambda c: F.ascii(c))
    weight = lambda n: F.when(n > 0, n * F.log2(n)).otherwise(F.lit(0.0))

    def put(counts: Column, code: Column, change: int) -> Column:
        return F.map_concat(F.map_filter(counts, lambda k, _: k != code), F.create_map(code, F.coalesce(counts[code], F.lit(0)) + F.lit(change)))

    def step(state: Column, item: Column) -> Column:
        new, old = item["new"], item["old"]
        count_new = F.coalesce(state["counts"][new], F.lit(0))
        added = put(state["counts"], new, 1)
        total = state["total"] - weight(count_new) + weight(count_new + 1)
        count_old = F.coalesce(added[old], F.lit(0))
        full = old.isNotNull()
        counts = F.when(full, put(added, F.coalesce(old, F.lit(-1)), -1)).otherwise(added)
        total = F.when(full, total - weight(count_old) + weight(count_old - 1)).otherwise(total)
        size = F.when(full, state["size"]).otherwise(state["size"] + 1)
        entropy = F.when(size >= window, F.log2(size) - total / size).otherwise(F.lit(0.0))
        return F.struct(counts.alias("counts"), total.alias("total"), size.alias("size"), F.greatest(state["most"], entropy).alias("most"))

    # The one-element array binds the characters to a variable; named in the lambda itself they would be split again at each step.
    items = F.get(F.transform(F.array(chars), lambda cs: F.transform(cs, lambda c, i: F.struct(c.alias("new"), F.when(i >= window, F.get(cs, i - window)).alias("old")))), 0)
    start = F.struct(F.create_map().cast("map<int,int>").alias("counts"), F.lit(0.0).alias("total"), F.lit(0).alias("size"), F.lit(0.0).alias("most"))
    return F.aggregate(items, start, step)["most"]


def is_random(candidate: Column) -> Column:
    """Whether a candidate string is a secret: no allow-list pattern, and entropy over its class's threshold."""
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | candidate.rlike(pattern)
    limit = F.lit(CLASSES[-1][1])
    for pattern, bits in reversed(CLASSES[:-1]):
        limit = F.when(candidate.rlike(pattern), F.lit(bits)).otherwise(limit)
    return F.when(allowed, F.lit(False)).otherwise(max_window_entropy(candidate) >= limit)


def _named(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(documents: DataFrame) -> DataFrame:
    """doc_id and the spans of each kind: arrays of (start, rank, end, kind)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    value_of = lambda s: F.regexp_extract(s["text"], ASSIGN, 2)
    raw = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.filter(find_spans(text, ASSIGN), lambda s: F.length(value_of(s)) >= 6).alias("assign"),
        F.filter(find_spans(text, ACCESS), lambda s: F.length(s["text"]) >= 20).alias("access"),
        find_spans(text, HEX).alias("hex"),
        F.filter(find_spans(text, CANDIDATE), lambda s: is_random(s["text"])).alias("entropy"),
    )
    return raw.select("doc_id", *[_named(F.col(kind), kind).alias(kind) for kind in KINDS])


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat(base, F.col("entropy"))).alias("spans"),
    )
