"""Document fingerprints by a threshold-scaled sketch, in DataFrame functions only.

A document's sketch holds every hash of its five-word shingles that lies below a fixed fraction of the hash range. The
same shingle is kept or left out in every document alike, so sketches of documents, parts and unions can be compared
whatever their lengths: the sketch of a union is the union of the sketches, and the share of a small document's sketch
found in a large one's estimates its containment without bias from the large one's size.

A document with words whose hashes all lie above the threshold keeps its smallest hash instead; after a merge such a
hash goes as soon as one below the threshold is there, which is again what the union itself would have kept. Such a hash
alone says nothing about a longer document, so comparisons that miss it give null; the query compares documents of fewer
than EXACT kept hashes by all their shingles instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.shared import documents, parts_for

SHINGLE_WORDS = 5
#: One hash in so many is kept.
SCALE = 8
#: Sketches of fewer hashes (about 128 shingles) are too small to estimate from: the texts are compared exactly.
EXACT = 16
#: Documents that one task orders by id, as a mean.
ROWS_PER_RANGE = 2_000
#: Ranges at most, since their bounds lie in the plan and their first rows' keys are broadcast; beyond, ranges grow and their sorts spill.
MAX_RANGES = 65_536
#: Bounds that a row's key is compared with at once: the group first, then the bound in it.
FAN = 256


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once: transform() over a one-element array gives it a name."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sketch(text: Column, words: int = SHINGLE_WORDS, scale: int = SCALE) -> Column:
    """Sorted array<bigint> of the kept hashes; empty for texts without words (null ones included).

    Case doesn't count. Words are hashed first and shingles hash their words' hashes, so no shingle is ever built as a
    string. A text with fewer words than a shingle is one shingle.
    """
    bare = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    hashes = F.transform(F.split(bare, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w))

    def shingles(a: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(a) - words, F.lit(0)))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(a, i + k) for k in range(words)]))

    def kept(s: Column) -> Column:
        return F.when(F.exists(s, below), F.array_sort(F.array_distinct(F.filter(s, below)))).otherwise(F.array(_unsigned(F.array_min(F.transform(s, _unsigned)))))

    def below(h: Column) -> Column:
        return _below(h, scale)

    return F.when(bare == "", F.array().cast("array<bigint>")).otherwise(named(hashes, lambda a: named(shingles(a), kept)))


def all_shingles(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """Sorted array<bigint> of all distinct shingle hashes: a sketch that keeps every hash."""
    return sketch(text, words, 1)


def _below(h: Column, scale: int) -> Column:
    """As an unsigned number the hash lies below 2**64 / scale: its upper half decides."""
    return F.shiftrightunsigned(h, 32) < (1 << 32) // scale


def _unsigned(h: Column) -> Column:
    """Orders as the unsigned number does; its own inverse."""
    return h.bitwiseXOR(F.lit(-(1 << 63)))


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of the two documents' shingles taken together."""
    both = F.array_union(a, b)
    low = F.filter(both, lambda h: _below(h, scale))
    least = F.array_min(F.transform(both, _unsigned))
    return F.when(F.size(low) > 0, F.array_sort(low)).when(F.size(both) > 0, F.array(_unsigned(least))).otherwise(both)


def _unknown(a: Column, scale: int = SCALE) -> Column:
    """The sketch is a single hash above the threshold."""
    return (F.size(a) == 1) & ~_below(F.get(a, 0), scale)


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance of two documents, 0 to 1: shared over all kept hashes; two documents without words are alike.

    Null where a sketch that is one hash above the threshold is not in the other, which has words too.
    """
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    unknown = (shared == 0) & (F.size(a) > 0) & (F.size(b) > 0) & (_unknown(a) | _unknown(b))
    return F.when(union == 0, F.lit(1.0)).when(~unknown, shared / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has; 1 where ``a`` has none, null where ``likeness`` is for ``a``'s sake."""
    shared = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) == 0, F.lit(1.0)).when(~((shared == 0) & (F.size(b) > 0) & _unknown(a)), shared / F.size(a))


def exact(a: Column, b: Column) -> Column:
    """struct<likeness, containment> of two texts over all their shingles: their resemblance, and the share of ``a``'s that ``b`` has (1 where ``a`` has none)."""

    def of(x: Column) -> Column:
        n, union = F.size(x["a"]), F.size(x["a"]) + F.size(x["b"]) - x["shared"]
        alike = F.when(union == 0, F.lit(1.0)).otherwise(x["shared"] / union)
        return F.struct(alike.alias("likeness"), F.when(n == 0, F.lit(1.0)).otherwise(x["shared"] / n).alias("containment"))

    both = lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), F.size(F.array_intersect(x["a"], x["b"])).alias("shared"))
    return named(F.struct(all_shingles(a).alias("a"), all_shingles(b).alias("b")), lambda x: named(both(x), of))


def as_string(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds sketch (array<bigint>); every row for itself, all other columns as they are (none may be called sketch)."""
    if "sketch" in df.columns:
        raise ValueError("a column is called sketch already")
    return df.withColumn("sketch", sketch(F.col(text)))


def _place(key: Column, bounds: list[int], ties: Column) -> Column:
    """The number of the range that ``key`` falls in: how many of the ascending ``bounds`` lie below it.

    A key that is a bound, or several (one that many rows share), spreads over the ranges around it by ``ties`` in [0, 1).
    """
    if not bounds:
        return F.lit(0)
    all_bounds = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")  # folded to one literal
    firsts = F.split(F.lit(",".join(map(str, bounds[::FAN]))), ",").cast("array<bigint>")

    def below(test: Callable[[Column], Column]) -> Column:
        group = F.greatest(F.size(F.filter(firsts, test)) - 1, F.lit(0))
        return group * FAN + F.size(F.filter(F.slice(all_bounds, group * FAN + 1, F.lit(FAN)), test))

    low, high = below(lambda b: b < key), below(lambda b: b <= key)
    return low + F.floor((high - low + 1) * ties).cast("int")


def with_next(df: DataFrame, key: str, columns: list[str], derive: dict[str, Column], tie: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds ``derive`` and next_<c> for each of ``columns`` (derived ones too): its value in the row of the next smaller ``key``; after the last row, in the first.

    Rows are dealt to ranges of the whole-number key between its quantiles and ordered within each. The first row of the
    range below is dealt to a range once more, behind its last row, so no task sees the whole order and rows are moved
    once. Null keys come last, like the smallest long; rows of equal keys follow each other by a hash of column ``tie``
    (those of equal ties in any order), and many of them are split between ranges; a single row is its own next; no rows
    give none. Columns that begin with two underscores are for its own use.
    """
    ordered = df.withColumns({"__key": F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))), "__tie": F.shiftrightunsigned(F.xxhash64(tie), 11) / F.lit(float(1 << 53))})
    n = df.count()
    ranges = min(parts_for(n, rows_per_range), MAX_RANGES)
    bounds = []
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        bounds = sorted(ordered.agg(F.percentile_approx("__key", shares, max(10_000, 20 * ranges))).first()[0])
    ranged = ordered.withColumn("__range", _place(F.col("__key"), bounds, F.col("__tie")))
    heads = ranged.groupBy("__range").agg(F.max(F.struct("__key", "__tie")).alias("__head"))
    # MAX_RANGES rows of four numbers at most: a range's first row goes behind the range above; the highest range's, behind the lowest.
    above = F.coalesce(F.lead("__range").over(W.orderBy("__range")), F.min("__range").over(W.orderBy("__range")))
    heads = heads.select("__head", F.col("__range").alias("__own"), above.alias("__to"))
    again = ranged.join(F.broadcast(heads), (F.col("__range") == F.col("__own")) & (F.struct("__key", "__tie") == F.col("__head")))
    again = again.select(*ordered.columns, F.col("__to").alias("__range"), F.lit(1).alias("__again"))
    dealt = ranged.withColumn("__again", F.lit(0)).unionByName(again).repartition("__range").withColumns(derive)
    order = W.partitionBy("__range").orderBy("__again", F.col("__key").desc(), F.col("__tie").desc())
    found = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where("__again = 0")
    return found.drop("__again", "__range", "__key", "__tie")


def op7_fracsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness; rows of equal ids follow each other by their texts' hash."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = with_next(docs, "doc_id", ["text", "sketch"], {"sketch": sketch(F.col("text"))}, "text")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    found = both.withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited")))
    small = lambda *sketches: F.least(*[F.size(c) for c in sketches], F.lit(EXACT)) < EXACT
    found = found.withColumns({
        "with_edited": F.when(small("sketch", "edited_sketch"), exact(F.col("text"), F.col("edited"))),
        "with_next": F.when(small("sketch", "next_sketch"), exact(F.col("text"), F.col("next_text"))),
    })
    estimated = lambda c, estimate: F.when(F.col(c).isNull(), estimate)
    return found.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("sketch")).alias("fingerprint"),
        as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        F.coalesce("with_edited.likeness", estimated("with_edited", likeness(F.col("sketch"), F.col("edited_sketch")))).alias("near_edited"),
        F.coalesce("with_next.likeness", estimated("with_next", likeness(F.col("sketch"), F.col("next_sketch")))).alias("near_next"),
        F.coalesce("with_edited.containment", estimated("with_edited", containment(F.col("sketch"), F.col("edited_sketch")))).alias("contained_in_edited"),
    )
