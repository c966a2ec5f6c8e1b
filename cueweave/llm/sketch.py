"""Document fingerprints: a threshold-scaled sketch (FracMinHash).

Every distinct hash of a ``shingle``-word stretch below ``2**64 / scale`` is kept, whatever
the length of the text.  Sketches of parts merge by union, and since the threshold is the
same for all, |A and B| / |A| estimates containment even between very unequal documents.
A text with no hash below the threshold keeps its smallest one, so distinct short texts
differ; ``merge`` keeps that rule.

Words are lower-cased (A-Z) and divided by blanks; a text of fewer words is one shingle.
A shingle's hash chains the words' 64-bit hashes.  Only DataFrame expressions run.

Defined cases: null counts as an empty text; a text without words has an empty sketch, which
is like another empty one (1) and unlike any other (0); repeated rows are kept; extra columns
are dropped by ``compare_with_next``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueweave.llm.common import SPACES

SCALE = 4
SHINGLE = 5


def words(text: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.filter(F.split(F.translate(text, upper, lower), SPACES), lambda w: w != "")


def with_sketch(df: DataFrame, text: str, name: str, size: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Add ``name``: the sorted distinct hashes below the threshold."""
    hashed = df.withColumn("_words", F.transform(words(F.col(text)), lambda w: F.xxhash64(w)))
    many = F.size("_words") - (size - 1)
    ends = F.when(many > 1, F.sequence(F.lit(0), many - 1)).otherwise(F.array(F.lit(0)))
    whole = F.transform(ends, lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(size)]))
    few = F.array(F.xxhash64("_words"))
    all_ = F.when(F.size("_words") == 0, F.array().cast("array<bigint>")).when(many < 1, few).otherwise(whole)
    hashed = hashed.withColumn("_all", all_)
    limit = _limit(scale)
    below = F.filter("_all", lambda h: (h >= 0) & (h < limit))
    least = _unsigned(F.array_min(F.transform("_all", _unsigned)))
    some = F.when(F.size("_all") > 0, F.array(least)).otherwise(F.col("_all"))
    kept = F.when(F.size("_below") > 0, F.array_sort(F.array_distinct("_below"))).otherwise(some)
    return hashed.withColumn("_below", below).withColumn(name, kept).drop("_words", "_all", "_below")


def _limit(scale: int) -> int:
    """Hashes are signed longs; those below 2**64 / scale as unsigned ones are 0..limit-1."""
    if scale < 2:
        raise ValueError("scale must be 2 or more")
    return 2**64 // scale


def _unsigned(h: Column) -> Column:
    """Flips the sign bit: signed order becomes the order of unsigned numbers, and back."""
    return h.bitwiseXOR(F.lit(-(2**63)))


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two texts' shingles together."""
    both = F.array_union(a, b)
    below = F.array_sort(F.filter(both, lambda h: (h >= 0) & (h < _limit(scale))))
    least = F.array(_unsigned(F.array_min(F.transform(both, _unsigned))))
    return F.when((F.size(below) > 0) | (F.size(both) == 0), below).otherwise(least)


def containment(a: Column, b: Column) -> Column:
    """Share of ``a``'s shingles that ``b`` has too."""
    shared = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) == 0, (F.size(b) == 0).cast("double")).otherwise(shared / F.size(a))


def likeness(a: Column, b: Column) -> Column:
    """Shared shingles over all shingles of both."""
    shared = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - shared
    return F.when(every == 0, F.lit(1.0)).otherwise(shared / every)


def printed(sketch: Column) -> Column:
    """Hex digits of the hashes, one after the other (16 each)."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def with_next(docs: DataFrame, columns: list[str], parts: int | None = None) -> DataFrame:
    """Add ``next_<c>``: the columns of the next row in descending doc_id; the last meets the first.

    Ids are cut into ``parts`` ranges at approximate quantiles (as many as there are shuffle
    partitions), and each range looks ahead by itself; the row that a range's end meets, the first row of
    the range below, is put there as well.  So texts move once, and no task holds more
    than its range.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    quantiles = F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 20 * parts)
    cuts = sorted(set(docs.agg(quantiles).first()[0] or []))
    at = _cuts_up_to(F.col("doc_id"), cuts)
    # Rows without an id come last of all.
    ranged = docs.withColumn("_range", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(at))
    ends = ranged.groupBy("_range").agg(F.max("doc_id").alias("top")).collect()  # as many as ``parts``
    ranges = sorted(r["_range"] for r in ends)
    above = dict(zip(ranges, ranges[1:] + ranges[:1], strict=True))  # the first range of all follows the last
    top = {r["_range"]: r["top"] for r in ends}
    goes = F.create_map(*[F.lit(x) for k, v in above.items() for x in (k, v)]) if above else None
    if goes is None:
        return ranged.drop("_range").select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    tops = F.create_map(*[x for k in ranges for x in (F.lit(k), F.lit(top[k]).cast("bigint"))])
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64(*columns), *[F.col(c) for c in columns]]
    guests = ranged.filter(F.col("doc_id").eqNullSafe(tops[F.col("_range")]))
    first = Window.partitionBy("_range").orderBy(*order)
    guests = guests.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    guests = guests.withColumn("_range", goes[F.col("_range")])
    both = ranged.withColumn("_guest", F.lit(False)).unionByName(guests.withColumn("_guest", F.lit(True)))
    line = Window.partitionBy("_range").orderBy("_guest", *order)
    ahead = both.select("*", *[F.lead(c).over(line).alias(f"next_{c}") for c in columns])
    return ahead.filter(~F.col("_guest")).drop("_range", "_guest")


def _cuts_up_to(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are not above a value: first by stretches, then inside one."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))

    def longs(numbers: list[int]) -> Column:
        return F.array(*[F.lit(int(c)).cast("bigint") for c in numbers])

    stretches = F.array(*[longs(cuts[i : i + step]) for i in range(0, len(cuts), step)])
    begun = F.size(F.filter(longs(cuts[::step]), lambda e: e <= value))
    inside = F.size(F.filter(F.get(stretches, begun - 1), lambda e: e <= value))
    return F.when(begun > 0, (begun - 1) * step + inside).otherwise(0)


def compare_with_next(docs: DataFrame, size: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Fingerprint each text, an edit of it, and compare both with it and with the next text.

    The edit replaces the last third (n_chars div 3 code points) by the beginning of the
    next document's text, in descending doc_id.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sketched = with_sketch(texts, "text", "sketch", size, scale)
    paired = with_next(sketched, ["text", "sketch"])
    n = F.length("text").cast("bigint")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n.cast("int") - third), F.substring("next_text", F.lit(1), third))
    paired = paired.withColumns({"n_chars": n, "edited": edited})
    paired = with_sketch(paired, "edited", "edited_sketch", size, scale)
    return paired.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("sketch")).alias("fingerprint"),
        printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_in_edited"),
        containment(F.col("sketch"), F.col("next_sketch")).alias("contained_in_next"),
    )
