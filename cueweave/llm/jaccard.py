"""Near-duplicates by exact Jaccard similarity of word shingles.

Texts whose shingle sets have at least ``SHARE`` of their union in common are linked;
connected components are groups.  No link is lost and none is added:

* texts of equal sets are one class (a 64-bit digest of the set) from the start;
* classes whose SimHash fingerprints are close (``simhash.close_links``, at its own bits) are compared
  first, and joined into components; fingerprints alone would lose links and add some, so
  every one of these is verified, and the steps below find those that fingerprints miss;
* sets are put in one global order, and a set sends its first n - ceil(SHARE n) + 1 shingle
  hashes: two sets that alike have one of these in common, whatever the order.  Shingles
  that are frequent in a sample come last, by their count, so common lines rarely meet;
* classes of a hash are then compared with its least class only, and joined into
  components; then every pair of a hash that is in two components is compared.  A group
  of near copies costs its rows, not its pairs;
* a pair is dropped early only where it must fail: by the sizes, because what follows the
  shared hash in one of the sets is too little for it to be the first they share (the pair
  then meets at an earlier one), or because a bitmap of shingle parities differs in more
  places than the sets may.  A short bitmap of one length
  is looked at where pairs meet, then one that is as long as its set is large, so that it
  tells for sets of any size; all others are verified on the shingles themselves, and only for
  these do texts move.

Defined cases: a text of fewer words than a shingle is one shingle; null, empty and blank
texts are alike; repeated rows are copies; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueweave.llm import simhash
from cueweave.llm.common import components, numbered, release_shuffles, slices, stored

SHARE = 4, 5  # 0.8
SAMPLE = 16_384  # classes that the order is learnt from, in expectation
FREQUENT = 65_536  # shingles that the order knows of, at most
WORDS = 16  # of 64 bits in a short bitmap
LONGEST = 1 << 20  # bits of the bitmap of a large set, at most
HELD = 1 << 20  # hashes sent at a time


def stretches(text: str | None, shingle: int = 5) -> list[bytes]:
    """The shingles of a text; A-Z lower-cased, words split on space and U+0009 to U+000D."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    return [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]


def distinct(slices_: list[np.ndarray]) -> np.ndarray:
    """The distinct hashes, sorted."""
    return np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *slices_]))


def hashes(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return distinct(list(simhash.shingle_hashes(text, shingle)))


def parities(found: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap: whether an odd number of the hashes falls on a bit."""
    odd = np.bincount((found % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


def long_bitmap(found: np.ndarray) -> bytes:
    """Parities in at least two bits a hash, a power of two of them."""
    return parities(found, min(LONGEST, max(64, 1 << (2 * len(found)).bit_length()))).tobytes()


def bits_apart(a: bytes, b: bytes) -> int:
    """In how many bits two long bitmaps differ, at the length of the shorter one."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    short = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, short), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def class_of(found: np.ndarray) -> int:
    """64 bits that name a set of hashes."""
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def alike(a: set[bytes], b: set[bytes]) -> bool:
    """Whether two sets have ``SHARE`` of their union in common."""
    both = len(a & b)
    return both * SHARE[1] >= SHARE[0] * (len(a) + len(b) - both)


def prefix(found: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first hashes of a set in the global order: by count in the sample, then by value."""
    n = len(found)
    if not n:
        return found
    take = n - -(-SHARE[0] * n // SHARE[1]) + 1
    weight = np.zeros(n, dtype=np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
        weight = np.where(known[at] == found, counts[at], 0)
    return found[np.argsort(weight, kind="stable")[:take]]


def _sets(full: DataFrame, shingle: int) -> DataFrame:
    """_row, doc_id, key (class), size, bitmaps and fingerprint of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, sizes, prints, maps, long_maps = [], [], [], [], []
            for text in batch["text"]:
                votes = list(simhash.shingle_hashes(text.as_py(), shingle))
                prints.append(simhash.majority(votes))
                found = distinct(votes)
                keys.append(class_of(found))
                sizes.append(len(found))
                maps.append(parities(found, 64 * WORDS).view(np.int64))
                long_maps.append(long_bitmap(found))
            columns = [batch["_row"], batch["doc_id"], pa.array(keys, pa.int64()), pa.array(sizes, pa.int64())]
            columns += [pa.array(maps, pa.list_(pa.int64())), pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), pa.array(long_maps, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["_row", "doc_id", "key", "size", "bitmap", "fingerprint", "bits"])

    given = full.select("_row", F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    kinds = "_row bigint, doc_id bigint, key bigint, size bigint, bitmap array<bigint>, fingerprint bigint, bits binary"
    return given.mapInArrow(work, kinds)


def _tokens(full: DataFrame, shingle: int, known: np.ndarray | None, counts: np.ndarray | None) -> DataFrame:
    """(token, key, place): the prefix of every text, in order; all its hashes if no order is given."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(tokens: list[np.ndarray], keys: list[int]) -> pa.RecordBatch:
            owner = np.repeat(np.array(keys, dtype=np.int64), [len(t) for t in tokens])
            token = np.concatenate(tokens).view(np.int64)
            place = np.concatenate([np.arange(len(t), dtype=np.int32) for t in tokens])
            columns = [pa.array(token), pa.array(owner), pa.array(place)]
            return pa.RecordBatch.from_arrays(columns, names=["token", "key", "place"])

        for batch in slices(batches):
            tokens, keys, held = [], [], 0
            for text in batch["text"]:
                found = hashes(text.as_py(), shingle)
                keys.append(class_of(found))
                tokens.append(found if known is None else prefix(found, known, counts))
                held += len(tokens[-1])
                if held >= HELD:
                    yield sent(tokens, keys)
                    tokens, keys, held = [], [], 0
            if tokens:
                yield sent(tokens, keys)

    return full.select("text").mapInArrow(work, "token bigint, key bigint, place int")


def _order(full: DataFrame, classes: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that are frequent in a sample of distinct texts, sorted, and their counts there."""
    every = max(1, classes // SAMPLE)
    some = full.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).distinct()
    often = _tokens(some, shingle, None, None).groupBy("token").count().filter("count > 1")
    rows = often.orderBy(F.desc("count"), "token").limit(FREQUENT).toPandas()
    known = rows["token"].to_numpy(dtype=np.int64).view(np.uint64)
    by = np.argsort(known)
    return known[by], rows["count"].to_numpy(dtype=np.int64)[by]


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that sizes and bitmaps leave possible."""
    kept = ["key", "size", "bitmap"]
    left = nodes.select(*[F.col(c).alias(f"a_{c}") for c in kept])
    right = nodes.select(*[F.col(c).alias(f"b_{c}") for c in kept])
    both = pairs.join(left, F.col("a") == F.col("a_key")).join(right, F.col("b") == F.col("b_key"))
    return both.filter(_may("a_", "b_")).select("a", "b")


def _may(a: str, b: str):
    """Neither sizes nor bitmaps rule the pair out."""
    p, q = SHARE
    m, n = F.col(f"{a}size"), F.col(f"{b}size")
    differ = F.zip_with(f"{a}bitmap", f"{b}bitmap", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(differ, F.lit(0), lambda total, n: total + n)
    return (F.least(m, n) * q >= F.greatest(m, n) * p) & (apart * (p + q) <= (m + n) * (q - p))


def _may_be_first(a: str, b: str):
    """A hash at ``place`` in both sets can be the first that two alike sets share."""
    p, q = SHARE
    m, n = F.col(f"{a}size"), F.col(f"{b}size")
    return F.least(m - F.col(f"{a}place"), n - F.col(f"{b}place")) * (p + q) >= (m + n) * p


def _still_possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that sizes and long bitmaps leave possible."""
    p, q = SHARE
    left, right = nodes.select("key", "size", "bits").toDF("a", "m", "x"), nodes.select("key", "size", "bits").toDF("b", "n", "y")
    both = pairs.join(left, "a").join(right, "b").filter(F.least("m", "n") * q >= F.greatest("m", "n") * p)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = zip(*(batch[c].to_pylist() for c in ("m", "n", "x", "y")), strict=True)
            may = [bits_apart(x, y) * (p + q) <= (m + n) * (q - p) for m, n, x, y in rows]
            yield batch.select(["a", "b"]).filter(pa.array(may, pa.bool_()))

    return both.select("a", "b", "m", "n", "x", "y").mapInArrow(work, "a bigint, b bigint")


def _verified(pairs: DataFrame, nodes: DataFrame, full: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) that are alike, by their shingles."""
    pairs = stored(_still_possible(pairs, nodes))
    release_shuffles(full.sparkSession)  # the files that pairs were found with
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    wanted = nodes.select("key", "node").join(ends, "key", "left_semi")
    texts = stored(full.select("_row", "text").join(wanted, F.col("_row") == F.col("node")).select("key", "text"))
    release_shuffles(full.sparkSession)  # the files of that join hold every text
    left, right = texts.toDF("a", "a_text"), texts.toDF("b", "b_text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            same = [
                alike(set(stretches(x.as_py(), shingle)), set(stretches(y.as_py(), shingle)))
                for x, y in zip(batch["a_text"], batch["b_text"], strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    met = pairs.join(left, "a").join(right, "b").select("a", "b", "a_text", "b_text")
    links = stored(met.mapInArrow(work, "a bigint, b bigint"))
    release_shuffles(full.sparkSession)
    return links


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes: of equal fingerprints, and of close ones."""
    least = stored(nodes.groupBy("fingerprint").agg(F.min("key").alias("node")))
    same = nodes.select("key", "fingerprint").join(least, "fingerprint").filter("key <> node").select(F.col("key").alias("a"), F.col("node").alias("b"))
    return same.union(simhash.close_links(least))


def _labelled(rows: DataFrame, near: DataFrame) -> DataFrame:
    """Rows (key, ...) with the label of their component; a class without links is its own."""
    parts = components(near)
    return rows.join(parts, rows["key"] == parts["node"], "left").select(
        *rows.columns, F.coalesce("component", "key").alias("label")
    )


def links(full: DataFrame, nodes: DataFrame, shingle: int = 5) -> DataFrame:
    """Links (a, b) between classes: enough of those that are alike for every component.

    ``full``: _row, text.  ``nodes``: a row for each class, with node (a _row of it).
    """
    close = _verified(_by_fingerprint(nodes), nodes, full, shingle)

    known, counts = _order(full, nodes.count(), shingle)
    tokens = _tokens(full, shingle, known, counts).repartition("token")  # one exchange for count and join
    shared = tokens.groupBy("token").agg(F.min("key").alias("least"), F.max("key").alias("most")).filter("least < most")
    met = stored(tokens.join(shared, "token").select("token", "key", "place", "least").distinct())
    release_shuffles(full.sparkSession)

    apart = _labelled(met.filter("key <> least").select("key", "least").distinct(), close)
    apart = _labelled(apart.select(F.col("least").alias("key"), F.col("key").alias("a"), F.col("label").alias("a_label")), close)
    stars = apart.filter("label <> a_label").select("a", F.col("key").alias("b"))
    near = close.union(_verified(_possible(stars, nodes), nodes, full, shingle))

    # What is left: pairs of one hash in two components.  All but the hash's largest component meet all.
    labelled = _labelled(met.select("token", "key", "place"), near)
    sizes = labelled.groupBy("token", "label").count()
    main = sizes.groupBy("token").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("n"))
    mixed = labelled.join(main.filter("n > 1").drop("n"), "token").join(nodes.drop("node", "best", "fingerprint", "bits"), "key")
    one = mixed.filter("label <> main")
    kept = ["token", "key", "place", "label", "main", "size", "bitmap"]
    a = one.select(*[F.col(c).alias(f"a_{c}") for c in kept])
    b = mixed.select(*[F.col(c).alias(f"b_{c}") for c in kept])
    once = (F.col("a_label") < F.col("b_label")) | (F.col("b_label") == F.col("b_main"))
    rest = a.join(b, (F.col("a_token") == F.col("b_token")) & (F.col("a_label") != F.col("b_label")) & once & _may_be_first("a_", "b_") & _may("a_", "b_"))
    rest = rest.select(F.col("a_key").alias("a"), F.col("b_key").alias("b")).distinct()
    return near.union(_verified(rest, nodes, full, shingle))


def first_of_groups(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row of the smallest id.

    Repeated rows count as copies too; a group without any id keeps one row as well.
    """
    full = numbered(docs)
    rows = _sets(full, shingle)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("best")
    same = [F.first(c).alias(c) for c in ("size", "bitmap", "bits")]
    # Repeated shingles vote, so texts of one class may differ in fingerprint: the class takes one of them.
    nodes = stored(rows.groupBy("key").agg(F.min("_row").alias("node"), best, F.min("fingerprint").alias("fingerprint"), *same))
    parts = components(links(full, nodes, shingle))
    named = nodes.join(parts, nodes["key"] == parts["node"], "left").select("best", F.coalesce("component", "key").alias("part"))
    first = stored(named.groupBy("part").agg(F.min("best").alias("best")).select(F.col("best._row").alias("_row")))
    release_shuffles(docs.sparkSession)
    return full.join(first, "_row", "left_semi").select(*docs.columns)
