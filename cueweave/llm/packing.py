"""Packing by non-negative least squares over length combinations.

1. Documents become token ids (with the end id); whole windows of ``window`` tokens are
   sequences of their own, which leaves each document a rest shorter than the window.
2. Rests are counted by length class (``grid`` tokens wide).  Combinations of up to three
   classes whose lower ends add up to the window are enumerated, and non-negative least
   squares (Lawson-Hanson) finds how often to use each so that the histogram is used up.
   The histogram has ``window / grid`` counts, whatever the number of documents.
3. Counts are rounded down and fitted to what there is.  A document takes its slot by its
   rank in its class; a sequence is then full or a few tokens over, and the last piece is
   cut there.
4. What no combination takes, and what was cut off, is packed greedily: laid end to end
   and cut at every window.  The end of that line goes to sequences of powers of two.

So every sequence is full, no token is padding, and most documents stay whole.

Token ids are those of the vocabulary file in the ``tokenizers`` library; texts are encoded
by ``tiktoken`` with the same vocabulary, which is six times faster and gives the same ids
(tested); texts with stretches it is slow on go to ``tokenizers``.

Defined cases: null and empty texts are the end id alone; repeated rows and rows without
an id are packed like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueweave.llm.common import running_totals, slices, stored

END = 1
#: Splitting rule of the byte-level vocabulary. Fixed value.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = {"<|endoftext|>": 50256}  # Fixed value.
STRETCH = 500  # characters without a change from white space to other ones


def slow(text: str) -> bool:
    """Whether a text has a stretch of ``STRETCH`` characters without, or of nothing but, white space."""
    words = text.split()
    if len(text) < STRETCH or not words:
        return len(text) >= STRETCH
    sizes = list(map(len, words))
    if max(sizes) >= STRETCH:
        return True
    # A long stretch of space leaves more space than one sign between two words.
    spare = len(text) - sum(sizes) - (len(words) - 1)
    return spare >= STRETCH - 1 and re.search(rf"\s{{{STRETCH}}}", text) is not None


class Encoder:
    """Texts to ids, as ``tokenizers`` gives them with add_special_tokens=False."""

    def __init__(self, vocabulary: str) -> None:
        import tiktoken

        with open(re.sub(r"\.json$", ".tiktoken", vocabulary), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.vocabulary, self.slow = vocabulary, None
        self.fast = tiktoken.Encoding("bytes", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=SPECIAL)

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.array([END], dtype=np.uint32)
        if slow(text):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.vocabulary)
            found = self.slow.encode(text, add_special_tokens=False).ids
        else:
            found = self.fast.encode_to_numpy(text, allowed_special="all")
        ids = np.full(len(found) + 1, END, dtype=np.uint32)
        ids[:-1] = found
        return ids


@cache
def encoder(vocabulary: str) -> Encoder:
    """One for all tasks of a Python worker: the vocabulary is read once."""
    return Encoder(vocabulary)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokens(docs: DataFrame, window: int, vocabulary: str | None = None) -> DataFrame:
    """_row, doc_id, doc_tokens, full_crc32 (of each whole window), rest (ids, two bytes each)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(vocabulary or vocabulary_path()).ids
        for batch in slices(batches):
            count, crcs, rests = [], [], []
            for text in batch["text"]:
                ids = to_ids(text.as_py())
                n = len(ids) - len(ids) % window
                count.append(len(ids))
                crcs.append([zlib.crc32(ids[a : a + window].astype("<u4").tobytes()) for a in range(0, n, window)])
                rests.append(ids[n:].astype("<u2").tobytes())
            made = [pa.array(count, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rests, pa.binary())]
            names = ["_row", "doc_id", "doc_tokens", "full_crc32", "rest"]
            yield pa.RecordBatch.from_arrays([batch["_row"], batch["doc_id"], *made], names=names)

    given = docs.select("_row", "doc_id", "text")
    return given.mapInArrow(
        work, "_row bigint, doc_id bigint, doc_tokens bigint, full_crc32 array<bigint>, rest binary"
    )


def combinations(classes: int) -> np.ndarray:
    """All sets of two or three length classes (1..classes-1) that fill a window of ``classes``."""
    a, b = np.meshgrid(np.arange(0, classes), np.arange(1, classes), indexing="ij")
    c = classes - a - b
    keep = (a <= b) & (b <= c)
    return np.stack([a[keep], b[keep], c[keep]], axis=1)


def nonnegative_least_squares(patterns: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """How often to use each pattern (class numbers, 0 for none) to come nearest to ``goal``.

    Lawson and Hanson's active sets; the matrix is never written out, since a column has
    at most three entries.
    """
    use, active = np.zeros(len(patterns)), []
    scale, aim = max(float(goal.max(initial=0)), 1.0), goal.astype(float)

    def columns(which: list[int]) -> np.ndarray:
        table = np.zeros((len(goal), len(which)))
        for row in patterns[which].T:
            np.add.at(table, (row, np.arange(len(which))), 1.0)
        table[0] = 0.0
        return table

    for _ in range(4 * len(goal)):
        left = goal - columns(active) @ use[active] if active else goal.astype(float)
        left[0] = 0.0
        slope = left[patterns].sum(axis=1)
        slope[active] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= 1e-7 * scale:
            break
        active.append(best)
        while True:
            table = columns(active)
            ridge = 1e-10 * np.eye(len(active))  # keeps dependent columns solvable
            found = np.linalg.solve(table.T @ table + ridge, table.T @ aim)
            if (found > 0).all():
                break
            now = use[active]
            down = found <= 0
            step = (now[down] / np.maximum(now[down] - found[down], 1e-300)).min()
            use[active] = now + step * (found - now)
            gone = use[active] <= 1e-9 * scale
            gone |= down & (use[active] <= use[active][down].min())
            use[[p for p, out in zip(active, gone, strict=True) if out]] = 0.0
            active = [p for p, out in zip(active, gone, strict=True) if not out]
            if not active:
                break
        use[active] = found if active else 0.0
    return use


def plan(histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(patterns used, whole counts) that never ask for more of a class than there is."""
    patterns = combinations(len(histogram))
    goal = histogram.astype(float)
    goal[0] = 0.0
    use = nonnegative_least_squares(patterns, goal)
    chosen = np.flatnonzero(use >= 1.0)
    chosen = chosen[np.argsort(-use[chosen], kind="stable")]
    have, counts = histogram.astype(np.int64), []
    for p in chosen:
        kinds, times = np.unique(patterns[p][patterns[p] > 0], return_counts=True)
        n = min(int(use[p]), int((have[kinds] // times).min()))
        have[kinds] -= n * times
        counts.append(n)
    counts = np.array(counts, dtype=np.int64)
    return patterns[chosen][counts > 0], counts[counts > 0]


def _slots(patterns: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, end rank, first sequence, place in the sequence) of every slot range."""
    used: dict[int, int] = {}
    first = np.concatenate([[0], np.cumsum(counts)])
    found = []
    for row, n, sequence in zip(patterns.tolist(), counts.tolist(), first.tolist(), strict=False):
        for place, kind in enumerate(row):
            if kind:
                at = used.get(kind, 0)
                found.append((kind, at, at + n, sequence, place))
                used[kind] = at + n
    return found


def pack(docs: DataFrame, window: int = 2048, grid: int = 8, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``window`` is a power of two, ``grid`` divides it.
    """
    spark = docs.sparkSession
    rows = stored(tokens(docs.withColumn("_row", F.monotonically_increasing_id()), window, vocabulary))
    narrow = rows.select("_row", "doc_id", "doc_tokens", F.size("full_crc32").cast("bigint").alias("n_full"))
    narrow = narrow.withColumn("rest", F.col("doc_tokens") - F.col("n_full") * window).withColumn(
        "class", F.floor(F.col("rest") / grid).cast("int")
    )
    counted = narrow.groupBy("class").agg(F.count("*"), F.sum("n_full")).collect()  # window / grid rows
    histogram = np.zeros(window // grid, dtype=np.int64)
    for kind, n, _ in counted:
        histogram[kind] = n
    patterns, counts = plan(histogram)
    n_whole, n_mixed = sum(int(f) for *_, f in counted), int(counts.sum())

    # Whole windows: one sequence each.
    whole = rows.select("_row", "doc_id", "doc_tokens", "full_crc32").filter(F.size("full_crc32") > 0)
    base = running_totals(narrow.select("_row", "doc_id", "n_full").filter("n_full > 0"), [], ["doc_id"], "n_full", "base", ("_row",))
    full = (
        whole.join(base.select("_row", "base"), "_row")
        .select("doc_id", "doc_tokens", "base", F.posexplode("full_crc32").alias("at", "ids_crc32"))
        .select(
            "doc_id",
            (F.col("at").cast("bigint") * window).alias("start"),
            F.lit(window).cast("bigint").alias("length"),
            "ids_crc32",
            "doc_tokens",
            (F.col("base") + F.col("at")).alias("sequence_id"),
            F.lit(0).cast("bigint").alias("offset"),
        )
    )

    # Rests that a combination takes: ranks in the class, then sequences.
    rests = narrow.filter("rest > 0").withColumn("one", F.lit(1).cast("bigint"))
    ranked = running_totals(rests, ["class"], ["doc_id"], "one", "rank", ("_row",))
    ranges: dict[int, list] = {}
    for kind, lo, hi, sequence, place in _slots(patterns, counts):
        ranges.setdefault(kind, []).append((lo, hi, sequence, place))
    slots = spark.createDataFrame(
        [(k, v) for k, v in ranges.items()],
        "class int, slots array<struct<lo:bigint,hi:bigint,sequence:bigint,place:int>>",
    )
    # Fixed size bound: a row per class, at most three slots for each of at most as many combinations.
    found = ranked.join(F.broadcast(slots), "class", "left").withColumn(
        "slot",
        F.get(F.filter("slots", lambda s: (s["lo"] <= F.col("rank")) & (F.col("rank") < s["hi"])), F.lit(0)),
    )
    found = stored(
        found.select(
            "_row", "doc_id", "rest", "slot.place", (F.col("slot.sequence") + F.col("rank") - F.col("slot.lo")).alias("seq")
        )
    )
    members = Window.partitionBy("seq").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    seated = found.filter("seq is not null").withColumn("end", F.sum("rest").over(members))
    seated = seated.withColumn("offset", F.col("end") - F.col("rest")).withColumn(
        "kept", F.least("rest", F.lit(window) - F.col("offset"))
    )
    mixed = seated.select(
        "_row", F.lit(0).cast("bigint").alias("from"), F.col("kept").alias("length"),
        (F.col("seq") + n_whole).alias("sequence_id"), "offset",
    )

    # The others and what was cut off, end to end.
    over = seated.filter("kept < rest").select("_row", "doc_id", F.col("kept").alias("from"), (F.col("rest") - F.col("kept")).alias("n"))
    others = found.filter("seq is null").select("_row", "doc_id", F.lit(0).cast("bigint").alias("from"), F.col("rest").alias("n"))
    line = running_totals(others.union(over), [], ["doc_id", "from"], "n", "at", ("_row",))
    total = narrow.agg(F.sum("rest")).first()[0] or 0
    total -= n_mixed * window  # mixed sequences are exactly full
    line = line.select("*", F.explode(_cells(total, window)).alias("cell"))
    a = F.greatest("at", F.col("cell.lo"))
    b = F.least(F.col("at") + F.col("n"), F.col("cell.hi"))
    greedy = line.filter(a < b).select(
        "_row", (F.col("from") + a - F.col("at")).alias("from"), (b - a).alias("length"),
        (F.col("cell.no") + n_whole + n_mixed).alias("sequence_id"), (a - F.col("cell.lo")).alias("offset"),
    )
    return full.union(_with_crc(rows, mixed.union(greedy), window))


def _cells(total: int, window: int):
    """Sequences that a stretch (at, n) of the greedy line touches: no, lo, hi.

    Whole windows first; the rest of the line in powers of two, largest first.
    """
    windows, tail = divmod(total, window)
    cells, at = [], windows * window
    for bit in reversed(range(window.bit_length())):
        if tail >> bit & 1:
            cells.append((windows + len(cells), at, at + (1 << bit)))
            at += 1 << bit
    kind = "array<struct<no:bigint,lo:bigint,hi:bigint>>"
    last = F.array(*[F.struct(*[F.lit(x).cast("bigint").alias(n) for n, x in zip(("no", "lo", "hi"), c, strict=True)]) for c in cells]).cast(kind)
    first, end = F.floor(F.col("at") / window), F.floor((F.col("at") + F.col("n") - 1) / window)
    numbers = F.when(first < windows, F.sequence(first, F.least(end, F.lit(windows - 1).cast("bigint"))))
    steps = F.transform(
        numbers, lambda w: F.struct(w.alias("no"), (w * window).alias("lo"), ((w + 1) * window).alias("hi"))
    ).cast(kind)
    return F.concat(F.coalesce(steps, F.array().cast(kind)), last)


def _with_crc(rows: DataFrame, pieces: DataFrame, window: int) -> DataFrame:
    """Rows of the result for pieces of rests: ids come back to their pieces by ``_row``."""
    grouped = pieces.groupBy("_row").agg(F.collect_list(F.struct("from", "length", "sequence_id", "offset")).alias("pieces"))
    joined = rows.select("_row", "doc_id", "doc_tokens", "rest").join(grouped, "_row").drop("_row")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            columns = (batch[c].to_pylist() for c in ("doc_id", "doc_tokens", "rest", "pieces"))
            for doc_id, n, rest, parts in zip(*columns, strict=True):
                ids = np.frombuffer(rest, dtype="<u2").astype("<u4")
                for p in parts:
                    at = p["from"]
                    crc = zlib.crc32(ids[at : at + p["length"]].tobytes())
                    out.append((doc_id, n - len(ids) + at, p["length"], crc, n, p["sequence_id"], p["offset"]))
            columns = list(zip(*out, strict=True)) or [()] * 7
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return joined.mapInArrow(
        work,
        "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    )
