"""SimHash near-duplicates through pivot distance tables.

Fingerprints: every shingle of ``shingle`` words votes with its XXH64 bits, repeats
included; a bit is 1 if set in over half the hashes.  Equal fingerprints are merged
first, so a group of copies, however large, is one row from then on.

Linking at ``bits`` or fewer differing bits:

* a table holds for each fingerprint its Hamming distances to ``PIVOTS`` reference
  fingerprints.  By the triangle inequality two fingerprints within ``bits`` differ by at
  most ``bits`` in every coordinate, so a pair whose largest coordinate difference is
  greater is discarded; the survivors are verified bit by bit;
* for far reference points alone almost all random pairs look alike, so pairs are first
  brought together by segments: of ``segments`` segments at least ``segments - bits``
  have no differing bit, hence one of the C(segments, bits) choices of untouched segments
  is equal in both.  No link is lost, and no pair is listed: the pairs of a choice meet
  in a sorted run inside a task;
* a run longer than ``BLOCK`` rows is cut into blocks by hash, and each pair of blocks is
  a run of its own, so a hot segment is spread over tasks;
* a task emits only links that join two parts not yet joined inside its run (a spanning
  forest), which keeps every component and grows with the rows, not with the pairs.

More data want more segments: 6 give 15 choices with about 21 bits each, 8 give 70 with
32 bits each.

Defined cases: null, empty and blank texts have fingerprint zero and link with each other;
rows without an id get the component of their fingerprint and never name one (null if no
member has an id); repeated rows are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueweave.llm.common import components, numbered, release_shuffles, stored

PIVOTS = 32
BLOCK = 2_048
SLICE = 1 << 15  # shingles counted at a time


def shingle_hashes(text: str | None, shingle: int = 4) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of one text, repeats included, in slices; nothing for a text without words."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes: A-Z only
    words = data.split()  # splits on space and U+0009 to U+000D
    if not words:
        return
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    for at in range(0, n, SLICE):
        pairs = zip(starts[at : min(at + SLICE, n)].tolist(), last[at : at + SLICE].tolist(), strict=True)
        yield np.array([digest(joined[a:b], 42) for a, b in pairs], dtype=np.uint64)


def majority(slices: Iterable[np.ndarray]) -> int:
    """64 bits, each 1 if set in over half the hashes; 0 without any."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for votes in slices:
        set_ = np.unpackbits(votes.view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += set_.sum(axis=0, dtype=np.uint16)  # a slice has fewer than 2**16 rows
        n += len(votes)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit SimHash of one text."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """Add ``fingerprint`` (long, the 64 bits) to the columns of ``docs`` other than text."""
    rest = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*rest, T.StructField("fingerprint", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch["text"]], dtype=np.uint64)
            columns = [batch[f.name] for f in rest] + [pa.array(found.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*[f.name for f in rest], "fingerprint"])

    return docs.select(*[f.name for f in rest], "text").mapInArrow(work, schema)


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Fixed reference fingerprints, drawn once from a seeded generator."""
    return np.random.default_rng(20).integers(0, 2**64, count, dtype=np.uint64)


def distance_table(prints: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Hamming distance of every fingerprint to every reference."""
    return np.bitwise_count(prints[:, None] ^ references[None, :]).astype(np.int8)


def segment_masks(segments: int) -> list[int]:
    """64 bits in ``segments`` stretches of nearly equal length."""
    border = [64 * i // segments for i in range(segments + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(border, border[1:], strict=False)]


def run_links(run: np.ndarray, prints: np.ndarray, side: np.ndarray, bits: int, references: np.ndarray):
    """Links inside runs of equal ``run`` (sorted): a spanning forest of each run's close pairs.

    ``side`` 1 and 2 are rows of two blocks that only meet each other; 0 meets all.
    """
    table = distance_table(prints, references)
    label = np.arange(len(run))
    left, right = [], []
    at, step = np.arange(len(run) - 1), 1
    while len(at):
        at = at[run[at] == run[at + step]]
        i, j = at, at + step
        apart = label[i] != label[j]
        apart &= (side[i] == 0) | (side[i] != side[j])
        i, j = i[apart], j[apart]
        for column in range(0, table.shape[1], 4):  # largest coordinate difference
            if len(i):
                near = (np.abs(table[i, column : column + 4] - table[j, column : column + 4]) <= bits).all(axis=1)
                i, j = i[near], j[near]
        close = np.bitwise_count(prints[i] ^ prints[j]) <= bits
        i, j = i[close], j[close]
        if len(i):
            keep = _join_labels(label, i, j)
            left.append(i[keep])
            right.append(j[keep])
        step += 1
        at = at[at + step < len(run)]
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merge the parts of linked rows in ``label``; which links were needed for that."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    keep = []
    for n, (a, b) in enumerate(zip(label[i].tolist(), label[j].tolist(), strict=True)):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
            keep.append(n)
    old = np.array(list(root), dtype=np.int64)
    new = np.array([find(x) for x in root], dtype=np.int64)
    swap = np.arange(len(label))
    swap[old] = new
    label[:] = swap[label]
    return np.array(keep, dtype=np.int64)


def close_links(nodes: DataFrame, bits: int = 4, segments: int = 6) -> DataFrame:
    """Links (a, b) that connect whatever is within ``bits`` bits.

    ``nodes``: (node, fingerprint), fingerprints distinct.  Enough links are returned for
    the components, not every pair.
    """
    masks = segment_masks(segments)
    same = [sum(c) for c in combinations(masks, segments - bits)]
    signed = [m - 2**64 if m >= 2**63 else m for m in same]
    choices = F.array(*[F.struct(F.lit(n).alias("choice"), F.lit(m).alias("mask")) for n, m in enumerate(signed)])
    rows = nodes.select("node", "fingerprint", F.inline(choices)).select(
        "node", "fingerprint", F.xxhash64("choice", F.col("fingerprint").bitwiseAND(F.col("mask"))).alias("run")
    )
    crowded = rows.groupBy("run").count().filter(F.col("count") > BLOCK)
    crowded = crowded.select("run", F.ceil(F.col("count") / BLOCK).alias("blocks"))
    both = rows.join(crowded, "run", "left")
    mine = F.pmod(F.xxhash64("fingerprint", F.lit(3)), F.col("blocks"))
    others = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1),
        lambda o: F.struct(
            F.xxhash64("run", F.least(mine, o), F.greatest(mine, o)).alias("run"),
            F.when(mine == o, 0).when(mine < o, 1).otherwise(2).alias("side"),
        ),
    )
    alone = F.array(F.struct(F.col("run"), F.lit(0).alias("side")))
    dealt = both.select(
        "node", "fingerprint", F.inline(F.when(F.col("blocks").isNull(), alone).otherwise(others))
    )
    references = pivots()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pd.DataFrame | None = None

        def links(frame: pd.DataFrame) -> pa.RecordBatch:
            prints = frame["fingerprint"].to_numpy().view(np.uint64)
            i, j = run_links(frame["run"].to_numpy(), prints, frame["side"].to_numpy(), bits, references)
            node = frame["node"].to_numpy()
            return pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["a", "b"])

        for batch in batches:  # sorted by run; a run may go on in the next batch
            frame = batch.to_pandas()
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            whole = frame["run"] != frame["run"].iloc[-1] if len(frame) else []
            held = frame[~whole].reset_index(drop=True) if len(frame) else None
            if len(frame) and whole.any():
                yield links(frame[whole].reset_index(drop=True))
        if held is not None:
            yield links(held)

    return dealt.repartition("run").sortWithinPartitions("run").mapInArrow(work, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, bits: int = 4, shingle: int = 4, segments: int = 6) -> DataFrame:
    """Columns of ``docs`` but the text, with fingerprint (16 hex digits) and component_id.

    component_id is the smallest doc_id reachable through links, itself included.
    """
    rows = stored(fingerprints(docs, shingle))
    nodes = stored(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")))
    links = close_links(nodes.select(F.col("fingerprint").alias("node"), "fingerprint"), bits, segments)
    parts = components(links)
    release_shuffles(docs.sparkSession)
    named = nodes.join(parts, nodes["fingerprint"] == parts["node"], "left").select(
        "fingerprint", "first_id", F.coalesce("component", "fingerprint").alias("part")
    )
    smallest = named.groupBy("part").agg(F.min("first_id").alias("component_id"))
    classes = stored(named.join(smallest, "part").select("fingerprint", "component_id"))
    given = [c for c in docs.columns if c != "text"]
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return rows.join(classes, "fingerprint").select(*given, digits.alias("fingerprint"), "component_id")


def first_of_groups(docs: DataFrame, bits: int = 4, shingle: int = 5, segments: int = 6) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row of the smallest id.

    Repeated rows count as copies too; a group without any id keeps one row as well.
    """
    full = numbered(docs)
    rows = near_duplicates(full.select("_row", "doc_id", "text"), bits, shingle, segments)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    part = F.coalesce(F.col("component_id").cast("string"), F.col("fingerprint"))
    first = rows.groupBy(part.alias("part")).agg(F.min_by("_row", order).alias("_row"))
    return full.join(first.select("_row"), "_row", "left_semi").select(*docs.columns)
