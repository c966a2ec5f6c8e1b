"""Embedding near-duplicates: epsilon grid order join.

Unit vectors with cosine c lie sqrt(2 - 2c) apart, so links are pairs within that distance,
epsilon.  Projection on the leading principal axes never lengthens a distance.

1. The axes come from the covariance of all unit vectors, summed over the whole table.
2. Vectors are sorted by label, then by grid cell (side epsilon) along the axes, and the
   sequence is cut into blocks of at most ``BLOCK`` vectors, each with its bounding box.
3. Sequence intervals are joined recursively: a pair of intervals is dropped if their labels
   cannot meet or their boxes are more than epsilon apart, else each is replaced by its
   ``FAN`` parts, until single blocks are left.  Each level is a join over box tables.
4. Block pairs that remain are multiplied out in double precision, in sub-blocks that are
   skipped by their boxes again; what reaches ``threshold`` is a link.  A task returns counts and a
   spanning forest, never the list of pairs.

Equal vectors of a label are merged before: a class is one row with its number of copies,
so a hot vector costs nothing.

Defined cases: a label that is null, a vector that is null, empty, zero or holds a null or non-finite
component links with nothing; vectors of different length never link; repeated rows are copies
and link; a null id counts as a link of others but names no component; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueweave.llm.common import components, numbered, stored

AXES = 8
BLOCK = 1_024
FAN = 8
SUB = 128


def _units(vectors: pd.Series, width: int) -> np.ndarray:
    """Unit vectors in double precision, short ones filled up with zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    out /= np.abs(out).max(axis=1, keepdims=True, initial=1e-300)  # keeps squares in range
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def principal_axes(classes: DataFrame, width: int, count: int = AXES) -> np.ndarray:
    """Leading eigenvectors of the covariance of all unit vectors (width x count).

    One row of width * width sums a partition comes to the driver's aggregate.
    """

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width + 2))
        for frame in frames:
            x = _units(frame["vector"], width)
            total[:, :width] += x.T @ x
            total[:, width] += x.sum(axis=0)
            total[0, width + 1] += len(x)
        yield pd.DataFrame({"row": range(width), "sums": list(total)})

    parts = classes.select("vector").mapInPandas(sums, "row int, sums array<double>")
    columns = [F.sum(F.get("sums", F.lit(i))).alias(f"c{i}") for i in range(width + 2)]
    found = np.array([list(r)[1:] for r in parts.groupBy("row").agg(*columns).orderBy("row").collect()], dtype=float)
    if not len(found) or not found[0, -1]:
        return np.eye(width)[:, :count]
    mean = found[:, width] / found[0, -1]
    values, axes = np.linalg.eigh(found[:, :width] / found[0, -1] - np.outer(mean, mean))
    return axes[:, np.argsort(-values)][:, :count]


def _projected(classes: DataFrame, axes: np.ndarray, epsilon: float) -> DataFrame:
    """Add ``at`` (coordinates on the axes) and ``cells``."""
    width = len(axes)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = _units(frame["vector"], width) @ axes
            frame["at"], frame["cells"] = list(at), list(np.floor(at / epsilon).astype(np.int32))
            yield frame

    return classes.mapInPandas(work, "node bigint, label int, copies bigint, vector array<double>, at array<double>, cells array<int>")


def _blocks(rows: DataFrame) -> DataFrame:
    """One row per block of the sorted sequence, with its number ``block``."""
    keys = ["label", *[F.col("cells")[i] for i in range(AXES)], "node"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, held = TaskContext.get().partitionId(), 0, []

        def block(frame: pd.DataFrame) -> pa.RecordBatch:
            nonlocal n
            at = np.stack(frame["at"].to_list())
            n += 1
            columns = {
                "part": [part], "no": [n - 1],
                "label_lo": [int(frame["label"].iloc[0])], "label_hi": [int(frame["label"].iloc[-1])],
                "lo": [at.min(axis=0)], "hi": [at.max(axis=0)],
                "nodes": [frame["node"].to_numpy()], "labels": [frame["label"].to_numpy().astype(np.int64)],
                "copies": [frame["copies"].to_numpy()],
                "widths": [[len(v) for v in frame["vector"]]],
                "vectors": [np.concatenate(frame["vector"].to_list())],
            }
            return pa.RecordBatch.from_pandas(pd.DataFrame(columns), preserve_index=False)

        for batch in batches:
            frame = batch.to_pandas()
            held.append(frame)
            if sum(map(len, held)) >= BLOCK:
                frame = pd.concat(held, ignore_index=True)
                whole = len(frame) - len(frame) % BLOCK
                for a in range(0, whole, BLOCK):
                    yield block(frame[a : a + BLOCK])
                held = [frame[whole:]]
        if held and sum(map(len, held)):
            yield block(pd.concat(held, ignore_index=True))

    schema = (
        "part bigint, no bigint, label_lo bigint, label_hi bigint, lo array<double>, hi array<double>, nodes array<bigint>,"
        " labels array<bigint>, copies array<bigint>, widths array<bigint>, vectors array<double>"
    )
    many = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut_ = stored(rows.repartitionByRange(many, *keys).sortWithinPartitions(*keys).mapInArrow(cut, schema))
    sizes = {r["part"]: r["n"] for r in cut_.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a partition
    start, starts = 0, []
    for part in sorted(sizes):
        starts.append((part, start))
        start += sizes[part]
    known = rows.sparkSession.createDataFrame(starts, "part bigint, start bigint")
    return cut_.join(F.broadcast(known), "part").withColumn("block", F.col("start") + F.col("no")).drop("start", "no", "part")


def _apart(a: str, b: str, epsilon: float):
    """Whether two boxes are certainly more than epsilon apart."""
    gap = F.zip_with(f"{a}.lo", f"{b}.hi", lambda x, y: F.greatest(x - y, F.lit(0.0)))
    other = F.zip_with(f"{b}.lo", f"{a}.hi", lambda x, y: F.greatest(x - y, F.lit(0.0)))
    total = F.aggregate(F.zip_with(gap, other, lambda x, y: x * x + y * y), F.lit(0.0), lambda s, x: s + x)
    labels = (F.col(f"{a}.label_lo") > F.col(f"{b}.label_hi")) | (F.col(f"{b}.label_lo") > F.col(f"{a}.label_hi"))
    return labels | (total > (epsilon * (1 + 1e-9)) ** 2)


def block_pairs(boxes: DataFrame, epsilon: float) -> DataFrame:
    """(i, j) with i <= j: blocks that may hold links, by recursive joins of sequence intervals."""
    levels = [stored(boxes.select(F.col("block").alias("id"), "label_lo", "label_hi", "lo", "hi"))]
    while levels[-1].count() > 1:
        below = levels[-1].withColumn("id", F.floor(F.col("id") / FAN))
        axes = range(AXES)
        levels.append(
            stored(
                below.groupBy("id").agg(
                    F.min("label_lo").alias("label_lo"),
                    F.max("label_hi").alias("label_hi"),
                    F.array(*[F.min(F.col("lo")[i]) for i in axes]).alias("lo"),
                    F.array(*[F.max(F.col("hi")[i]) for i in axes]).alias("hi"),
                )
            )
        )
    pairs = levels[-1].select(F.col("id").alias("i"), F.col("id").alias("j"))
    for level in reversed(levels[:-1]):
        parent = level.withColumn("parent", F.floor(F.col("id") / FAN))
        opened = pairs.join(parent.alias("a"), F.col("i") == F.col("a.parent")).join(
            parent.alias("b"), F.col("j") == F.col("b.parent")
        )
        near = opened.filter((F.col("a.id") <= F.col("b.id")) & ~_apart("a", "b", epsilon))
        pairs = stored(near.select(F.col("a.id").alias("i"), F.col("b.id").alias("j")))
    return pairs


def _matches(a: dict, b: dict, threshold: float, epsilon: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (each once) of two blocks with cosine at or above the threshold."""
    for p in range(0, len(a["nodes"]), SUB):
        for q in range(p if same else 0, len(b["nodes"]), SUB):
            ai, bi = slice(p, p + SUB), slice(q, q + SUB)
            x, y = a["at"][ai], b["at"][bi]
            gap = np.maximum(0, np.maximum(x.min(axis=0) - y.max(axis=0), y.min(axis=0) - x.max(axis=0)))
            if (gap**2).sum() > (epsilon * (1 + 1e-9)) ** 2:
                continue
            near = a["units"][ai] @ b["units"][bi].T >= threshold
            near &= (a["labels"][ai, None] == b["labels"][None, bi]) & (a["widths"][ai, None] == b["widths"][None, bi])
            if same and p == q:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            if len(i):
                yield i + p, j + q


def linked(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    ``vectors``: vec_id, embedding (array), label.
    """
    spark = vectors.sparkSession
    epsilon = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    rows = numbered(vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector")))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    sound = F.coalesce(F.col("label").isNotNull() & ~bad & some, F.lit(False))
    rows = rows.withColumn("sound", sound)
    classes = (
        rows.filter("sound")
        .groupBy("label", "vector")
        .agg(F.min("_row").alias("node"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    )
    classes = stored(classes)
    width = classes.agg(F.max(F.size("vector"))).first()[0]
    if width is None:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    axes = principal_axes(classes, width)
    if axes.shape[1] < AXES:
        axes = np.hstack([axes, np.zeros((width, AXES - axes.shape[1]))])
    blocks = stored(_blocks(_projected(classes.select("node", "label", "copies", "vector"), axes, epsilon)))
    pairs = block_pairs(blocks, epsilon)
    payload = ["nodes", "labels", "copies", "widths", "vectors"]
    left = blocks.select(F.col("block").alias("i"), F.struct(*payload).alias("left"))
    right = blocks.select(F.col("block").alias("j"), F.struct(*payload).alias("right"))
    work = pairs.join(left, "i").join(right, "j").repartition(F.xxhash64("i", "j"))

    def opened(column: pa.StructArray, row: int) -> dict:
        def values(name: str) -> np.ndarray:
            part = column.field(name)[row]
            return part.values.to_numpy(zero_copy_only=False)

        widths = values("widths")
        units = _units(pd.Series(np.split(values("vectors"), np.cumsum(widths)[:-1])), width)
        out = {k: values(k) for k in ("nodes", "labels", "copies")}
        return out | {"widths": widths, "units": units, "at": units @ axes}

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                i, j = batch["i"][row].as_py(), batch["j"][row].as_py()
                a, b = opened(batch["left"], row), opened(batch["right"], row)
                count_a, count_b = np.zeros(len(a["nodes"]), np.int64), np.zeros(len(b["nodes"]), np.int64)
                forest = _Forest(np.concatenate([a["nodes"], b["nodes"]]))
                for p, q in _matches(a, b, threshold, epsilon, i == j):
                    np.add.at(count_a, p, b["copies"][q])
                    np.add.at(count_b, q, a["copies"][p])
                    forest.link(a["nodes"][p], b["nodes"][q])
                nodes = np.concatenate([a["nodes"], b["nodes"]])
                count = np.concatenate([count_a, count_b])
                links = np.array(forest.kept, dtype=np.int64).reshape(-1, 2)
                hit = count > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([nodes[hit], links[:, 0]])),
                        pa.array(np.concatenate([count[hit], np.zeros(len(links), np.int64)])),
                        pa.array([None] * int(hit.sum()) + links[:, 1].tolist(), type=pa.int64()),
                    ],
                    names=["node", "n", "other"],
                )

    found = stored(work.mapInArrow(multiply, "node bigint, n bigint, other bigint"))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    parts = components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = (
        classes.select("label", "vector", "node", "copies", "first_id")
        .join(counts, "node", "left")
        .join(parts, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    names = known.groupBy("component").agg(F.min("first_id").alias("component_id"))
    total = (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("n_links")
    known = stored(known.join(names, "component").select("label", "vector", total, "component_id"))
    own = rows.filter("sound").join(known, ["label", "vector"])
    alone = rows.filter("not sound").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = own.select("vec_id", "n_links", "component_id").union(alone)
    return both.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


class _Forest:
    """Keeps the links that join parts of a block pair not joined before."""

    def __init__(self, nodes: np.ndarray) -> None:
        self.order = np.unique(nodes)
        self.label = np.arange(len(self.order))
        self.kept: list[tuple[int, int]] = []

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        p, q = np.searchsorted(self.order, a), np.searchsorted(self.order, b)
        while True:
            apart = np.flatnonzero(self.label[p] != self.label[q])
            if not len(apart):
                return
            p, q = p[apart], q[apart]
            low, high = np.minimum(self.label[p], self.label[q]), np.maximum(self.label[p], self.label[q])
            _, first = np.unique(high, return_index=True)  # each part joins one other at a time
            swap = np.arange(len(self.order))
            swap[high[first]] = low[first]
            while (swap[swap] != swap).any():
                swap = swap[swap]
            self.kept += list(zip(self.order[p[first]].tolist(), self.order[q[first]].tolist(), strict=True))
            self.label = swap[self.label]
