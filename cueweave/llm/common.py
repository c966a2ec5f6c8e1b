"""What several of these operators need: tables in the shared folder, running totals, components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word contracts: space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local session may do without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        folder = tempfile.mkdtemp(prefix="cueweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder: lineage is cut, and a lost executor loses nothing."""
    path = f"{shared_folder(df.sparkSession)}/llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame) -> DataFrame:
    """A stored copy with ``_row``, which tells repeated rows and missing ids apart."""
    return stored(df.withColumn("_row", F.monotonically_increasing_id()))


def release_shuffles(spark: SparkSession) -> None:
    """Ask for the removal of shuffle files that no frame refers to any more.

    Spark removes them once the driver's heap is collected, which may be long after
    the results have been stored.  Python tells the JVM of frames it has dropped in the
    background, and the removal runs in the background too, hence twice.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    return F.coalesce(F.size(words), F.lit(0)).cast("bigint")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts, so that a task holds only a part as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def running_totals(
    df: DataFrame,
    groups: list[str],
    order: list[str],
    value: str,
    name: str,
    ties: tuple[str, ...] = (),
    buckets: int = 1024,
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over earlier rows of the group, in hashed order.

    ``ties`` order rows that are equal in ``order``; they have no say otherwise.  Rows go by a hash of ``order`` to buckets, each summed in a task of its own; what
    precedes a bucket comes from a table of one row per group and bucket.  No group,
    however hot, gathers in one task.
    """
    mixed = df.withColumn("_hash", F.xxhash64(*order)).withColumn("_bucket", F.pmod("_hash", F.lit(buckets)))
    keys = [*groups, "_bucket"]
    inside = Window.partitionBy(*keys).orderBy("_hash", *order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        mixed.groupBy(*keys)
        .agg(F.sum(value).alias("_sum"))
        .select(*keys, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    )
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = mixed.withColumn("_inside", F.sum(value).over(inside) - F.col(value)).alias("a")
    return joined.join(before.alias("b"), same).select(
        *[F.col(f"a.{c}") for c in df.columns], (F.col("_inside") + F.col("_before")).alias(name)
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a, b): (node, component), the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., "Connected Components
    in MapReduce and Beyond", 2014) until the links no longer change; each step is
    stored.  Only nodes that have a link to another node appear.  Nulls link nothing.
    """
    links = stored(edges.select("a", "b").filter("a <> b").distinct())
    if links.isEmpty():
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    before = None
    while True:
        links = stored(_small_star(_large_star(links)))
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                links.select("b", "b").distinct()
            )
        before = now


def _large_star(links: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least).distinct()
