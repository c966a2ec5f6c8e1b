"""Sharding by jump consistent hashing.

A stable key is a 64-bit number; a linear congruential sequence seeded with it jumps over
shard numbers, and the last one below the number of shards is the key's shard (Lamping and
Veach, "A Fast, Minimal Memory, Consistent Hash Algorithm", 2014).  There is no table of a
ring, a row needs about ln(shards) steps, and where shards are appended a row either stays
or goes to a new shard: the share that moves is the least possible.

Only the keys pass through Python, as Arrow batches of numbers.  Slots (positions in a
shard) come from one range-partitioned sort: rows are counted by shard and range, and what
precedes a range is added up from these counts, so a shard of any size, and a key that any
number of rows have, is spread over as many ranges as it fills.

Defined cases: a null key counts as an empty one, so all such rows share a shard; null text
has no bytes (size 8, crc32 0); repeated rows each have a slot; an empty table has no shards;
columns that are called like an added one are replaced by it, others stay.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueweave.llm.common import stored

#: Fixed values of the published algorithm.
MULTIPLIER = np.uint64(2862933555777941757)
SCALE = float(1 << 31)

#: Columns of ``place``.
PLACED = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def jumps(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard of every key among ``shards``, and the next shard number the key would jump to."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64)
    here, there = np.full(len(state), -1, dtype=np.int64), np.zeros(len(state), dtype=np.int64)
    moving = np.arange(len(state))
    while len(moving):
        here[moving] = there[moving]
        state[moving] = state[moving] * MULTIPLIER + np.uint64(1)
        part = SCALE / ((state[moving] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        there[moving] = ((here[moving] + 1) * part).astype(np.int64)
        moving = moving[there[moving] < shards]
    return here, there


def key_of(*columns: str) -> Column:
    """64 bits that stand for the values of the columns: the beginning of their text's MD5."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    digest = F.md5(F.concat_ws("\x00", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 16), 16, -10).cast("bigint")


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a 64-bit key."""

    @F.pandas_udf("int")
    def work(keys: pd.Series) -> pd.Series:
        return pd.Series(jumps(keys.to_numpy(dtype=np.int64).view(np.uint64), shards)[0].astype(np.int32))

    return work(key)


def shard_and_grown(key: Column, shards: int) -> Column:
    """(shard, grown): the shard of a 64-bit key, and the one it has if one shard is appended."""

    @F.pandas_udf("shard int, grown int")
    def work(keys: pd.Series) -> pd.DataFrame:
        here, there = jumps(keys.to_numpy(dtype=np.int64).view(np.uint64), shards)
        grown = np.where(there == shards, shards, here)
        return pd.DataFrame({"shard": here.astype(np.int32), "grown": grown.astype(np.int32)})

    return work(key)


def assign(df: DataFrame, keys: list[str], shards: int, name: str = "shard") -> DataFrame:
    """Add the shard of every row as ``name``."""
    return df.withColumn(name, shard_of(key_of(*keys), shards))


def moved(df: DataFrame, keys: list[str], before: int, after: int) -> DataFrame:
    """Rows whose shard changes where ``before`` shards become ``after``: all go to new shards.

    Adds ``from_shard`` and ``shard``; this is what has to be copied on growth.
    """
    if after < before:
        raise ValueError("shards can only be appended")
    both = assign(assign(df, keys, before, "from_shard"), keys, after)
    return both.filter("from_shard <> shard")


def with_slots(df: DataFrame, order: list[str], shard: str = "shard") -> DataFrame:
    """Add ``slot``: the position of a row in its shard, from 0 without gaps, in ``order``.

    Rows that are equal in ``order`` are dealt as they were stored.
    """
    kept = [c for c in df.columns if c != "slot"]
    full = stored(df.select(*kept, F.monotonically_increasing_id().alias("_row")))
    by = [shard, *order, "_row"]
    ranges = full.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = stored(ranges.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)))
    earlier = Window.partitionBy(shard).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = (
        placed.groupBy(shard, "_range")
        .agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
        .select(F.col(shard).alias("_s"), F.col("_range").alias("_r"), (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    )
    # At most one row per range and one per shard: shuffle partitions and shards, not rows, bound it.
    same = F.col("_range").eqNullSafe(F.col("_r")) & F.col(shard).eqNullSafe(F.col("_s"))
    return placed.join(F.broadcast(begins), same).select(*kept, (F.col("_at") + F.col("_shift")).alias("slot"))


def place(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Shard and slot of every document, and its shard if one more is appended (law ``key``).

    ``size`` is the bytes of the text and 8 more; slots are in order of id, size and crc32.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(8)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_and_grown(key_of("doc_id"), shards).alias("to"),
    )
    rows = rows.select("doc_id", "size", "text_crc32", "law", F.col("to.shard").alias("shard"), F.col("to.grown").alias("grown_shard"))
    return with_slots(rows, ["doc_id", "size", "text_crc32"]).select(*PLACED)


def write_shards(df: DataFrame, path: str, order: list[str], shard: str = "shard") -> None:
    """Write one folder per shard as Parquet; a large shard has several files, in order.

    ``df`` has shards (``assign``); their slots are added.  A retried task writes its file anew.
    """
    rows = with_slots(df, order, shard)
    rows.repartitionByRange(shard, "slot").sortWithinPartitions(shard, "slot").write.partitionBy(shard).parquet(path)
