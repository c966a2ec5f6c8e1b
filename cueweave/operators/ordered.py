"""Looking back, looking ahead and counting along a recording.

Two ways of doing the same thing, chosen by the size of the recording:

* whole: plain windows, one partition per recording;
* blocked: windows inside blocks of consecutive positions, plus what each block
  needs to know about the earlier (or next) ones.  That carry-over is one small row
  per block, so even a recording holding a third of the corpus is spread over as
  many tasks as it has blocks.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueweave.schemas import DEFAULT_LIMITS, Limits

KEY = "transcript_id"
Pick = tuple[Column, Column | None]  # value, and which rows count (None: all)
TASK_BYTES = 2 << 20
MOST_PARTS = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; only a local session may do without a configured one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="cueweave-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the session's checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def bytes_read(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads, as Spark knows them; nothing is run."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def task_parts(df: DataFrame) -> int | None:
    """How many parts the words of ``df`` should be dealt to; None: few, so Spark may choose.

    One task's windows and sorts share its memory, and a sort that is being filled gives nothing back to
    the windows before it.  So the files read, not the session's number of partitions, decide:
    ``TASK_BYTES`` of them are about half a million words.
    """
    parts = -(-bytes_read(df) // TASK_BYTES)
    # Frames that come from no file have a size that Spark makes up.
    return parts if df.sparkSession.sparkContext.defaultParallelism < parts <= MOST_PARTS else None


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in parts that fit a task, where Spark's own choice may not."""
    parts = task_parts(df)
    return df if parts is None else df.repartition(parts, *keys)


def by_size(
    words: DataFrame,
    job: Callable[[DataFrame, Limits | None], DataFrame],
    limits: Limits = DEFAULT_LIMITS,
    oversize: bool | None = None,
) -> DataFrame:
    """Run ``job`` whole on ordinary recordings and blocked on oversize ones.

    ``job`` gets the words and either ``None`` (whole) or the limits (blocked).
    Whether oversize recordings exist is asked once, reading ``n_words`` only; pass
    ``oversize`` when it is known.
    """
    if oversize is False:
        return job(words, None)
    is_big = F.coalesce(F.col("n_words") > limits.recording_words, F.lit(False))
    big = words.filter(is_big)
    if oversize is None:
        oversize = not big.select(KEY).isEmpty()
    ordinary = job(words.filter(~is_big), None)
    return ordinary.unionByName(job(big, limits)) if oversize else ordinary


def scan(
    df: DataFrame,
    order: str,
    *,
    previous: dict[str, Pick] | None = None,
    latest: dict[str, Pick] | None = None,
    following: dict[str, Column] | None = None,
    running: dict[str, Column] | None = None,
    total: dict[str, Column] | None = None,
    limits: Limits | None = None,
    cut_lineage: bool = True,
) -> DataFrame:
    """Add columns read from other rows of the same recording, in ``order``.

    previous  value of the nearest earlier row that counts
    latest    the same, the row itself included
    following value of the next row
    running   sum up to and including the row
    total     sum over the whole recording

    A blocked scan reads its input twice, so it is checkpointed first; leave
    ``cut_lineage`` out for inputs that are cheap to read again.
    """
    previous, latest = previous or {}, latest or {}
    following, running, total = following or {}, running or {}, total or {}
    if limits is None:
        rows = Window.partitionBy(KEY).orderBy(order)
        everything = Window.partitionBy(KEY)
        return df.select(
            "*",
            *_inside(rows, previous, latest, following, running),
            *[F.sum(value).over(everything).alias(name) for name, value in total.items()],
        )

    block = F.floor(F.col(order) / limits.block_rows)
    df = df.withColumn("_block", block)
    df = materialize(df) if cut_lineage else df
    carry = _carry(df, order, previous | latest, following, running, total)
    rows = Window.partitionBy(KEY, "_block").orderBy(order)
    seen = df.select("*", *_inside(rows, previous, latest, following, running, tag="_in_"))
    joined = seen.join(carry, [KEY, "_block"])
    names = [*previous, *latest, *following]
    return joined.select(
        *[c for c in df.columns if c != "_block"],
        *[
            F.when(F.col(f"_in_{n}").isNull(), F.col(f"_far_{n}"))
            .otherwise(F.col(f"_in_{n}"))["value"]
            .alias(n)
            for n in names
        ],
        *[(F.col(f"_in_{n}") + F.col(f"_far_{n}")).alias(n) for n in running],
        *total,
    )


def _boxed(pick: Pick) -> Column:
    """The value in a struct, so a counted NULL differs from a row that does not count."""
    value, counts = pick
    box = F.struct(value.alias("value"))
    return box if counts is None else F.when(counts, box)


def _inside(rows, previous, latest, following, running, tag: str | None = None) -> list[Column]:
    before = rows.rowsBetween(Window.unboundedPreceding, -1)
    so_far = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = {}
    for name, pick in previous.items():
        if pick[1] is None:
            found[name] = F.lag(_boxed(pick)).over(rows)
        else:
            found[name] = F.last(_boxed(pick), ignorenulls=True).over(before)
    for name, pick in latest.items():
        found[name] = F.last(_boxed(pick), ignorenulls=True).over(so_far)
    for name, value in following.items():
        found[name] = F.lead(_boxed((value, None))).over(rows)
    sums = {name: F.sum(value).over(so_far) for name, value in running.items()}
    if tag is None:
        return [c["value"].alias(n) for n, c in found.items()] + [
            c.alias(n) for n, c in sums.items()
        ]
    return [c.alias(tag + n) for n, c in (found | sums).items()]


def _carry(df: DataFrame, order: str, backward, following, running, total) -> DataFrame:
    """One row per block: last counted values and sums before it, first value after it."""
    summary = df.groupBy(KEY, "_block").agg(
        F.count(F.lit(1)).alias("_rows"),
        *[
            F.max_by(_boxed(p), F.when(F.lit(True) if p[1] is None else p[1], F.col(order))).alias(n)
            for n, p in backward.items()
        ],
        *[F.min_by(_boxed((v, None)), F.col(order)).alias(n) for n, v in following.items()],
        *[F.sum(v).alias(n) for n, v in (running | total).items()],
    )
    blocks = Window.partitionBy(KEY).orderBy("_block")
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    return summary.select(
        KEY,
        "_block",
        *[F.last(n, ignorenulls=True).over(earlier).alias(f"_far_{n}") for n in backward],
        *[F.lead(n).over(blocks).alias(f"_far_{n}") for n in following],
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_far_{n}") for n in running],
        *[F.sum(n).over(Window.partitionBy(KEY)).alias(n) for n in total],
    )


def offsets(df: DataFrame, order: list[str], size: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``size`` over all rows before, in one order of the whole frame.

    Rows are sorted by range; a range sums up by itself, and what precedes it comes from one row per
    range, so no task sees the whole frame.  ``order`` must tell rows apart.
    """
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    kept = materialize(ranged)
    ranges = kept.groupBy("_range").agg(F.sum(size).alias("_sum"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per shuffle partition.
    before = ranges.select("_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = kept.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return seen.join(F.broadcast(before), "_range").select(*df.columns, (F.col("_before") + F.col("_inside")).alias(name))
