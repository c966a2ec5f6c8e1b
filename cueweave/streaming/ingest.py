"""Transcripts as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cueweave.sources.transcripts import parsed, quarantine, readable


def stream_transcripts(spark: SparkSession, folder: str, glob: str = "*.json") -> DataFrame:
    """New transcript files of a folder, shaped as ``read_transcripts`` gives them."""
    files = spark.readStream.option("pathGlobFilter", glob).text(folder, wholetext=True)
    return parsed(files).drop("file_name", "raw")


def run_incrementally(
    transcripts: DataFrame,
    jobs: dict[str, Callable[[DataFrame], DataFrame]],
    out: str,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Run batch jobs on every micro-batch of new transcripts.

    Each job's result goes to ``out/<name>/batch_id=<n>``, unreadable transcripts to
    ``out/quarantine``.  A batch that is run again after a failure overwrites its own
    folder, so results come exactly once.  The jobs order words by position, which
    streams cannot do, hence micro-batches; a recording arrives in one file, so none
    is split over batches.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            good = readable(batch)
            results = {name: job(good) for name, job in jobs.items()}
            results["quarantine"] = quarantine(batch)
            for name, result in results.items():
                result.write.mode("overwrite").parquet(f"{out}/{name}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    writer = transcripts.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
