"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parts(files: DataFrame, path: str, keys: tuple[str, ...], text: str, part: str = "part_no") -> None:
    """Write file parts as one folder per file and part; parts in order are the file.

    Rows are spread by key and part, so a large file is not written by one task.  A
    line end closes every part, so an empty file holds just that.
    """
    body = F.regexp_replace(F.col(text), r"\n\z", "").alias("value")
    spread = files.repartition(*keys, part).select(*keys, part, body)
    spread.write.mode("overwrite").partitionBy(*keys, part).text(path)


def write_table(df: DataFrame, path: str, *by: str) -> None:
    """Write any result as Parquet, partitioned by low-cardinality columns."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_combined(lines: DataFrame, path: str, single_file: bool = False) -> None:
    """Write ordered lines; part files in name order are the text.

    ``single_file`` gathers everything in one task and is meant for small results.
    """
    lines = lines.coalesce(1) if single_file else lines
    lines.select("line").write.mode("overwrite").text(path)
