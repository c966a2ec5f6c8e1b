"""Subtitle files as whole texts and as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueweave.functions.subtitles import cyrillic_file_name
from cueweave.operators.subtitles import text_lines
from cueweave.sources.files import choose_names, decoded, not_empty, resolve


def read_subtitles(spark: SparkSession, path: str, glob: str = "*_latin.srt") -> DataFrame:
    """``file_id, file_name, cyrillic_name, srt_text``, one row per file."""
    folder, wanted, pattern = resolve(spark, path, glob)
    source = spark.read.option("pathGlobFilter", wanted) if wanted else spark.read
    named = source.text(folder, wholetext=True).select(
        decoded(F.col("_metadata.file_path")).alias("file_id"),
        decoded(F.col("_metadata.file_name")).alias("file_name"),
        F.col("value").alias("srt_text"),
    )
    chosen = not_empty(choose_names(named, F.col("file_name"), (".srt",), pattern), "SRT", path)
    return chosen.select(
        "file_id", "file_name", cyrillic_file_name(F.col("file_name")).alias("cyrillic_name"), "srt_text"
    )


def read_subtitle_lines(spark: SparkSession, path: str, glob: str = "*_latin.srt") -> DataFrame:
    """``file_id, line_no, line``."""
    return text_lines(read_subtitles(spark, path, glob), "srt_text", "file_id")
