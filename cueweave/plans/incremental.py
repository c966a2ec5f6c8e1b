"""Doing only what is not done yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expected_outputs(
    recordings: DataFrame, json_dir: str = "json", srt_dir: str | None = None, txt_dir: str | None = None
) -> DataFrame:
    """``transcript_id, out_path``: the files each recording should end up with."""
    wanted = [(json_dir, ".json"), (srt_dir, ".srt"), (txt_dir, ".txt")]
    paths = [
        F.concat(F.lit(f"{folder}/"), F.col("stem"), F.lit(ending))
        for folder, ending in wanted
        if folder is not None
    ]
    return recordings.select("transcript_id", F.explode(F.array(*paths)).alias("out_path"))


def pending(
    recordings: DataFrame,
    existing: DataFrame,
    json_dir: str = "json",
    srt_dir: str | None = None,
    txt_dir: str | None = None,
    overwrite: bool = False,
) -> DataFrame:
    """Recordings with at least one output missing from ``existing`` (``out_path``)."""
    if overwrite:
        return recordings
    expected = expected_outputs(recordings, json_dir, srt_dir, txt_dir)
    missing = expected.join(existing.select("out_path"), "out_path", "left_anti")
    return recordings.join(missing.select("transcript_id"), "transcript_id", "left_semi")
