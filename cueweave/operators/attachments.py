"""Files that came along inside transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueweave.functions.text import strip_space
from cueweave.operators.arrays import unnest


def _named(value: Column) -> Column:
    return F.lower(strip_space(F.coalesce(value, F.lit(""))))


def attachments(
    transcripts: DataFrame, json_dir: str = "json", srt_dir: str | None = None, txt_dir: str | None = None
) -> DataFrame:
    """``transcript_id, stem, pos, requested_format, extension, out_path, content`` (binary).

    Items without an extension or content are left out.
    """
    keys = ["transcript_id", "stem"]
    items = unnest(transcripts, keys, "additional_formats", "_item", "pos").select(*keys, "pos", "_item.*")
    requested = _named(F.col("requested_format"))
    extension = F.regexp_replace(_named(F.col("file_extension")), r"^\.+", "")
    kept = items.withColumns(
        {"requested_format": requested, "extension": F.coalesce(F.nullif(extension, F.lit("")), requested)}
    ).filter((F.col("extension") != "") & F.col("content").isNotNull())
    asked, ending = F.col("requested_format"), F.col("extension")

    def at(folder: str, *rest: Column | str) -> Column:
        return F.concat(F.lit(f"{folder}/"), F.col("stem"), *[F.lit(r) if isinstance(r, str) else r for r in rest])

    out_path = (
        F.when((asked == "srt") | (ending == "srt"), at(srt_dir or json_dir, ".srt"))
        .when((asked == "txt") | (ending == "txt"), at(txt_dir or json_dir, ".txt"))
        .when(asked == "segmented_json", at(json_dir, ".segmented.json"))
        .when((ending == "json") & ~asked.isin("", "json"), at(json_dir, ".", asked, ".json"))
        .otherwise(at(json_dir, ".", ending))
    )
    encoded = F.coalesce("is_base64_encoded", F.lit(False))
    content = F.when(encoded, F.unbase64("content")).otherwise(F.encode("content", "UTF-8"))
    return kept.select(
        "transcript_id",
        "stem",
        F.col("pos").cast("bigint").alias("pos"),
        "requested_format",
        "extension",
        out_path.alias("out_path"),
        content.alias("content"),
    )


def last_per_path(items: DataFrame) -> DataFrame:
    """What remains when items are written one after the other: the last per path.

    Order is by transcript, then position.  Paths written more than once are found on
    keys alone.  They are few, so Spark can send them to the contents rather than
    move the contents.
    """
    clashes = (
        items.groupBy("out_path")
        .agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("transcript_id", "pos")).alias("_last"))
        .filter("_n > 1")
        .select("out_path", "_last")
    )
    kept = F.col("_last").isNull() | (F.struct("transcript_id", "pos") == F.col("_last"))
    return items.join(clashes, "out_path", "left").filter(kept).select(*items.columns)


def supplied_formats(items: DataFrame) -> DataFrame:
    """``transcript_id, format, out_path``: the path last written for each format name.

    An item answers to its extension and to the format that was asked for.
    """
    names = F.array_distinct(
        F.array_remove(F.array(F.col("extension"), F.col("requested_format")), "")
    )
    named = items.select("transcript_id", "pos", "out_path", F.explode(names).alias("format"))
    return named.groupBy("transcript_id", "format").agg(F.max_by("out_path", "pos").alias("out_path"))


def without_supplied(transcripts: DataFrame, supplied: DataFrame, wanted: str) -> DataFrame:
    """Transcripts for which the ``wanted`` format did not come along."""
    have = supplied.filter(F.col("format") == wanted).select("transcript_id")
    return transcripts.join(have, "transcript_id", "left_anti")
