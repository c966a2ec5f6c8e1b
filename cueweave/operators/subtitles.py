"""Cues rendered as subtitle text, and subtitle text as lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueweave.functions.script import to_cyrillic, to_latin
from cueweave.functions.subtitles import LINE_ENDS, subtitle_line_to_cyrillic, wrap_two_lines
from cueweave.functions.text import clean_text, tidy_spaces
from cueweave.functions.timecode import srt_time_range
from cueweave.operators.arrays import unnest
from cueweave.operators.ordered import KEY
from cueweave.schemas import LINE_CHARS

Transform = Callable[[Column], Column]
PART_CUES = 1_000


def _blocks(cues: DataFrame, text: Column) -> DataFrame:
    """One text block per cue; all blocks of a recording in order are its file."""
    lead = F.when(F.col("cue_no") > 1, F.lit("\n")).otherwise("")
    block = F.concat(
        lead,
        F.concat_ws(
            "\n", F.col("cue_no").cast("string"), srt_time_range(F.col("start"), F.col("end")), text, F.lit("")
        ),
    )
    return cues.withColumn("block", block).select(*[c for c in cues.columns if c == "variant"], KEY, "cue_no", "block")


def standard_blocks(cues: DataFrame, transform: Transform | None = None) -> DataFrame:
    """Two lines of 42 characters; ``transform`` is applied to the text first."""
    text = F.col("text") if transform is None else F.col("_text")
    if transform is not None:
        cues = cues.withColumn("_text", tidy_spaces(transform(F.col("text"))))
    return _blocks(cues, wrap_two_lines(text, LINE_CHARS))


def numbered_blocks(cues: DataFrame) -> DataFrame:
    """The cue's number in place of its text."""
    return _blocks(cues, F.col("cue_no").cast("string"))


def basic_blocks(cues: DataFrame) -> DataFrame:
    """The text as it is."""
    return _blocks(cues, F.col("text"))


def social_blocks(cues: DataFrame, transform: Transform | None = None) -> DataFrame:
    """The text on one line, without wrapping."""
    line = tidy_spaces(F.col("text"))
    return _blocks(cues, line if transform is None else tidy_spaces(transform(line)))


def social_variants(
    cues: DataFrame,
    variants: tuple[str, ...] = ("cyrillic", "latin", "raw"),
    clean: bool = False,
    transform: Transform | None = None,
) -> DataFrame:
    """Blocks of several script variants from one set of cues: ``variant, ...``.

    The cues are built once; each row is repeated per variant and rewritten in place.
    A ``transform`` of one's own comes after the clean-up and before the script.
    """
    each = cues.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in variants])))

    def rewritten(text: Column) -> Column:
        text = clean_text(text) if clean else text
        text = text if transform is None else transform(text)
        return (
            F.when(F.col("variant") == "cyrillic", to_cyrillic(text))
            .when(F.col("variant") == "latin", to_latin(text))
            .otherwise(text)
        )

    return social_blocks(each, rewritten)


def subtitle_files(
    blocks: DataFrame, recordings: DataFrame | None = None, part_cues: int = PART_CUES
) -> DataFrame:
    """``transcript_id, part_no, srt_text``: the parts, in order, are the file.

    A part holds at most ``part_cues`` cues, so no task has to hold a whole file.
    With ``recordings`` those without cues get one empty part.
    """
    keys = [c for c in ("variant", KEY) if c in blocks.columns]
    part = F.floor((F.col("cue_no") - 1) / part_cues).cast("bigint")
    ordered = F.array_sort(F.collect_list(F.struct("cue_no", "block")))
    files = (
        blocks.withColumn("part_no", part)
        .groupBy(*keys, "part_no")
        .agg(F.array_join(F.transform(ordered, lambda b: b["block"]), "").alias("srt_text"))
    )
    if recordings is None:
        return files
    wanted = recordings.select(*keys).distinct()
    return wanted.join(files, keys, "left").select(
        *keys,
        F.coalesce("part_no", F.lit(0)).cast("bigint").alias("part_no"),
        F.coalesce("srt_text", F.lit("")).alias("srt_text"),
    )


def text_lines(files: DataFrame, text: str, *keys: str) -> DataFrame:
    """``keys..., line_no, line`` of whole texts; a final line end opens no new line."""
    lines = F.split(F.col(text), LINE_ENDS)
    trimmed = F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(
        lines
    )
    exploded = unnest(files, list(keys), trimmed, "line", "_at")
    return exploded.select(*keys, (F.col("_at") + 1).cast("bigint").alias("line_no"), "line")


def lines_to_cyrillic(lines: DataFrame, line: str = "line") -> DataFrame:
    """Subtitle lines in Cyrillic letters; narrow, the same on a stream."""
    return lines.withColumn(line, subtitle_line_to_cyrillic(F.col(line)))


def files_to_cyrillic(files: DataFrame, text: str) -> DataFrame:
    """Whole subtitle texts in Cyrillic letters, line by line inside the row."""
    lines = F.split(F.col(text), LINE_ENDS)
    closing = F.col(text).rlike(r"[\r\n]\z")
    body = F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(
        lines
    )
    joined = F.array_join(F.transform(body, subtitle_line_to_cyrillic), "\n")
    return files.withColumn(text, F.concat(joined, F.when(closing, "\n").otherwise("")))
