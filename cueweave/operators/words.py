"""From transcript rows to word rows, and from word rows to cue tokens.

Canonical words: ``transcript_id, n_words, idx, type, text, start, end, speaker,
characters``.  ``idx`` counts every word of the recording from 0, punctuation
included; ``n_words`` is the recording's word count, repeated on each row so that
oversize recordings can be told apart by a pushed-down filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueweave.functions.pauses import PAUSE_SECONDS, with_pauses
from cueweave.operators.arrays import unnest

WORD_COLUMNS = (
    "transcript_id",
    "n_words",
    "idx",
    "type",
    "text",
    "start",
    "end",
    "speaker",
    "characters",
)


def seconds(value: Column) -> Column:
    """A time given as number or numeric text; NULL when it is neither."""
    text = value.cast("string")
    typed = F.right(text, F.lit(1)).isin("d", "D", "f", "F") & ~F.lower(text).endswith("inf")
    return F.when(~typed, text.try_cast("double"))


def speaker_of(speaker_id: Column, speaker: Column) -> Column:
    """``speaker_id`` if given, else ``speaker``; an empty name is no speaker."""
    return F.nullif(F.coalesce(speaker_id, speaker), F.lit(""))


def _timed(part: Column) -> tuple[Column, Column]:
    """Start and end; a missing start is 0, an unreadable time makes the end 0 too.

    An unreadable start stays NULL: no cue can hold the word.
    """
    start, end = seconds(part["start"]), seconds(part["end"])
    begun = F.when(part["start"].isNull(), F.lit(0.0)).otherwise(start)
    unreadable = begun.isNull() | (part["end"].isNotNull() & end.isNull())
    return begun, F.when(unreadable, F.coalesce(begun, F.lit(0.0))).otherwise(F.coalesce(end, begun))


def words_from_transcripts(transcripts: DataFrame, segments_as_words: bool = False) -> DataFrame:
    """Explode each transcript's words; narrow, no shuffle.

    With ``segments_as_words`` a transcript without words yields its segments, each
    as one word.
    """
    words = F.coalesce(F.col("words"), F.array().cast(transcripts.schema["words"].dataType))
    if segments_as_words:
        as_words = F.transform(
            F.col("segments"),
            lambda s: F.struct(
                F.lit("word").alias("type"),
                s["text"].alias("text"),
                s["start"].alias("start"),
                s["end"].alias("end"),
                F.lit(None).cast("string").alias("speaker_id"),
                F.lit(None).cast("string").alias("speaker"),
                F.lit(None)
                .cast("array<struct<text:string,start:string,end:string>>")
                .alias("characters"),
            ),
        )
        words = F.when(F.size(words) > 0, words).otherwise(as_words)
    listed = transcripts.select("transcript_id", words.alias("_words"))
    size = F.size("_words").cast("bigint").alias("n_words")
    exploded = unnest(listed, ["transcript_id", size], "_words", "_word", "idx")
    word = F.col("_word")
    start, end = _timed(word)

    def character(c: Column) -> Column:
        first = F.coalesce(seconds(c["start"]), F.lit(0.0))
        return F.struct(
            F.coalesce(c["text"], F.lit("")).alias("text"),
            first.alias("start"),
            F.coalesce(seconds(c["end"]), first).alias("end"),
        )

    return exploded.select(
        "transcript_id",
        "n_words",
        F.col("idx").cast("bigint").alias("idx"),
        word["type"].alias("type"),
        word["text"].alias("text"),
        start.alias("start"),
        end.alias("end"),
        speaker_of(word["speaker_id"], word["speaker"]).alias("speaker"),
        F.transform(word["characters"], character).alias("characters"),
    )


def cue_tokens(words: DataFrame, pause_detection: bool = False) -> DataFrame:
    """Spoken tokens with their effective end and a "pause follows" flag.

    Text is kept as it stands.  Words without a readable start are left out here and
    reported by :func:`untimed_words`.
    """
    spoken = words.filter((F.col("type") == "word") & (F.col("text") != ""))
    timed = spoken.filter(F.col("start").isNotNull())
    return with_pauses(timed, pause_detection).select(
        "transcript_id",
        "n_words",
        "idx",
        "text",
        "start",
        F.col("speech_end").alias("end"),
        (F.col("pause_gap") >= PAUSE_SECONDS).alias("pause_after"),
        "speaker",
    )


def untimed_words(words: DataFrame) -> DataFrame:
    """Spoken words that no cue can hold because their start time is unreadable."""
    return words.filter(
        (F.col("type") == "word") & (F.col("text") != "") & F.col("start").isNull()
    ).select("transcript_id", "idx", "text", F.lit("unreadable start").alias("reason"))
