"""Who speaks: talk time, ranking, renaming, main speaker."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueweave.operators.ordered import KEY


def talk_seconds() -> Column:
    """Seconds a word takes, from ``start`` and ``end``.

    They are decimals, so that the order in which partial sums meet cannot change a tie.
    """
    begin = F.coalesce("start", F.lit(0.0))
    finish = F.when(F.col("end") == 0, begin).otherwise(F.col("end"))
    return F.greatest(finish - begin, F.lit(0.0)).cast("decimal(18,6)")


def speaker_stats(words: DataFrame) -> DataFrame:
    """Talk time, word count and first position per recording and speaker."""
    return (
        words.filter((F.col("type") == "word") & (F.col("speaker") != ""))
        .groupBy(KEY, "speaker")
        .agg(
            F.sum(talk_seconds()).alias("seconds"),
            F.count(F.lit(1)).alias("n_spoken"),
            F.min("idx").alias("first_idx"),
        )
    )


def rank_label(rank: Callable[[], Column]) -> Column:
    """``speaker_0``, ``speaker_1``, ... by talk time, words, first seen, within a recording."""
    order = Window.partitionBy(KEY).orderBy(F.col("seconds").desc(), F.col("n_spoken").desc(), F.col("first_idx"))
    return F.concat(F.lit("speaker_"), rank().over(order) - 1)


def speaker_remap(words: DataFrame) -> DataFrame:
    """``speaker`` -> ``speaker_0``, ``speaker_1``, ... by talk time, words, first seen."""
    return speaker_stats(words).select(KEY, "speaker", rank_label(F.row_number).alias("label"))


def remap_speakers(sentences: DataFrame, remap: DataFrame) -> DataFrame:
    """Put the new labels on sentences; a speaker without one keeps the name."""
    labels = remap.select(KEY, "speaker", "label")
    return sentences.join(labels, [KEY, "speaker"], "left").select(
        *[
            F.coalesce("label", "speaker").alias("speaker") if c == "speaker" else F.col(c)
            for c in sentences.columns
        ]
    )


def _first_parts(sentences: DataFrame) -> DataFrame:
    """One row per sentence, where long ones come in parts."""
    if "part_no" not in sentences.columns:
        return sentences
    # The partition id keeps the filter behind the exchange that the sentences come from.
    return sentences.filter(F.when(F.spark_partition_id() >= 0, F.col("part_no") == 0))


def main_speakers(sentences: DataFrame, like_texts: bool = False) -> DataFrame:
    """Per recording the speaker with most sentences; the earlier one on a tie.

    ``like_texts`` is for those who go on with the texts too: every column is read, so that both looks
    at the sentences read one exchange, and sentences are made once.
    """
    whole = [F.max(F.xxhash64(*sentences.columns)).alias("_whole")] if like_texts else []
    counted = (
        _first_parts(sentences.filter(F.col("speaker") != ""))
        .groupBy(KEY, "speaker")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("sent_no").alias("_first"), *whole)
    )
    counted = counted.filter(F.col("_whole").isNotNull()) if like_texts else counted
    return counted.groupBy(KEY).agg(
        F.max_by("speaker", F.struct("_n", -F.col("_first"))).alias("main_speaker")
    )


def sentence_line(text: Column, speaker: Column, main: Column | None, tag_all: bool = False) -> Column:
    """A sentence with ``[speaker]`` before it where the speaker is to be shown."""
    text, named = F.coalesce(text, F.lit("")), F.coalesce(speaker != "", F.lit(False))
    tagged = F.concat(F.lit("["), speaker, F.lit("] "), text)
    if tag_all:
        return F.when(named, tagged).otherwise(text)
    if main is None:
        return text
    other = F.coalesce((main != "") & (speaker != main), F.lit(False))
    return F.when(named & other, tagged).otherwise(text)


def tagged_lines(sentences: DataFrame, tag_all: bool = False, hide_speakers: bool = False) -> DataFrame:
    """``transcript_id, sent_no, line``, with ``part_no`` where sentences come in parts.

    The main speaker's sentences stay untagged; of a sentence in parts, the first is tagged.

    ``hide_speakers`` is the setting of the ready-made outputs: no tag at all.
    """
    kept = [c for c in (KEY, "sent_no", "part_no") if c in sentences.columns]
    main = None
    if not hide_speakers and not tag_all:
        sentences = sentences.join(main_speakers(sentences, like_texts=True), KEY, "left")
        main = F.col("main_speaker")
    line = sentence_line(F.col("text"), F.col("speaker"), main, tag_all)
    if "part_no" in kept:
        line = F.when(F.col("part_no") == 0, line).otherwise(F.col("text"))
    return sentences.select(*kept, line.alias("line"))
