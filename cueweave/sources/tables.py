"""Canonical words from tables of spoken turns or documents.

For corpora that hold text but no timings, each token gets a deterministic duration
and pause from its position, in whole milliseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueweave.operators.arrays import unnest
from cueweave.operators.ordered import KEY, dealt, scan
from cueweave.operators.words import WORD_COLUMNS
from cueweave.schemas import DEFAULT_LIMITS, Limits

_TURN_BLOCKS = Limits(block_rows=1_024)


def _pause_ms(mix: Column) -> Column:
    # Fixed values.
    h = mix % 17
    return (
        F.when(h == 0, 2000).when(h == 1, 1000).when(h == 2, 700).when(h == 3, 800).otherwise(40)
    )


def _stretch_ms(token: Column, idx: Column) -> Column:
    # Fixed values.
    long_token = F.length(token) >= 4
    return (
        F.when(long_token & (idx % 11 == 5), 760).when(long_token & (idx % 11 == 8), 1200).otherwise(0)
    )


def _tokens(text: str) -> Column:
    return F.filter(F.split(F.col(text), r"[ \t\r\n]+"), lambda t: t != "")


def has_oversize(
    turns: DataFrame, recording: str, text: str, limits: Limits = DEFAULT_LIMITS
) -> bool:
    """Whether any recording has more words than one task may hold; counts only."""
    sizes = turns.groupBy(recording).agg(F.sum(F.size(_tokens(text))).alias("_n"))
    return not sizes.filter(F.col("_n") > limits.recording_words).isEmpty()


def words_from_turns(
    turns: DataFrame, recording: str, turn: str | None, speaker: str, text: str, prefix: str = ""
) -> DataFrame:
    """Words of every recording, its turns put one after the other.

    Positions and times run through the whole recording.  They are summed per turn
    first, then across turns in blocks, and only then within a turn, so a recording
    with very many turns never gathers in one task.  ``turn=None``: one turn each.
    """
    base = turns.select(
        F.concat(F.lit(prefix), F.col(recording).cast("string")).alias(KEY),
        F.col(recording).cast("bigint").alias("_key"),
        (F.lit(0) if turn is None else F.col(turn)).cast("bigint").alias("_turn"),
        F.col(speaker).alias("speaker"),
        _tokens(text).alias("_tokens"),
    ).withColumn("_n", F.size("_tokens").cast("bigint"))

    if turn is None:
        placed = base.withColumns({"_before": F.lit(0).cast("bigint"), "n_words": F.col("_n")})
    else:
        placed = scan(
            base,
            "_turn",
            running={"_so_far": F.col("_n")},
            total={"n_words": F.col("_n")},
            limits=_TURN_BLOCKS,
            cut_lineage=False,
        ).withColumn("_before", F.col("_so_far") - F.col("_n"))

    def step_ms(token: Column, pos: Column) -> Column:
        spoken = 60 + 35 * F.length(token) + _stretch_ms(token, F.col("_before") + pos)
        return spoken + _pause_ms(F.col("_key") * 7 + F.col("_turn") * 13 + pos * 29)

    if turn is None:
        placed = placed.withColumn("_ms_before", F.lit(0).cast("bigint"))
    else:
        ms = F.aggregate(
            F.transform("_tokens", step_ms), F.lit(0).cast("bigint"), lambda total, step: total + step
        )
        placed = scan(
            placed.withColumn("_ms", ms),
            "_turn",
            running={"_ms_so_far": F.col("_ms")},
            limits=_TURN_BLOCKS,
            cut_lineage=False,
        ).withColumn("_ms_before", F.col("_ms_so_far") - F.col("_ms"))

    keep = [KEY, "n_words", "_key", "_turn", "speaker", "_before", "_ms_before"]
    words = unnest(placed, keep, "_tokens", "text", "_pos")
    words = (dealt(words, KEY) if turn is None else words).withColumn(
        "idx", F.col("_before") + F.col("_pos")
    )
    words = words.withColumns(
        {
            "pause": _pause_ms(F.col("_key") * 7 + F.col("_turn") * 13 + F.col("_pos") * 29),
            "stretch": _stretch_ms(F.col("text"), F.col("idx")),
        }
    ).withColumn("spoken", 60 + 35 * F.length("text") + F.col("stretch"))
    in_turn = Window.partitionBy(KEY, "_turn").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    end_ms = F.col("_ms_before") + F.sum(F.col("pause") + F.col("spoken")).over(in_turn)
    timed_words = words.withColumn("_end_ms", end_ms).withColumn(
        "_start_ms", F.col("_end_ms") - F.col("spoken")
    )
    length = F.length("text")

    def character(letter: Column, at: Column) -> Column:
        start = F.col("_start_ms") + F.when(at == 0, 0).otherwise(60 + 35 * at)
        end = (
            F.col("_start_ms")
            + 60
            + 35 * (at + 1)
            + F.when(at + 1 == length, F.col("stretch")).otherwise(0)
        )
        return F.struct(
            letter.alias("text"), (start / 1000.0).alias("start"), (end / 1000.0).alias("end")
        )

    return timed_words.select(
        KEY,
        "n_words",
        "idx",
        F.lit("word").alias("type"),
        "text",
        (F.col("_start_ms") / 1000.0).alias("start"),
        (F.col("_end_ms") / 1000.0).alias("end"),
        "speaker",
        F.transform(
            F.transform(
                F.sequence(F.lit(1), length), lambda i: F.substr("text", i, F.lit(1))
            ),
            character,
        ).alias("characters"),
    )


def with_punctuation_tokens(words: DataFrame) -> DataFrame:
    """Split a closing punctuation mark off every fifth word into its own token.

    Positions are doubled to make room; the new token has no length in time.
    """
    marked = F.col("text").rlike(r"^.+[.,;:!?…]$") & (F.col("idx") % 5 == 0)
    size = F.length("text")
    word = F.struct(
        (F.col("idx") * 2).alias("idx"),
        F.lit("word").alias("type"),
        F.when(marked, F.left("text", size - 1)).otherwise(F.col("text")).alias("text"),
        "start",
        "end",
    )
    mark = F.struct(
        (F.col("idx") * 2 + 1).alias("idx"),
        F.lit("punctuation").alias("type"),
        F.right("text", F.lit(1)).alias("text"),
        F.col("end").alias("start"),
        "end",
    )
    both = F.when(marked, F.array(word, mark)).otherwise(F.array(word))
    keep = [KEY, "n_words", "speaker", "characters"]
    return unnest(words, keep, both, "_token").select(*keep, "_token.*").select(*WORD_COLUMNS)
