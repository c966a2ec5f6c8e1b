"""Pauses hidden in a word whose last spoken character was stretched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
MIN_STRETCH = 0.35
MIN_SHARE = 0.45
MIN_EXCESS = 0.18
RATIO_TO_MAX = 2.5
RATIO_TO_MEDIAN = 4.0
KEEP_OF_MAX = 1.25
KEEP_OF_MEDIAN = 2.0
KEEP_LEAST = 0.16
KEEP_MOST = 0.30
PAUSE_SECONDS = 0.6

_SPOKEN = r"[\p{L}\p{N}]"


def is_spoken(text: Column) -> Column:
    """True where the text has a letter or a number."""
    return F.coalesce(text.rlike(_SPOKEN), F.lit(False))


def _median(sorted_values: Column) -> Column:
    size = F.size(sorted_values)
    upper = F.element_at(sorted_values, F.floor(size / 2).cast("int") + 1)
    lower = F.element_at(sorted_values, F.greatest(F.floor(size / 2).cast("int"), F.lit(1)))
    return F.when(size % 2 == 1, upper).otherwise((lower + upper) / 2)


def with_pauses(words: DataFrame, detect: bool = True) -> DataFrame:
    """Add ``speech_end`` (end without the hidden pause) and ``pause_gap`` (seconds cut).

    Works inside each row on ``characters``: no explode, no shuffle.  With
    ``detect=False`` the end stays as recorded and ``characters`` is never read.
    """
    if not detect:
        return words.withColumns({"speech_end": F.col("end"), "pause_gap": F.lit(0.0)})

    # One staged projection per intermediate value, so each is computed once.
    spoken = F.filter(
        F.transform(
            "characters",
            lambda c: F.struct(
                c["start"].alias("start"),
                c["end"].alias("end"),
                F.greatest(c["end"] - c["start"], F.lit(0.0)).alias("seconds"),
                is_spoken(c["text"]).alias("spoken"),
            ),
        ),
        lambda c: c["spoken"] & (c["seconds"] > 0),
    )
    staged = words.withColumn("_spoken", F.when(F.size("characters") >= 3, spoken))
    staged = staged.withColumn(
        "_before",
        F.when(
            F.size("_spoken") >= 3,
            F.array_sort(
                F.transform(
                    F.slice("_spoken", F.lit(1), F.size("_spoken") - 1),
                    lambda c: c["seconds"],
                )
            ),
        ),
    )
    staged = staged.withColumn(
        "_shape",
        F.when(
            F.col("_before").isNotNull(),
            F.struct(
                F.element_at("_spoken", -1).alias("anchor"),
                F.element_at("_before", -1).alias("longest"),
                _median(F.col("_before")).alias("median"),
                F.coalesce("start", F.col("characters")[0]["start"]).alias("word_start"),
            ),
        ),
    )
    anchor = F.col("_shape.anchor")
    longest, median = F.col("_shape.longest"), F.col("_shape.median")
    word_start = F.col("_shape.word_start")
    span = anchor["end"] - word_start
    seconds = anchor["seconds"]
    stretched = (
        (span > 0)
        & (seconds >= MIN_STRETCH)
        & (seconds / F.when(span > 0, span) >= MIN_SHARE)
        & (seconds - longest >= MIN_EXCESS)
        & ((seconds >= longest * RATIO_TO_MAX) | (seconds >= median * RATIO_TO_MEDIAN))
    )
    kept = F.least(
        F.lit(KEEP_MOST),
        F.greatest(F.lit(KEEP_LEAST), longest * KEEP_OF_MAX, median * KEEP_OF_MEDIAN),
    )
    cut = anchor["start"] + F.least(seconds, kept)
    staged = staged.withColumn("_cut", F.when(stretched, cut))
    valid_cut = F.when(
        (F.col("_cut") < anchor["end"]) & (F.col("_cut") > word_start), F.col("_cut")
    )
    staged = staged.withColumn("_cut", valid_cut)
    first_moment = F.coalesce("start", F.lit(0.0))
    return staged.withColumns(
        {
            "speech_end": F.when(
                F.col("_cut").isNotNull(),
                F.greatest(first_moment, F.least(F.col("end"), F.col("_cut"))),
            ).otherwise(F.col("end")),
            "pause_gap": F.when(
                F.col("_cut").isNotNull(),
                F.greatest(F.col("end") - F.col("_cut"), F.lit(0.0)),
            ).otherwise(F.lit(0.0)),
        }
    ).drop("_spoken", "_before", "_shape", "_cut")
