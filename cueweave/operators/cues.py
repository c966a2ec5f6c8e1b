"""Subtitle cues in three profiles.

words -> tokens -> runs (windows) -> packed cues (fold per run) -> short cues merged
-> single-word cues given a companion -> numbered.  Ordinary recordings need one
exchange, by recording, for the whole chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueweave.functions.text import (
    ends_with_soft_stop,
    ends_with_stop,
    strip_token,
    takes_space,
    tidy_token,
)
from cueweave.operators.ordered import KEY, by_size, scan
from cueweave.operators.packing import Packer, pack
from cueweave.operators.words import cue_tokens
from cueweave.schemas import DEFAULT_LIMITS, STANDARD, CueProfile, Limits

TOKEN_COLUMNS = (KEY, "n_words", "idx", "text", "start", "end", "pause_after")


def _packer(profile: CueProfile) -> Packer:
    def opens(state: Column, item: Column, trial) -> Column:
        over = (trial.chars > profile.max_chars) | (trial.seconds > profile.max_seconds)
        if profile.max_words is not None:
            over = over | (trial.words > profile.max_words)
        if profile.soft_chars is not None:
            # A sentence end goes into the open cue whatever the budgets say.
            return over & ~item["hard"]
        if profile.sentence_chars is not None:
            over = over | ((state["chars"] >= profile.sentence_chars) & state["hard"])
        return over

    def closes(soft: Column, trial) -> Column:
        return soft & (
            (trial.chars >= profile.soft_chars)
            | (trial.words >= profile.soft_words)
            | (trial.seconds >= profile.soft_seconds)
        )

    return Packer(profile.max_chars, opens, closes if profile.soft_chars is not None else None)


def _merger(profile: CueProfile) -> Packer:
    return Packer(
        profile.max_chars,
        lambda state, item, trial: (trial.chars > profile.max_chars)
        | (trial.seconds > profile.max_seconds),
    )


def _with_runs(tokens: DataFrame, profile: CueProfile, limits: Limits | None) -> DataFrame:
    """Mark where a new cue must begin, from the tokens before only.

    A run starts after a long gap, or after a shorter one announced by a pause flag.
    The flag's owner differs: the token before (basic), the same but never the
    recording's first token (standard), the last token not ending a sentence (social).
    """
    hard = ends_with_stop(strip_token(F.col("text")))
    tokens = tokens.withColumn("_hard", hard) if profile.breaks_at_stops else tokens
    flag_counts = ~F.col("_hard") if profile.breaks_at_stops else None
    previous = {
        "_end_before": (F.col("end"), None),
        "_pause_before": (F.col("pause_after"), flag_counts),
    }
    if profile.breaks_at_stops:
        previous["_hard_before"] = (F.col("_hard"), None)
    seen = scan(
        tokens, "idx", previous=previous, running={"_nth": F.lit(1)}, limits=limits
    )
    gap = F.col("start") - F.col("_end_before")
    flagged = F.coalesce("_pause_before", F.lit(False))
    if not profile.first_pause_counts:
        flagged = flagged & (F.col("_nth") > 2)
    breaks = (gap > profile.gap_seconds) | (flagged & (gap >= profile.pause_gap_seconds))
    if profile.breaks_at_stops:
        breaks = breaks | F.col("_hard_before")
    seen = seen.withColumn("breaks", F.coalesce(breaks, F.lit(True))).drop(*previous, "_nth", "_hard")
    return scan(seen, "idx", latest={"run": (F.col("idx"), F.col("breaks"))}, limits=limits)


def cue_runs(
    tokens: DataFrame, profile: CueProfile, limits: Limits = DEFAULT_LIMITS, oversize: bool | None = None
) -> DataFrame:
    """Tokens with ``breaks`` and ``run``, the ``idx`` of the first token of their run."""
    tokens = tokens.select(*TOKEN_COLUMNS)
    return by_size(tokens, lambda t, lim: _with_runs(t, profile, lim), limits, oversize)


def _items(tokens: DataFrame, profile: CueProfile) -> DataFrame:
    raw = not profile.tidied
    piece = F.col("text") if raw else tidy_token(F.col("text"))
    with_piece = tokens.select(KEY, F.col("idx").alias("ord"), "run", "start", "end", piece.alias("piece"))
    piece = F.col("piece")
    return with_piece.withColumns(
        {
            "spaced": F.lit(True) if raw else takes_space(piece),
            "hard": ends_with_stop(piece),
            "soft": ends_with_soft_stop(piece),
        }
    )


def _merged(cues: DataFrame, profile: CueProfile, limits: Limits | None) -> DataFrame:
    """Join a short cue to the one before while the budgets allow it."""
    long_enough = F.col("end") - F.col("start") >= profile.min_seconds
    counted = scan(cues, "ord", running={"_nth": F.lit(1)}, limits=limits)
    opens = long_enough | (F.col("_nth") == 1)
    islands = scan(counted, "ord", latest={"run": (F.col("ord"), opens)}, limits=limits)
    items = islands.select(
        KEY,
        "ord",
        "run",
        "start",
        "end",
        F.col("text").alias("piece"),
        takes_space(F.col("text")).alias("spaced"),
        F.lit(False).alias("hard"),
        F.lit(False).alias("soft"),
    )
    return pack(items, _merger(profile), limits)


def _balanced(cues: DataFrame, profile: CueProfile, limits: Limits | None) -> DataFrame:
    """Give a one-word cue the last word of the cue before, if that has three or more.

    A cue that receives a word has at most two, so it never gives one: the decision
    needs the neighbours only.  Times stay.
    """

    def word_count(text: Column) -> Column:
        return F.size(F.split(text, " "))

    text, before = F.col("text"), F.col("_before")
    moved = F.substring_index(before, " ", -1)
    left = F.left(before, F.length(before) - F.length(moved) - 1)
    joined = F.concat(moved, F.when(takes_space(text), " ").otherwise(""), text)
    receives = (
        (word_count(text) == 1)
        & (word_count(before) >= 3)
        & (F.length(left) <= profile.max_chars)
        & (F.length(joined) <= profile.max_chars)
    )
    seen = scan(cues, "ord", previous={"_before": (text, None)}, limits=limits)
    seen = seen.withColumn("_receives", F.coalesce(receives, F.lit(False)))
    seen = scan(seen, "ord", following={"_gives": F.col("_receives")}, limits=limits)
    gives = F.coalesce("_gives", F.lit(False))
    shorter = F.left(text, F.length(text) - F.length(F.substring_index(text, " ", -1)) - 1)
    balanced = F.when(F.col("_receives"), joined).when(gives, shorter).otherwise(text)
    return seen.withColumn("text", balanced).select(KEY, "ord", "start", "end", "text")


def _build(tokens: DataFrame, profile: CueProfile, limits: Limits | None) -> DataFrame:
    cues = pack(_items(_with_runs(tokens, profile, limits), profile), _packer(profile), limits)
    if profile.min_seconds is not None:
        cues = _merged(cues, profile, limits)
    if profile.balanced:
        cues = _balanced(cues, profile, limits)
    numbered = scan(cues, "ord", running={"cue_no": F.lit(1)}, limits=limits)
    return numbered.select(KEY, F.col("cue_no").cast("bigint"), "start", "end", "text")


def tokens_to_cues(
    tokens: DataFrame,
    profile: CueProfile = STANDARD,
    limits: Limits = DEFAULT_LIMITS,
    oversize: bool | None = None,
) -> DataFrame:
    """``transcript_id, cue_no, start, end, text`` from cue tokens."""
    tokens = tokens.select(*TOKEN_COLUMNS)
    return by_size(tokens, lambda t, lim: _build(t, profile, lim), limits, oversize)


def words_to_cues(
    words: DataFrame,
    profile: CueProfile = STANDARD,
    pause_detection: bool = False,
    limits: Limits = DEFAULT_LIMITS,
    oversize: bool | None = None,
) -> DataFrame:
    """``transcript_id, cue_no, start, end, text`` from canonical words."""
    return tokens_to_cues(cue_tokens(words, pause_detection), profile, limits, oversize)
