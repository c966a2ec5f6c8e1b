"""Sentences from words, from segments, from plain text.

One plan serves recordings of any size.  Words are dealt once, by recording and block of
positions; an ordinary recording is one block and needs nothing from others.  A block of a longer
one sends a summary row: its last token and word, how many sentences begin in it, where the
last one begins.  Summaries of a recording, put one after the other, tell every block what it
needs of the ones before.  A second look at the same blocks then numbers the sentences.

Texts are put together inside blocks first, and then, as finished texts, across blocks.  They
come in parts of ``Limits.part_chars`` characters, which in order are the text, so a sentence
without any stop mark is spread as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueweave.functions.pauses import PAUSE_SECONDS, with_pauses
from cueweave.functions.text import (
    ends_with_stop,
    opening_marker,
    split_sentences,
    strip_space,
    strip_token,
    takes_space,
    tidy_token,
)
from cueweave.operators.arrays import unnest
from cueweave.operators.ordered import KEY, task_parts
from cueweave.operators.speakers import rank_label, talk_seconds
from cueweave.schemas import DEFAULT_LIMITS, Limits

_BLOCK = [KEY, "block"]


class _Rules:
    """When a token begins a sentence, and what its row must hold to tell."""

    def __init__(self, timing: bool, gap_seconds: float, hard_gap_seconds: float, ranked: bool):
        # Ranks need times: then all looks at the words read them, so that they read the same exchange.
        self.timed = timing or ranked
        self.timing, self.ranked = timing, ranked
        self.gap, self.hard_gap = gap_seconds, hard_gap_seconds

    def by_time(self, start: Column, opens: Column, word_before: Column) -> Column:
        """Whether a word begins one because of the pause after the word before; false without one."""
        if not self.timed:
            return F.lit(False)
        gap = F.greatest(start - word_before["end"], F.lit(0.0))
        breaks = (
            (gap >= self.hard_gap)
            | ((gap >= self.gap) & opens)
            | (word_before["pause_after"] & (gap >= min(self.gap, PAUSE_SECONDS)))
        )
        if not self.timing:
            breaks = word_before["pause_after"] & (gap < 0)  # never
        return F.coalesce(breaks, F.lit(False))


def _token_rows(words: DataFrame, rules: _Rules, pause_detection: bool, markers: tuple[str, ...] | None, limits: Limits) -> DataFrame:
    """Words and punctuation of recordings that have an id; ``kept`` marks those that sentences are made of.

    Spacing is put right token by token: a piece brings the space before it along, so
    texts are plain concatenations of pieces, wherever they are cut.
    """
    spoken = words.filter(F.col(KEY).isNotNull() & F.col("type").isin("word", "punctuation")).withColumn("text", strip_token(F.col("text")))
    rows = with_pauses(spoken, pause_detection).select(
        KEY,
        "idx",
        F.coalesce(F.floor(F.col("idx") / limits.block_rows), F.lit(0)).cast("bigint").alias("block"),
        F.coalesce(F.col("n_words") > limits.block_rows, F.lit(True)).alias("shares"),
        (F.col("type") == "word").alias("is_word"),
        F.coalesce(F.col("text") != "", F.lit(False)).alias("kept"),
        tidy_token(F.col("text")).alias("text"),
        F.nullif("speaker", F.lit("")).alias("speaker"),
        "start",
        "end",
        F.when(F.col("pause_gap") > 0, F.col("speech_end")).alias("cut"),
        (F.col("pause_gap") >= PAUSE_SECONDS).alias("pause_after"),
    )
    glue = F.when(F.col("is_word") & takes_space(F.col("text")), " ").otherwise("")
    opens = opening_marker(F.col("text"), markers) if rules.timing else F.lit(False)
    return rows.select(
        *_BLOCK,
        "shares",
        "idx",
        "is_word",
        "kept",
        F.when(F.col("kept"), F.concat(glue, "text")).otherwise("").alias("piece"),
        ends_with_stop(F.col("text")).alias("stops"),
        "speaker",
        *([opens.alias("opens"), "start", "end", "cut", "pause_after"] if rules.timed else []),
    )


def _looked_back(rows: DataFrame, rules: _Rules) -> DataFrame:
    """Add what precedes a token inside its block: last stop flag, last word, characters."""
    before = Window.partitionBy(*_BLOCK).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    seen = {
        "stop_before": F.last(F.when(F.col("kept"), F.col("stops")), ignorenulls=True).over(before),
        "chars_before": F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)),
    }
    if rules.timed:
        word = F.when(F.col("kept") & F.col("is_word"), F.struct(_speech_end().alias("end"), "pause_after"))
        seen["word_before"] = F.last(word, ignorenulls=True).over(before)
    return rows.withColumns(seen)


def _speech_end() -> Column:
    return F.coalesce("cut", "end")


def _begin() -> Column:
    return F.coalesce("start", F.lit(0.0))


def _summaries(rows: DataFrame, rules: _Rules) -> DataFrame:
    """One row per block of recordings with several.  Two tokens may be undecided: the first one, and the first word."""
    # The partition id keeps the filter behind the exchange, which is read by the other look as well.
    shared = rows.filter(F.when(F.spark_partition_id() >= 0, F.col("shares")))
    seen = _looked_back(shared, rules)
    known = F.coalesce("stop_before", F.lit(False))
    more = []
    if rules.timed:
        known = known | (F.col("is_word") & rules.by_time(_begin(), F.col("opens"), F.col("word_before")))
        first_word = F.col("kept") & F.col("is_word") & F.col("word_before").isNull()
        is_first = F.col("stop_before").isNull().alias("is_first")
        undecided = F.struct(_begin().alias("start"), "opens", "known", is_first, F.col("chars_before").alias("at"))
        last_word = F.struct("idx", _speech_end().alias("end"), "pause_after")
        more = [
            F.max(F.when(first_word, undecided)).alias("first_word"),
            F.max(F.when(F.col("kept") & F.col("is_word"), last_word)).alias("word"),
        ]
    spoken = F.col("is_word") & F.col("speaker").isNotNull()
    whole = Window.partitionBy(*_BLOCK)
    so_far = whole.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    seen = seen.withColumn("known", F.col("kept") & known)
    seen = seen.withColumns({"nth": F.count_if("known").over(so_far), "of": F.count_if("known").over(whole)})
    for name, stretch in (("head", F.col("nth") == 0), ("tail", (F.col("nth") == F.col("of")) & (F.col("of") > 0))):
        heard = spoken & F.col("kept") & stretch
        more += [F.count_if(heard).alias(f"{name}_n"), F.min(F.when(heard, F.col("idx"))).alias(f"{name}_first")]
    by_speaker = (
        seen.groupBy(*_BLOCK, "speaker")
        .agg(
            F.max("kept").alias("full"),
            F.count_if("known").alias("n"),
            F.max(F.when(F.col("known"), F.col("chars_before"))).alias("at"),
            F.max(F.when(F.col("kept"), F.struct("idx", "stops", "is_word"))).alias("stop"),
            F.sum(F.length("piece")).alias("chars"),
            *more,
        )
    )
    merged = [F.max(c).alias(c) for c in ("full", "at", "stop", *(("first_word", "word") if rules.timed else ()))]
    heard = F.struct("speaker", "head_n", "head_first", "tail_n", "tail_first")
    speaker = F.when(F.col("speaker").isNotNull(), heard)
    merged.append(F.collect_list(speaker).alias("speakers"))
    return by_speaker.groupBy(*_BLOCK).agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), *merged)


def _carried(rows: DataFrame, rules: _Rules) -> DataFrame:
    """What a block needs of its recording's other blocks."""
    blocks = Window.partitionBy(KEY).orderBy("block")
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    later = blocks.rowsBetween(1, Window.unboundedFollowing)
    known = _summaries(rows, rules).withColumn("c_stop", F.last("stop", ignorenulls=True).over(earlier)["stops"])
    begins, adds, word_at = F.coalesce("c_stop", F.lit(True)), F.lit(False), F.lit(None)
    if rules.timed:
        known = known.withColumn("c_word", F.last("word", ignorenulls=True).over(earlier))
        first_word = F.col("first_word")
        timed = F.coalesce(rules.by_time(first_word["start"], first_word["opens"], F.col("c_word")), F.lit(False))
        is_first = F.coalesce(first_word["is_first"], F.lit(False))
        begins = begins | (timed & is_first)
        adds = F.coalesce(timed & ~is_first & ~first_word["known"], F.lit(False))
        word_at = first_word["at"]
    known = known.withColumns({"begins": F.col("full") & begins, "adds": adds})
    known = known.withColumns(
        {
            "n": F.col("n") + F.col("begins").cast("bigint") + F.col("adds").cast("bigint"),
            "at": F.greatest("at", F.when(F.col("adds"), word_at), F.when(F.col("begins"), 0)),
            "c_chars": F.coalesce(F.sum("chars").over(earlier), F.lit(0)),
        }
    )
    known = known.withColumns(
        {
            "c_sentences": F.coalesce(F.sum("n").over(earlier), F.lit(0)),
            "c_open": F.col("c_chars") - F.coalesce(F.max(F.col("c_chars") + F.col("at")).over(earlier), F.lit(0)),
            "goes_on": ~F.coalesce(F.first(F.when(F.col("full"), F.col("begins")), ignorenulls=True).over(later), F.lit(True)),
        }
    )
    kept = ["c_stop", *(["c_word"] if rules.timed else []), "c_sentences", "c_open", "n", "goes_on"]
    each = known.select(
        *_BLOCK,
        *kept,
        (F.col("c_sentences") + F.col("begins").cast("bigint") + F.col("adds").cast("bigint")).alias("_head"),
        F.explode_outer("speakers").alias("_s"),
    ).select("*", "_s.*")
    name = F.col("speaker")
    if rules.ranked:
        each = each.join(_ranks(rows).toDF(*_BLOCK, "speaker", "label"), [*_BLOCK, "speaker"], "left")
        name = F.coalesce("label", "speaker")

    # Who says most in the sentences that a block shares with others: the open one and its last one.
    def vote(kind: str, sent: Column, n: Column, first: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), sent.alias("sent"), n.alias("n"), first.cast("bigint").alias("first"))

    votes = F.array(
        vote("head", F.col("_head"), F.col("head_n"), F.col("head_first")),
        vote("tail", F.col("c_sentences") + F.col("n"), F.col("tail_n"), F.col("tail_first")),
        vote("open", F.col("c_sentences"), F.lit(0).cast("bigint"), F.lit(None)),
    )
    each = each.withColumns({"name": name, "_v": F.explode(votes)})
    same = Window.partitionBy(KEY, "_v.sent", "name")
    each = each.withColumns({"heard": F.sum("_v.n").over(same), "since": F.min("_v.first").over(same)})
    most = F.when(F.col("heard") > 0, F.struct("heard", (-F.col("since")).alias("early"), "name"))
    each = each.withColumn("best", F.max(most).over(Window.partitionBy(KEY, "_v.sent"))["name"])
    told = [
        F.max(F.when(F.col("_v.kind") == kind, F.col("best"))).alias(f"c_{kind}_speaker") for kind in ("open", "tail")
    ]
    return each.groupBy(*_BLOCK).agg(*[F.first(c).alias(c) for c in kept], *told)


def _ranks(rows: DataFrame) -> DataFrame:
    """(recording, block, speaker, label): ranks by window over what blocks sum up, totals first."""
    spoken = F.col("is_word") & F.col("speaker").isNotNull()
    # A row is asked for whole: then this reads the columns, and so the exchange, of the other looks.
    # A number made of it can be kept in a hash aggregate; a struct would have all words sorted.
    whole = F.xxhash64(*[c for c in rows.columns if c not in _BLOCK])
    sums = rows.groupBy(*_BLOCK, "speaker").agg(
        F.sum(F.when(spoken, talk_seconds())).alias("seconds"),
        F.count_if(spoken).alias("n_spoken"),
        F.min(F.when(spoken, F.col("idx"))).alias("first_idx"),
        F.max(whole).alias("whole"),
    ).filter((F.col("n_spoken") > 0) & F.col("whole").isNotNull())
    total = Window.partitionBy(KEY, "speaker")
    totals = sums.withColumns(
        {
            "seconds": F.sum("seconds").over(total),
            "n_spoken": F.sum("n_spoken").over(total),
            "first_idx": F.min("first_idx").over(total),
        }
    )
    return totals.select(*_BLOCK, "speaker", rank_label(F.dense_rank).alias("label"))


def _by_block(df: DataFrame, parts: int | None) -> DataFrame:
    """``df`` dealt by recording and block, as all that is joined by them: words are not dealt again for a join."""
    return df.repartition(*_BLOCK) if parts is None else df.repartition(parts, *_BLOCK)


def _placed(rows: DataFrame, carried: DataFrame, rules: _Rules, limits: Limits, parts: int | None) -> DataFrame:
    """Kept tokens with ``sent_no``, ``part_no`` and whether their sentence crosses into another block."""
    there = carried if parts is None else _by_block(carried, parts)
    there = there.withColumnsRenamed({KEY: "_key", "block": "_block"})
    same = F.col("shares") & (F.col(KEY) == F.col("_key")) & (F.col("block") == F.col("_block"))
    known = rows.join(there, same, "left").drop("_key", "_block")
    if rules.ranked:
        names = F.map_from_entries(F.collect_list(F.struct("speaker", "label"))).alias("labels")
        labels = _ranks(rows).groupBy(*_BLOCK).agg(names)
        known = known.join(labels if parts is None else _by_block(labels, parts), _BLOCK, "left")
    seen = _looked_back(known, rules)
    breaks = F.coalesce("stop_before", "c_stop", F.lit(True))
    if rules.timed:
        carried_word = F.when(
            F.col("c_word").isNotNull(), F.struct(F.col("c_word.end").alias("end"), F.col("c_word.pause_after").alias("pause_after"))
        )
        word_before = F.coalesce("word_before", carried_word)
        breaks = breaks | (F.col("is_word") & rules.by_time(_begin(), F.col("opens"), word_before))
    so_far = Window.partitionBy(*_BLOCK).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    seen = seen.withColumn("breaks", F.col("kept") & breaks)
    seen = seen.withColumns(
        {
            "nth": F.count_if("breaks").over(so_far),
            "begin": F.max(F.when(F.col("breaks"), F.col("chars_before"))).over(so_far),
        }
    )
    # Always true; a flow that shows no speakers would read fewer columns, and move the words again for that.
    seen = seen.filter(F.col("kept") & F.col("is_word").isNotNull())
    none = F.lit(0).cast("bigint")
    inside = F.when(F.col("nth") == 0, F.coalesce("c_open", none) + F.col("chars_before")).otherwise(F.col("chars_before") - F.col("begin"))
    speaker = F.coalesce(F.try_element_at("labels", "speaker"), "speaker") if rules.ranked else F.col("speaker")
    open_, last = F.col("nth") == 0, (F.col("nth") == F.col("n")) & F.col("goes_on")
    return seen.select(
        *_BLOCK,
        "idx",
        "is_word",
        "piece",
        speaker.alias("speaker"),
        (F.coalesce("c_sentences", none) + F.col("nth")).alias("sent_no"),
        F.floor(inside / limits.part_chars).alias("part_no"),
        F.when(open_, F.struct(F.col("c_open_speaker").alias("name"))).when(last, F.struct(F.col("c_tail_speaker").alias("name"))).alias("shared"),
    )


def _gathered(placed: DataFrame) -> DataFrame:
    """Parts of sentences, one row per block that holds some of a part."""
    by_speaker = placed.groupBy(*_BLOCK, "sent_no", "speaker").agg(
        F.count_if("is_word").alias("n"),
        F.min(F.when(F.col("is_word"), F.col("idx"))).alias("first"),
        F.collect_list(F.struct("idx", "part_no", "piece")).alias("pieces"),
        F.first("shared").alias("shared"),
    )
    counted = F.col("speaker").isNotNull() & (F.col("n") > 0)
    whole = by_speaker.groupBy(*_BLOCK, "sent_no").agg(
        F.array_sort(F.flatten(F.collect_list("pieces"))).alias("pieces"),
        F.max_by("speaker", F.when(counted, F.struct("n", -F.col("first")))).alias("speaker"),
        F.first("shared").alias("shared"),
    )

    def text(pieces: Column) -> Column:
        return F.array_join(F.transform(pieces, lambda p: p["piece"]), "")

    pieces = F.col("pieces")
    one = F.array(F.struct(pieces[0]["part_no"].alias("part_no"), text(pieces).alias("text")))
    several = F.transform(
        F.array_distinct(F.transform(pieces, lambda p: p["part_no"])),
        lambda part: F.struct(part.alias("part_no"), text(F.filter(pieces, lambda p: p["part_no"] == part)).alias("text")),
    )
    parts = F.when(pieces[0]["part_no"] == F.element_at(pieces, -1)["part_no"], one).otherwise(several)
    speaker = F.when(F.col("shared").isNotNull(), F.col("shared.name")).otherwise(F.col("speaker"))
    found = whole.select(*_BLOCK, "sent_no", F.explode(parts).alias("_p"), speaker.alias("speaker"))
    return found.select(*_BLOCK, "sent_no", "_p.part_no", "_p.text", "speaker")


def words_to_sentences(
    words: DataFrame,
    timing: bool = False,
    gap_seconds: float = 0.9,
    hard_gap_seconds: float = 1.8,
    markers: tuple[str, ...] | None = None,
    pause_detection: bool = False,
    limits: Limits = DEFAULT_LIMITS,
    ranked: bool = False,
) -> DataFrame:
    """``transcript_id, sent_no, part_no, text, speaker`` (the speaker of most words).

    A sentence ends after a token ending in a sentence mark.  With ``timing`` it also
    ends before a word that follows a long pause, a pause and a discourse marker, or a
    detected pause.  ``ranked`` names speakers speaker_0, speaker_1, ... by talk time.

    ``part_no`` is 0 but for sentences of more than ``limits.part_chars`` characters: their
    parts in order, put together without anything between, are the text.
    """
    rules = _Rules(timing, gap_seconds, hard_gap_seconds, ranked)
    # All looks at the words read this one exchange.
    rows = _token_rows(words, rules, pause_detection and timing, markers, limits)
    dealt_to = task_parts(rows)
    rows = _by_block(rows, dealt_to)
    carried = _carried(rows, rules)

    found = _gathered(_placed(rows, carried, rules, limits, dealt_to))
    # Only finished texts move again; what blocks hold of one part is put together.
    parts = found.groupBy(KEY, "sent_no", "part_no").agg(
        F.array_sort(F.collect_list(F.struct("block", "text"))).alias("_t"), F.first("speaker").alias("speaker")
    )
    text = F.array_join(F.transform("_t", lambda t: t["text"]), "")
    # The space that the first piece brings along is none of the sentence's.
    text = F.when(F.col("part_no") == 0, F.ltrim(text)).otherwise(text)
    return parts.select(KEY, "sent_no", "part_no", text.alias("text"), "speaker")


def texts_to_sentences(texts: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """``key, sent_no, text, speaker`` (NULL) from plain texts; narrow, one row at a time."""
    parts = unnest(texts, [key], split_sentences(F.col(text)), "text", "_at")
    return parts.select(
        key,
        (F.col("_at") + 1).cast("bigint").alias("sent_no"),
        "text",
        F.lit(None).cast("string").alias("speaker"),
    )


def segments_to_sentences(transcripts: DataFrame) -> DataFrame:
    """Sentences of transcripts that have segments but no words."""
    without_words = transcripts.filter(
        (F.coalesce(F.size("words"), F.lit(0)) <= 0) & (F.size("segments") > 0)
    )
    joined = F.array_join(
        F.transform("segments", lambda s: strip_space(F.coalesce(s["text"], F.lit("")))), " "
    )
    return texts_to_sentences(without_words.select(KEY, joined.alias("text")))
