"""Greedy packing of ordered items (words, or short cues) into cues.

Packing depends on what has been packed before, so it is a fold.  The fold is done
per run, a stretch of items between positions where a new cue must begin; runs are
independent, found beforehand by windows, and usually a few words long.

Items need: ``transcript_id, ord, run, start, end, piece, spaced, hard, soft`` where
``ord`` orders a recording, ``run`` is the ``ord`` of the run's first item, ``piece``
is the tidied text and ``spaced`` tells whether a space goes before it.
Result: ``transcript_id, ord, start, end, text``, ``ord`` being the first item's.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueweave.functions.text import strip_space
from cueweave.operators.arrays import unnest
from cueweave.operators.ordered import KEY, materialize, scan
from cueweave.schemas import Limits

_FIELDS = ("ord", "start", "end", "piece", "spaced", "hard", "soft")


@dataclass(frozen=True)
class Trial:
    """An item tried on to the open cue: the cue's size with the item in it."""

    chars: Column
    words: Column
    seconds: Column


@dataclass(frozen=True)
class Packer:
    """When an item opens a new cue, and when it closes the one it is in.

    opens(state, item, trial)  True: the item does not go into the open cue
    closes(soft, trial)        True: a cue of this size, its text ending softly or
                               not, ends here; with it, sentence ends close a cue too
    """

    max_chars: int
    opens: Callable[[Column, Column, Trial], Column]
    closes: Callable[[Column, Trial], Column] | None = None


def _fold(items: Column, packer: Packer, restarted: Column | None = None) -> Column:
    """Fold items into cues: ``starts`` (1-based positions) and ``restarted``, true if
    the last cue was opened by an item that no longer fitted into the one before.

    ``restarted`` as an argument says so of the first item; such an item is not
    tested for a soft end.
    """
    begin = F.struct(
        F.lit(0).alias("at"),
        F.lit(True).alias("closed"),
        F.lit(False).alias("restarted"),
        F.lit(0.0).alias("since"),
        F.lit(0).alias("chars"),
        F.lit(0).alias("words"),
        F.lit(False).alias("hard"),
        F.lit(False).alias("soft"),
        F.array().cast("array<int>").alias("starts"),
    )

    def step(state: Column, item: Column) -> Column:
        size = F.length(item["piece"])
        glue = F.when(item["spaced"] & (state["chars"] > 0), 1).otherwise(0)
        trial = Trial(
            chars=state["chars"] + glue + size,
            words=state["words"] + 1,
            seconds=item["end"] - state["since"],
        )
        alone = Trial(chars=size, words=F.lit(1), seconds=item["end"] - item["start"])
        at = state["at"] + 1
        pushed_out = ~state["closed"]
        if restarted is not None:
            pushed_out = pushed_out | ((at == 1) & restarted)
        if packer.closes is None:
            ends_alone = ends_grown = F.lit(False)
        else:
            ends_alone = item["hard"] | (~pushed_out & packer.closes(item["soft"], alone))
            soft_text = F.when(size > 0, item["soft"]).otherwise(state["soft"])
            ends_grown = item["hard"] | packer.closes(soft_text, trial)
        fresh = F.struct(
            at.alias("at"),
            ends_alone.alias("closed"),
            pushed_out.alias("restarted"),
            item["start"].alias("since"),
            size.alias("chars"),
            F.lit(1).alias("words"),
            item["hard"].alias("hard"),
            item["soft"].alias("soft"),
            F.array_append(state["starts"], at).alias("starts"),
        )
        grown = F.struct(
            at.alias("at"),
            ends_grown.alias("closed"),
            state["restarted"].alias("restarted"),
            state["since"].alias("since"),
            trial.chars.alias("chars"),
            trial.words.alias("words"),
            F.when(size > 0, item["hard"]).otherwise(state["hard"]).alias("hard"),
            F.when(size > 0, item["soft"]).otherwise(state["soft"]).alias("soft"),
            state["starts"].alias("starts"),
        )
        return F.when(state["closed"] | packer.opens(state, item, trial), fresh).otherwise(grown)

    return F.aggregate(
        items,
        begin,
        step,
        lambda state: F.struct(state["starts"].alias("starts"), state["restarted"].alias("restarted")),
    )


def _segments(items: Column, starts: Column) -> Column:
    """``items`` cut at ``starts`` into one array per cue."""
    return F.transform(
        starts,
        lambda s, i: F.slice(
            items, s, F.coalesce(F.get(starts, i + 1), F.size(items) + 1) - s
        ),
    )


def _cues(segments: Column) -> Column:
    return F.transform(
        segments,
        lambda part: F.struct(
            part[0]["ord"].alias("ord"),
            part[0]["start"].alias("start"),
            F.element_at(part, -1)["end"].alias("end"),
            strip_space(
                F.array_join(
                    F.transform(
                        part,
                        lambda item, i: F.when(
                            item["spaced"] & (i > 0), F.concat(F.lit(" "), item["piece"])
                        ).otherwise(item["piece"]),
                    ),
                    "",
                )
            ).alias("text"),
        ),
    )


def _emit(packed: DataFrame) -> DataFrame:
    cue = unnest(packed, [KEY], _cues(F.col("_segments")), "_cue")
    return cue.select(KEY, "_cue.*").filter(F.col("text") != "")


def _gathered(items: DataFrame, *keys: str) -> DataFrame:
    packed = F.array_sort(F.collect_list(F.struct(*_FIELDS)))
    return items.groupBy(KEY, *keys).agg(packed.alias("_items"))


def pack(items: DataFrame, packer: Packer, limits: Limits | None = None) -> DataFrame:
    """Pack every run.  ``limits`` given: oversize recordings, runs of any length."""
    if limits is not None:
        return _pack_in_chunks(items, packer, limits)
    runs = _gathered(items, "run").withColumn("_fold", _fold(F.col("_items"), packer))
    return _emit(runs.select(KEY, _segments(F.col("_items"), F.col("_fold.starts")).alias("_segments")))


# A run may itself be as long as the recording.  It is then cut into chunks that are
# folded side by side.  What a chunk does depends only on where the cue open at its
# beginning started, and that start is among the last few items before the chunk, so
# each chunk is folded once per candidate start.  Chaining those small tables gives
# the true start for every chunk, and one last fold per chunk yields the cues.


def _pack_in_chunks(items: DataFrame, packer: Packer, limits: Limits) -> DataFrame:
    width = limits.chunk_items
    if width <= packer.max_chars + 2:
        raise ValueError("chunk_items must exceed the cue's character budget")
    full = (F.col("piece") != "").cast("bigint")
    counted = scan(items, "ord", running={"_full": full}, limits=limits)
    counted = scan(
        counted,
        "ord",
        latest={"_full_at_run": (F.col("_full"), F.col("ord") == F.col("run"))},
        limits=limits,
    )
    # Chunks hold an equal number of non-empty items, so no cue spans a whole chunk.
    offset = F.col("_full") - F.col("_full_at_run")
    chunked = counted.withColumn("chunk", F.floor(offset / width)).withColumn(
        "_near_end", offset % width >= width - packer.max_chars - 2
    )
    own = chunked.withColumn("_own", F.lit(True))
    context = (
        chunked.filter("_near_end").withColumn("chunk", F.col("chunk") + 1).withColumn("_own", F.lit(False))
    )
    chunks = (
        own.unionByName(context)
        .groupBy(KEY, "run", "chunk")
        .agg(
            F.array_sort(F.collect_list(F.struct(*_FIELDS))).alias("_items"),
            F.count_if(~F.col("_own")).alias("_before"),
            F.count_if("_own").alias("_owned"),
        )
        .filter(F.col("_owned") > 0)
    )
    chunks = materialize(chunks)
    entries = _entries(chunks, packer, limits.route_chunks)
    sizes = chunks.groupBy(KEY, "run").agg(F.max("chunk").alias("_last"))
    entered = chunks.join(entries, [KEY, "run", "chunk"]).join(sizes, [KEY, "run"])
    entered = entered.withColumn(
        "_items", F.filter("_items", lambda item: item["ord"] >= F.col("entry.ord"))
    ).withColumn("_fold", _fold(F.col("_items"), packer, F.col("entry.restarted")))
    segments = _segments(F.col("_items"), F.col("_fold.starts"))
    # The cue still open at the end belongs to the next chunk, which completes it.
    finished = F.when(F.col("chunk") == F.col("_last"), segments).otherwise(
        F.slice(segments, F.lit(1), F.size(segments) - 1)
    )
    return _emit(entered.select(KEY, finished.alias("_segments")))


def _place(ord_: Column, restarted: Column) -> Column:
    """Where a cue started, and whether its first item was pushed out of another."""
    return F.struct(ord_.cast("bigint").alias("ord"), restarted.alias("restarted"))


def _last_start(items: Column, packer: Packer, restarted: Column) -> Column:
    # The fold is bound once, as the only element of an array.
    return F.transform(
        F.array(_fold(items, packer, restarted)),
        lambda done: _place(
            F.element_at(items, F.element_at(done["starts"], -1))["ord"], done["restarted"]
        ),
    )[0]


def _follow(route: Column, at: Column) -> Column:
    return F.filter(route, lambda hop: hop["entry"] == at)[0]["exit"]


def _entries(chunks: DataFrame, packer: Packer, fan_in: int) -> DataFrame:
    """For every chunk, where the cue open at its beginning started."""
    items, known = F.col("_items"), F.lit(False)
    first_hop = F.struct(
        _place(F.col("run"), known).alias("entry"),
        _last_start(items, packer, known).alias("exit"),
    )

    def tried(restarted: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.greatest(F.col("_before").cast("int"), F.lit(1))),
            lambda i: F.struct(
                _place(F.element_at(items, i)["ord"], restarted).alias("entry"),
                _last_start(F.slice(items, i, F.size(items)), packer, restarted).alias("exit"),
            ),
        )

    hops = F.concat(tried(F.lit(False)), tried(F.lit(True)))
    routes = chunks.select(
        KEY,
        "run",
        "chunk",
        F.floor(F.col("chunk") / fan_in).alias("leg"),
        F.when(F.col("chunk") == 0, F.array(first_hop)).otherwise(hops).alias("route"),
    )
    legs = materialize(
        routes.groupBy(KEY, "run", "leg").agg(
            F.array_sort(F.collect_list(F.struct("chunk", "route"))).alias("hops")
        )
    )
    across = F.aggregate(
        F.slice("hops", F.lit(2), F.size("hops")),
        F.col("hops")[0]["route"],
        lambda route, h: F.transform(
            route,
            lambda hop: F.struct(
                hop["entry"].alias("entry"), _follow(h["route"], hop["exit"]).alias("exit")
            ),
        ),
    )
    trips = legs.groupBy(KEY, "run").agg(
        F.array_sort(F.collect_list(F.struct("leg", across.alias("route")))).alias("trip")
    )
    whole_trip = _entry_chain(F.col("trip"), _place(F.col("run"), F.lit(False)))
    leg_entries = unnest(trips, [KEY, "run"], whole_trip, "leg_entry", "leg")
    within = _entry_chain(F.col("hops"), F.col("leg_entry"))
    joined = legs.join(leg_entries, [KEY, "run", "leg"])
    return unnest(joined, [KEY, "run", "leg"], within, "entry", "at").select(
        KEY, "run", (F.col("leg") * fan_in + F.col("at")).alias("chunk"), "entry"
    )


def _entry_chain(steps: Column, first: Column) -> Column:
    """Entry of each step, given the entry of the first one."""
    begin = F.struct(first.alias("at"), F.array().cast("array<struct<ord:bigint,restarted:boolean>>").alias("entries"))
    return F.aggregate(
        steps,
        begin,
        lambda state, step: F.struct(
            _follow(step["route"], state["at"]).alias("at"),
            F.array_append(state["entries"], state["at"]).alias("entries"),
        ),
        lambda state: state["entries"],
    )
