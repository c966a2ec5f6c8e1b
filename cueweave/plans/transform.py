"""Transcripts to subtitles, sentence texts, cleaned transcripts.

A transcript row holds its recording whole, so one task has had room for it already
and its cues are made whole.  Tables of words have no such bound: use the cue operators
directly, which cut oversize recordings into blocks.  Sentences have one plan for all sizes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cueweave.functions.script import in_script
from cueweave.functions.text import CLEAN_STEPS, clean_text, clean_token
from cueweave.operators.cues import words_to_cues
from cueweave.operators.ordered import KEY, dealt, offsets
from cueweave.operators.sentences import segments_to_sentences, words_to_sentences
from cueweave.operators.speakers import tagged_lines
from cueweave.operators.subtitles import (
    basic_blocks,
    numbered_blocks,
    social_variants,
    standard_blocks,
    subtitle_files,
)
from cueweave.operators.words import words_from_transcripts
from cueweave.schemas import BASIC, DEFAULT_LIMITS, SOCIAL, STANDARD, Limits


def output_text(clean: bool = False, script: str = "latin") -> Callable[[Column], Column] | None:
    """Clean-up, then script; ``None`` when there is nothing to do."""
    if not clean and script == "source":
        return None
    return lambda text: in_script(clean_text(text) if clean else text, script)


def observed_clean(
    texts: DataFrame, text: str, observation: Observation, marker_breaks: bool = False
) -> DataFrame:
    """``texts`` with one column cleaned; ``observation`` counts the rows each rule changes.

    The counts are metrics of whatever job writes the result: nothing is read twice.
    :func:`rule_counts` turns them into rows once that job has ended.  Null texts stay null and count
    as rows only.
    """
    steps = [(name, rule) for name, rule in CLEAN_STEPS if marker_breaks or name != "breaks"]
    out, before, changed = texts, text, []
    for name, rule in steps:
        out = out.withColumn(f"_{name}", rule(F.col(before)))
        changed.append(F.count_if(F.col(f"_{name}") != F.col(before)).alias(name))
        before = f"_{name}"
    counted = out.observe(observation, F.count(F.lit(1)).alias("rows"), *changed)
    return counted.select(*[F.col(before).alias(text) if c == text else F.col(c) for c in texts.columns])


def rule_counts(spark: SparkSession, observation: Observation) -> DataFrame:
    """``step, rule, n_changed, n_rows`` of an ended :func:`observed_clean`, in order of the rules."""
    found = observation.get
    rules = [name for name, _ in CLEAN_STEPS if name in found]
    rows = [(step, name, found[name], found["rows"]) for step, name in enumerate(rules, 1)]
    return spark.createDataFrame(rows, "step int, rule string, n_changed bigint, n_rows bigint")


def clean_transcripts(transcripts: DataFrame, clean_words: bool = True) -> DataFrame:
    """Cleaned copies: text, segment texts and word texts; everything else as it was.

    Arrays are rewritten inside the row: no explode, no shuffle.
    """
    out = transcripts.withColumns(
        {
            "text": clean_text(F.col("text"), marker_breaks=True),
            "segments": F.transform("segments", lambda s: s.withField("text", clean_text(s["text"]))),
        }
    )
    if clean_words:
        words = F.transform("words", lambda w: w.withField("text", clean_token(w["text"])))
        out = out.withColumn("words", words)
    return out


#: Endings of the files of each output. Fixed values.
OUTPUT_ENDINGS = {
    "standard": ".srt",
    "numbered": ".sentence.srt",
    "social_cyrillic": "_social_cyrillic.srt",
    "social_latin": "_social_latin.srt",
    "social_raw": "_social_raw.srt",
    "sentences": ".txt",
    "clean_json": "_uz_clean.json",
}


def output_name(stem: Column, output: str) -> Column:
    """The file name of an output of a transcript."""
    return F.concat(stem, F.lit(OUTPUT_ENDINGS[output]))


def output_names(transcripts: DataFrame) -> DataFrame:
    """``transcript_id, output, out_name`` for every output a transcript can have."""
    rows = [F.struct(F.lit(o).alias("output"), output_name(F.col("stem"), o).alias("out_name")) for o in OUTPUT_ENDINGS]
    return transcripts.select(KEY, F.inline(F.array(*rows)))


def _with_text(fields: Column, change: Callable[[Column], Column]) -> Column:
    """An object (map of variants) with its text changed, if that is a string."""
    text = F.try_variant_get(fields["text"], "$", "string")
    fresh = F.create_map(F.lit("text"), change(text).cast("variant"))
    return F.when(text.isNull(), fields).otherwise(
        F.map_concat(F.map_filter(fields, lambda name, _: name != "text"), fresh)
    )


def clean_document(raw: Column) -> Column:
    """A transcript document (VARIANT) with cleaned texts; every other field as it was.

    Numbers stay numbers and fields that nothing here knows stay, in words and segments too.
    """
    fields = F.try_variant_get(raw, "$", "map<string,variant>")

    def items(name: str, change: Callable[[Column], Column]) -> Column:
        read = F.try_variant_get(fields[name], "$", "array<map<string,variant>>")
        return F.coalesce(F.to_variant_object(F.transform(read, lambda x: _with_text(x, change))), fields[name])

    changed = F.map_filter(
        F.create_map(
            F.lit("words"), items("words", clean_token),
            F.lit("segments"), items("segments", clean_text),
        ),
        lambda _, value: value.isNotNull(),
    )
    rest = F.map_filter(fields, lambda name, _: ~name.isin("words", "segments"))
    whole = _with_text(F.map_concat(rest, changed), lambda text: clean_text(text, marker_breaks=True))
    return F.coalesce(F.to_variant_object(whole), raw)


def clean_json(transcripts: DataFrame) -> DataFrame:
    """``transcript_id, out_name, json`` of the cleaned copies, from ``raw`` documents.

    Read with ``read_transcripts(..., keep_raw=True)``.
    """
    name = output_name(F.col("stem"), "clean_json").alias("out_name")
    return transcripts.select(KEY, name, F.to_json(clean_document(F.col("raw"))).alias("json"))


def _words(transcripts: DataFrame, clean: bool, segments_as_words: bool = False) -> DataFrame:
    source = clean_transcripts(transcripts) if clean else transcripts
    return dealt(words_from_transcripts(source, segments_as_words), KEY)


def subtitles(
    transcripts: DataFrame, clean: bool = False, script: str = "latin", pause_detection: bool = False
) -> DataFrame:
    """Standard subtitle file of every transcript."""
    cues = words_to_cues(_words(transcripts, clean), STANDARD, pause_detection, oversize=False)
    return subtitle_files(standard_blocks(cues, output_text(clean, script)), transcripts)


def numbered_subtitles(
    transcripts: DataFrame, clean: bool = False, pause_detection: bool = False
) -> DataFrame:
    """The same timing with cue numbers for text."""
    cues = words_to_cues(_words(transcripts, clean), STANDARD, pause_detection, oversize=False)
    return subtitle_files(numbered_blocks(cues), transcripts)


def social_subtitles(
    transcripts: DataFrame,
    variants: tuple[str, ...] = ("cyrillic", "latin", "raw"),
    clean: bool = False,
    pause_detection: bool = False,
    transform: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Single-line subtitle files, one per transcript and script variant.

    ``transform`` rewrites the text of every cue before its script is changed.
    """
    cues = words_to_cues(_words(transcripts, clean), SOCIAL, pause_detection, oversize=False)
    every = transcripts.select(KEY, F.explode(F.array(*[F.lit(v) for v in variants])).alias("variant"))
    return subtitle_files(social_variants(cues, variants, clean, transform), every)


def basic_subtitles(transcripts: DataFrame, pause_detection: bool = False) -> DataFrame:
    """Plain subtitle file of every transcript; segments stand in for missing words."""
    words = words_from_transcripts(transcripts, segments_as_words=True)
    return subtitle_files(basic_blocks(words_to_cues(words, BASIC, pause_detection, oversize=False)), transcripts)


def sentences(
    transcripts: DataFrame,
    clean: bool = False,
    script: str = "latin",
    pause_detection: bool = False,
    gap_seconds: float = 0.9,
    hard_gap_seconds: float = 1.8,
    limits: Limits = DEFAULT_LIMITS,
    ranked: bool = True,
) -> DataFrame:
    """Sentences with ranked speakers and final text, from words or else segments.

    ``ranked=False`` keeps speakers' own names, for outputs that show none.
    Words are read and moved once, whatever a recording's size; ``part_no`` as in
    :func:`words_to_sentences`.  Parts of a long sentence are cleaned and written in the other
    script one by one.
    """
    source = clean_transcripts(transcripts) if clean else transcripts
    spoken = words_to_sentences(
        words_from_transcripts(source),
        clean or pause_detection,
        gap_seconds,
        hard_gap_seconds,
        pause_detection=pause_detection,
        limits=limits,
        ranked=ranked,
    )
    found = spoken.unionByName(segments_to_sentences(source).withColumn("part_no", F.lit(0).cast("bigint")))
    change = output_text(clean, script)
    return found if change is None else found.withColumn("text", change(F.col("text")))


def sentence_files(found: DataFrame, part_lines: int = 5_000) -> DataFrame:
    """``transcript_id, part_no, txt``: one sentence per line, no speaker tags.

    Transcripts without sentences give no file; parts in order are the file.
    """
    lines = tagged_lines(found, hide_speakers=True)
    piece = F.col("part_no") if "part_no" in lines.columns else F.lit(0)
    part = F.floor((F.col("sent_no") - 1) / part_lines).cast("bigint")
    ordered = F.array_sort(F.collect_list(F.struct("sent_no", "_piece", "line")))
    joined = F.transform(ordered, lambda s, i: F.concat(F.when((s["_piece"] == 0) & (i > 0), "\n").otherwise(""), s["line"]))
    return (
        lines.select(KEY, "sent_no", "line", piece.alias("_piece"), part.alias("part_no"))
        .groupBy(KEY, "part_no")
        .agg(F.concat(F.array_join(joined, ""), F.lit("\n")).alias("txt"))
    )


def combined_lines(found: DataFrame) -> DataFrame:
    """All sentences of all transcripts in path order, range-partitioned and sorted."""
    lines = tagged_lines(found, hide_speakers=True)
    return lines.orderBy(*[c for c in (KEY, "sent_no", "part_no") if c in lines.columns])


def combined_manifest(files: DataFrame) -> DataFrame:
    """``transcript_id, part_no, byte_offset, n_bytes, md5``: where each part of ``sentence_files`` lies in the combined text.

    Parts can be written side by side, each at its offset: nothing is sorted or gathered for that.
    """
    body = F.col("txt").cast("binary")
    sizes = files.select(KEY, "part_no", F.octet_length("txt").cast("bigint").alias("n_bytes"), F.md5(body).alias("md5"))
    return offsets(sizes, [KEY, "part_no"], "n_bytes", "byte_offset").select(KEY, "part_no", "byte_offset", "n_bytes", "md5")


def combined_name(transcripts: DataFrame) -> DataFrame:
    """``n_files, out_name`` for the combined text, from what the stems share.

    The common prefix of a set is that of its least and greatest member.
    """
    ends = transcripts.agg(
        F.count(F.lit(1)).alias("n_files"), F.min("stem").alias("_low"), F.max("stem").alias("_high")
    )
    shared = F.array_max(
        F.filter(
            F.sequence(F.lit(0), F.least(F.length("_low"), F.length("_high"))),
            lambda n: F.left("_low", n) == F.left("_high", n),
        )
    )
    base = F.btrim(F.left("_low", shared), F.lit(" ._-"))
    name = F.when(base != "", F.concat(base, F.lit("_comb.txt"))).otherwise("combined.txt")
    return ends.select("n_files", name.alias("out_name"))


def output_totals(**outputs: DataFrame) -> DataFrame:
    """``output, n_rows, n_transcripts`` over any number of outputs."""
    totals = [
        df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(KEY).alias("n_transcripts")).select(
            F.lit(name).alias("output"), "n_rows", "n_transcripts"
        )
        for name, df in outputs.items()
    ]
    first, *rest = totals
    for other in rest:
        first = first.unionByName(other)
    return first
