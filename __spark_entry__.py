
from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cueweave.functions import script, subtitles, text, timecode  # noqa: E402
from cueweave.functions.pauses import with_pauses  # noqa: E402
from cueweave.operators import attachments as att  # noqa: E402
from cueweave.operators import speakers, words as word_ops  # noqa: E402
from cueweave.operators import subtitles as srt  # noqa: E402
from cueweave.operators.cues import cue_runs, words_to_cues  # noqa: E402
from cueweave.operators.ordered import shared_folder  # noqa: E402
from cueweave.operators.sentences import (  # noqa: E402
    segments_to_sentences,
    texts_to_sentences,
    words_to_sentences,
)
from cueweave.plans import incremental, transform  # noqa: E402
from cueweave.schemas import BASIC, DEFAULT_LIMITS, SOCIAL, STANDARD  # noqa: E402
from cueweave.sources.derived import transcripts_from_documents  # noqa: E402
from cueweave.sources.files import choose_names, file_name, media_catalog, spread  # noqa: E402
from cueweave.sources.transcripts import parsed, quarantine  # noqa: E402
from cueweave.streaming.tables import closing_token, run_to_table, spoken_runs, stream_table  # noqa: E402
from cueweave.sources.tables import has_oversize, with_punctuation_tokens, words_from_turns  # noqa: E402
from oracle import sql  # noqa: E402

try:  # the training-data operators are optional
    import corpus_pipeline
    from cueweave.llm import queries as llm
except ModuleNotFoundError as error:
    if error.name not in ("corpus_pipeline", "cueweave.llm", "cueweave.llm.queries"):
        raise
    corpus_pipeline = llm = None
except ImportError as error:  # an emptied folder still counts as a package
    if error.name != "cueweave.llm":
        raise
    corpus_pipeline = llm = None

Query = Callable[[SparkSession, str], DataFrame]
PROFILES = {"standard": STANDARD, "social": SOCIAL, "basic": BASIC}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "documents"))


def _oversize(spark: SparkSession, sf_dir: str) -> bool:
    return has_oversize(_table(spark, sf_dir, "conversations"), "conv_id", "text")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the conversations."""
    turns = _table(spark, sf_dir, "conversations")
    return words_from_turns(turns, "conv_id", "turn", "role", "text")


def _document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents, one recording each."""
    documents = _documents(spark, sf_dir)
    return words_from_turns(documents, "doc_id", None, "source", "text", prefix="doc-")


def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts_from_documents(_documents(spark, sf_dir))


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentence_rows(_words(spark, sf_dir))


def _sentence_rows(words: DataFrame, *args, **settings) -> DataFrame:
    """Sentences in one row each: none here is long enough to come in parts."""
    return words_to_sentences(words, *args, **settings).drop("part_no")


def _cues(spark: SparkSession, sf_dir: str, profile=STANDARD, pauses: bool = False) -> DataFrame:
    return words_to_cues(_words(spark, sf_dir), profile, pauses, oversize=_oversize(spark, sf_dir))


def _seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts, each followed by an Uzbek phrase, since the tables hold none."""
    phrases = F.array(*[F.lit(p) for p in sql.PHRASES])
    phrase = F.element_at(phrases, (F.col("doc_id") % len(sql.PHRASES)).cast("int") + 1)
    return _documents(spark, sf_dir).select("doc_id", F.concat("text", phrase).alias("text"))


def _cyrillic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seeded(spark, sf_dir).select("doc_id", script.to_cyrillic(F.col("text")).alias("text"))



# -- words, speakers, sentences ---------------------------------------------------


def q_words(spark, d):
    words = _words(spark, d)
    return words.select(
        "transcript_id", "n_words", "idx", "text", "start", "end", "speaker",
        F.size("characters").cast("bigint").alias("n_characters"),
    )


def q_transcript_words(spark, d):
    words = word_ops.words_from_transcripts(_transcripts(spark, d), segments_as_words=True)
    return words.drop("characters")


def q_speaker_stats(spark, d):
    stats = speakers.speaker_stats(_words(spark, d))
    return stats.withColumn("seconds", F.col("seconds").cast("double"))


def q_speaker_remap(spark, d):
    return speakers.speaker_remap(_words(spark, d))


def q_remapped_sentences(spark, d):
    words = _words(spark, d)
    return speakers.remap_speakers(_sentences(spark, d), speakers.speaker_remap(words))


def q_sentences_punctuated(spark, d):
    return _sentence_rows(with_punctuation_tokens(_words(spark, d)))


def q_sentences_timing(spark, d):
    return _sentence_rows(_words(spark, d), timing=True)


def q_sentences_markers(spark, d):
    """Own marker set and limits, over words and punctuation tokens."""
    words = with_punctuation_tokens(_words(spark, d))
    return _sentence_rows(words, True, 0.7, 1.5, sql.OWN_MARKERS)


def q_sentences_pauses(spark, d):
    return _sentence_rows(_words(spark, d), timing=True, pause_detection=True)


def q_sentence_parts(spark, d):
    """Sentences in parts of 40 characters, from blocks of 64 words."""
    return words_to_sentences(_words(spark, d), limits=replace(DEFAULT_LIMITS, block_rows=64, part_chars=40))


def q_transcript_lines(spark, d):
    """The whole flow with speakers shown: ranked, the main one left out."""
    found = transform.sentences(_transcripts(spark, d), script="source")
    return speakers.tagged_lines(found).drop("part_no")


def q_text_sentences(spark, d):
    documents = _documents(spark, d)
    return texts_to_sentences(documents, key="doc_id").select("doc_id", "sent_no", "text")


def q_segment_sentences(spark, d):
    return segments_to_sentences(_transcripts(spark, d)).drop("speaker")


def q_main_speaker(spark, d):
    return speakers.main_speakers(_sentences(spark, d))


def q_tagged_lines(spark, d):
    return speakers.tagged_lines(_sentences(spark, d))


def q_all_tagged_lines(spark, d):
    return speakers.tagged_lines(_sentences(spark, d), tag_all=True)


def q_pause_detection(spark, d):
    found = with_pauses(_words(spark, d))
    return found.select("transcript_id", "idx", "speech_end", "pause_gap")


# -- cues ---------------------------------------------------------------------------


def q_cue_tokens(spark, d):
    tokens = word_ops.cue_tokens(with_punctuation_tokens(_words(spark, d)))
    return tokens.select("transcript_id", "idx", "text", "start", "end", "speaker")


def _runs(profile):
    def query(spark, d):
        tokens = word_ops.cue_tokens(_words(spark, d), pause_detection=True)
        return cue_runs(tokens, profile, oversize=_oversize(spark, d)).select("transcript_id", "idx", "breaks", "run")

    return query


def _cue_query(profile, pauses=False):
    return lambda spark, d: _cues(spark, d, profile, pauses)


def q_document_cues(spark, d):
    big = has_oversize(_documents(spark, d), "doc_id", "text")
    return words_to_cues(_document_words(spark, d), STANDARD, oversize=big)


def q_wrap_lines(spark, d):
    found = _sentences(spark, d)
    return found.select(
        "transcript_id", "sent_no", subtitles.wrap_two_lines(F.col("text")).alias("lines")
    )


# -- subtitle text --------------------------------------------------------------------


def q_timecodes(spark, d):
    items = _table(spark, d, "lineitem")
    seconds = F.col("l_extendedprice").cast("double") / 7.0
    return items.select(
        "l_orderkey", "l_linenumber", timecode.srt_timecode(seconds).alias("timecode")
    )


def q_srt_text(spark, d):
    recordings = _words(spark, d).select("transcript_id").distinct()
    return srt.subtitle_files(srt.standard_blocks(_cues(spark, d)), recordings)


def q_srt_cyrillic(spark, d):
    blocks = srt.standard_blocks(_cues(spark, d), transform.output_text(script="cyrillic"))
    return blocks


def q_srt_numbered(spark, d):
    return srt.numbered_blocks(_cues(spark, d))


def q_srt_basic(spark, d):
    return srt.subtitle_files(srt.basic_blocks(_cues(spark, d, BASIC)))


def q_srt_social_variants(spark, d):
    return srt.social_variants(_cues(spark, d, SOCIAL))


def q_srt_social_own(spark, d):
    """Script variants of a text that a transform of one's own has changed before."""
    return srt.social_variants(_cues(spark, d, SOCIAL), ("cyrillic", "raw"), transform=lambda t: F.concat(F.lit("- "), t))


def q_subtitle_lines(spark, d):
    files = srt.subtitle_files(srt.standard_blocks(_cues(spark, d)))
    return srt.text_lines(files, "srt_text", "transcript_id", "part_no")


def q_srt_to_cyrillic(spark, d):
    lines = srt.text_lines(spread(_table(spark, d, "pages")), "html", "page_id")
    return srt.lines_to_cyrillic(lines)


def q_streamed_cyrillic(spark, d):
    """The same rows from a stream of the table's files."""
    pages = stream_table(spark, f"{d}/pages.parquet")
    return run_to_table(srt.lines_to_cyrillic(srt.text_lines(pages, "html", "page_id")))


def q_streamed_runs(spark, d):
    """Runs of speech of the documents from a stream of landed words, each delivered twice."""
    folder = f"{shared_folder(spark)}/words/{uuid.uuid4().hex}"
    tokens = word_ops.cue_tokens(_document_words(spark, d)).drop("speaker")
    tokens.write.parquet(f"{folder}/a")
    landed = spark.read.parquet(f"{folder}/a")  # the words are worked out once
    landed.write.parquet(f"{folder}/b")
    closing_token(landed).write.parquet(f"{folder}/z")
    stream = spark.readStream.schema(tokens.schema).parquet(f"{folder}/*")
    return run_to_table(spoken_runs(stream, BASIC.gap_seconds))


def q_srt_files_to_cyrillic(spark, d):
    files = srt.subtitle_files(srt.standard_blocks(_cues(spark, d)))
    return srt.files_to_cyrillic(files, "srt_text")


# -- text jobs ------------------------------------------------------------------------


def q_tidy_spaces(spark, d):
    return _documents(spark, d).select("doc_id", text.tidy_spaces(F.col("text")).alias("text"))


def q_to_cyrillic(spark, d):
    return _cyrillic(spark, d)


def q_to_latin(spark, d):
    return _cyrillic(spark, d).select("doc_id", script.to_latin(F.col("text")).alias("text"))


def q_script_by_row(spark, d):
    mode = F.element_at(F.array(*[F.lit(m) for m in ("latin", "cyrillic", "source")]), (F.col("doc_id") % 3).cast("int") + 1)
    changed = script.in_script(F.col("text"), mode)
    return _seeded(spark, d).select("doc_id", mode.alias("mode"), changed.alias("text"))


def q_clean_text(spark, d):
    return _seeded(spark, d).select("doc_id", text.clean_text(F.col("text")).alias("text"))


def q_clean_summary(spark, d):
    """Rows that each rule of the clean-up changes, counted while the texts are rewritten."""
    seen = Observation()
    cleaned = transform.observed_clean(_seeded(spark, d), "text", seen, marker_breaks=True)
    cleaned.write.format("noop").mode("overwrite").save()
    return transform.rule_counts(spark, seen)


def q_clean_text_breaks(spark, d):
    cleaned = text.clean_text(F.col("text"), marker_breaks=True)
    return _seeded(spark, d).select("doc_id", cleaned.alias("text"))


def q_clean_tokens(spark, d):
    words = words_from_turns(_seeded(spark, d).withColumn("source", F.lit("s")), "doc_id", None, "source", "text")
    return words.select("transcript_id", "idx", text.clean_token(F.col("text")).alias("text"))


def q_clean_payload(spark, d):
    cleaned = transform.clean_transcripts(_transcripts(spark, d))
    return word_ops.words_from_transcripts(cleaned, segments_as_words=True).drop("characters")


def q_clean_json(spark, d):
    """Documents as JSON with a word and fields that nothing reads, cleaned, and read again."""
    word = F.struct(F.lit("man").alias("text"), F.lit(0.5).alias("start"), F.lit(-0.25).alias("logprob"))
    texts = _seeded(spark, d).join(_table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    body = F.to_json(F.struct("text", "lang", "n_chars", F.array(word).alias("words")))
    given = texts.select(
        F.col("doc_id").cast("string").alias("transcript_id"), F.lit("s").alias("stem"), F.parse_json(body).alias("raw")
    )
    again = F.parse_json("json")

    def field(path, kind):
        return F.variant_get(again, path, kind)

    return transform.clean_json(given).select(
        F.col("transcript_id").cast("bigint").alias("doc_id"),
        field("$.text", "string").alias("text"),
        field("$.lang", "string").alias("lang"),
        field("$.n_chars", "bigint").alias("n_chars"),
        field("$.words[0].text", "string").alias("word"),
        field("$.words[0].start", "double").alias("start"),
        field("$.words[0].logprob", "double").alias("logprob"),
    )


def q_output_names(spark, d):
    return transform.output_names(_transcripts(spark, d))


def q_untimed_words(spark, d):
    """Words whose start cannot be read; some starts are spoilt for that."""

    def spoilt(word, at):
        return word.withField("start", F.when(at % 97 == 5, "soon").otherwise(word["start"]))

    given = _transcripts(spark, d).withColumn("words", F.transform("words", spoilt))
    return word_ops.untimed_words(word_ops.words_from_transcripts(given))


def q_quarantine(spark, d):
    """Documents as transcript files, every 50th cut short."""
    body = F.to_json(F.struct("text", "lang"))
    cut = F.when(F.col("doc_id") % 50 == 0, F.expr("left(body, length(body) - 1)")).otherwise(F.col("body"))
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".json"))
    place = F.struct(F.concat(F.lit("/c/"), name).alias("file_path"), name.alias("file_name"))
    files = _documents(spark, d).select("doc_id", body.alias("body")).select(place.alias("_metadata"), cut.alias("value"))
    return quarantine(parsed(files)).select("transcript_id", "stem", "reason", F.length("content").alias("n_chars"))


def q_cyrillic_names(spark, d):
    pages = _table(spark, d, "pages")
    ending = F.element_at(F.array(*[F.lit(e) for e in sql.NAME_ENDINGS]), (F.col("page_id") % len(sql.NAME_ENDINGS)).cast("int") + 1)
    name = F.concat(F.lit("page "), F.col("page_id").cast("string"), ending)
    return pages.select("page_id", subtitles.cyrillic_file_name(name).alias("name"))


# -- files and whole flows --------------------------------------------------------------


def q_attachments(spark, d):
    items = att.attachments(_transcripts(spark, d), "json", "srt", "txt")
    kept = att.last_per_path(items)
    return kept.select(
        "transcript_id", "pos", "requested_format", "extension", "out_path",
        F.md5("content").alias("content_md5"),
    )


def q_supplied_formats(spark, d):
    return att.supplied_formats(att.attachments(_transcripts(spark, d), "json", "srt", "txt"))


def q_pending_work(spark, d):
    found = _transcripts(spark, d)
    written = att.last_per_path(att.attachments(found, "json", "srt", "txt"))
    stems = found.select(F.concat(F.lit("json/"), "stem", F.lit(".json")).alias("out_path"))
    existing = written.select("out_path").unionByName(stems)
    return incremental.pending(found.select("transcript_id", "stem"), existing, "json", "srt", "txt")


def _listing(spark, d):
    """Pages as a file listing: the host is the folder, the rest the name."""
    endings = F.array(*[F.lit(e) for e in sql.MEDIA_ENDINGS])
    ending = F.element_at(endings, (F.col("page_id") % len(sql.MEDIA_ENDINGS)).cast("int") + 1)
    base = F.regexp_replace("url", r"[^A-Za-z0-9/.]+", "_")
    return _table(spark, d, "pages").select("page_id", F.concat(base, ending).alias("path"))


def q_media_catalog(spark, d):
    return media_catalog(_listing(spark, d))


def q_path_regex(spark, d):
    listing = _listing(spark, d).withColumn("file_name", file_name(F.col("path")))
    return choose_names(listing, F.col("file_name"), (".json",), r"^[0-9]*[13579][^0-9].*[.][jJ]son$")


def q_combined_name(spark, d):
    return transform.combined_name(_transcripts(spark, d))


def q_combined_text(spark, d):
    return transform.combined_lines(transform.sentences(_transcripts(spark, d), script="source", ranked=False)).drop("part_no")


def q_sentence_files(spark, d):
    return transform.sentence_files(transform.sentences(_transcripts(spark, d), script="source", ranked=False))


def q_combined_manifest(spark, d):
    """Where each recording's text lies in the combined one."""
    return transform.combined_manifest(q_sentence_files(spark, d))


def q_output_totals(spark, d):
    words, big = _words(spark, d), _oversize(spark, d)
    return transform.output_totals(
        cues=words_to_cues(words, STANDARD, oversize=big),
        social_cues=words_to_cues(words, SOCIAL, oversize=big),
        sentences=words_to_sentences(words),
    )


def q_transcript_subtitles(spark, d):
    return transform.subtitles(_transcripts(spark, d), script="source")


def q_transcript_subtitles_clean(spark, d):
    return transform.subtitles(_transcripts(spark, d), clean=True, script="cyrillic")


def q_basic_subtitles(spark, d):
    """Basic subtitles for transcripts that brought no subtitle file of their own."""
    found = _transcripts(spark, d)
    supplied = att.supplied_formats(att.attachments(found, "json", "srt", "txt"))
    return transform.basic_subtitles(att.without_supplied(found, supplied, "srt"))


def queries() -> dict[str, Query]:
    """Every query by name: (spark, folder of tables) -> DataFrame."""
    found = {
        name.removeprefix("q_"): f
        for name, f in globals().items()
        if name.startswith("q_") and callable(f)
    }
    found["sentences_punct"] = _sentences
    for name, profile in PROFILES.items():
        found[f"cue_runs_{name}"] = _runs(profile)
        found[f"cues_{name}"] = _cue_query(profile)
        found[f"cues_{name}_pauses"] = _cue_query(profile, pauses=True)
    found["cues_basic_short"] = _cue_query(replace(BASIC, max_chars=60, max_seconds=3.0))
    found["cues_social_wide"] = _cue_query(replace(SOCIAL, gap_seconds=1.25))
    if llm:
        found |= llm.queries() | {"pipeline": corpus_pipeline.run}
    return found


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can state."""
    found = sql.statements()
    if llm:
        found |= llm.oracle_sql()
        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found


def entry(spark: SparkSession) -> DataFrame:
    """Numbered standard cues with time codes, straight from the words."""
    cues = _cues(spark, "/root/testdata/sf0.001")
    return cues.select(
        "transcript_id",
        "cue_no",
        timecode.srt_time_range(F.col("start"), F.col("end")).alias("times"),
        subtitles.wrap_two_lines(F.col("text")).alias("lines"),
    )
