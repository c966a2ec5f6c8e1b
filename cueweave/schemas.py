"""Read schemas and the fixed numbers of each subtitle profile."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Times are read as text because numeric strings are accepted; they become
# doubles when words are exploded.
CHARACTER_RAW = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("start", T.StringType()),
        T.StructField("end", T.StringType()),
    ]
)
WORD_RAW = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("start", T.StringType()),
        T.StructField("end", T.StringType()),
        T.StructField("speaker_id", T.StringType()),
        T.StructField("speaker", T.StringType()),
        T.StructField("characters", T.ArrayType(CHARACTER_RAW)),
    ]
)
SEGMENT_RAW = CHARACTER_RAW
ATTACHMENT = T.StructType(
    [
        T.StructField("requested_format", T.StringType()),
        T.StructField("file_extension", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("is_base64_encoded", T.BooleanType()),
    ]
)
PAYLOAD = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("words", T.ArrayType(WORD_RAW)),
        T.StructField("segments", T.ArrayType(SEGMENT_RAW)),
        T.StructField("additional_formats", T.ArrayType(ATTACHMENT)),
    ]
)


@dataclass(frozen=True)
class CueProfile:
    """Budgets of one way of cutting words into subtitle cues (seconds, characters)."""

    name: str
    max_chars: int
    max_seconds: float
    gap_seconds: float
    pause_gap_seconds: float = 0.6
    min_seconds: float | None = None
    max_words: int | None = None
    sentence_chars: int | None = None
    soft_chars: int | None = None
    soft_words: int | None = None
    soft_seconds: float | None = None
    tidied: bool = True  # spacing of the text is put right
    breaks_at_stops: bool = False  # a cue never goes on after a sentence end
    first_pause_counts: bool = True  # a pause after the first token may start a cue
    balanced: bool = False  # no cue of one word where the cue before can spare one


# Fixed values.
STANDARD = CueProfile(
    name="standard",
    max_chars=84,
    max_seconds=5.5,
    gap_seconds=0.9,
    min_seconds=1.0,
    sentence_chars=28,
    first_pause_counts=False,
    balanced=True,
)
SOCIAL = CueProfile(
    name="social",
    max_chars=60,
    max_seconds=2.6 + 1e-6,
    gap_seconds=0.75,
    min_seconds=0.9,
    max_words=9,
    soft_chars=20,
    soft_words=5,
    soft_seconds=0.9,
    breaks_at_stops=True,
)
BASIC = CueProfile(name="basic", max_chars=84, max_seconds=5.5, gap_seconds=0.9, tidied=False)
LINE_CHARS = 42


@dataclass(frozen=True)
class Limits:
    """How much of one recording a single task may hold.

    Recordings of at most ``recording_words`` words are worked on whole, one
    partition each.  Longer ones are cut into blocks of ``block_rows`` positions,
    and a packing run longer than ``chunk_items`` items is cut into chunks.
    ``route_chunks`` is the fan-in when chunk results are chained.
    Sentences of more than ``part_chars`` characters come in parts.
    """

    recording_words: int = 200_000
    block_rows: int = 32_768
    chunk_items: int = 16_384
    route_chunks: int = 1_024
    part_chars: int = 1 << 20


DEFAULT_LIMITS = Limits()
