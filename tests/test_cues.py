import dataclasses
import random

import brute
import pytest
from pyspark.sql import functions as F

from cueweave.operators.cues import cue_runs, tokens_to_cues
from cueweave.schemas import BASIC, SOCIAL, STANDARD, Limits

SCHEMA = (
    "transcript_id string, n_words long, idx long, text string, start double, end double, "
    "pause_after boolean"
)
PROFILES = {"standard": STANDARD, "social": SOCIAL, "basic": BASIC}
WORDS = ["a", "bb", "so", "bahor,", "daryo", "toshdi.", "kelajak", "yugurgandi,", "qani!", "va:", ".",
         ", x", "  ", " end. ", "suv-puv-da", "juda-juda-uzun-soz-" * 3, "u"]


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def frame(spark, recordings):
    rows = [
        (name, len(tokens), i * 2 + 1, *token)
        for name, tokens in recordings.items()
        for i, token in enumerate(tokens)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def cues_of(df):
    found = {}
    for t, no, start, end, text in rows_of(df, "transcript_id", "cue_no"):
        found.setdefault(t, []).append((start, end, text))
        assert no == len(found[t])
    return found


def random_recording(rng, size, gaps, words):
    tokens, at = [], 0
    for _ in range(size):
        at += rng.choice(gaps)
        text = rng.choice(words)
        end = at + rng.choice([0, 50, 120, 300, 450, 900])
        tokens.append((text, at / 1000.0, end / 1000.0, rng.random() < 0.2))
        at = end
    return tokens


@pytest.fixture(scope="module")
def recordings():
    rng = random.Random(5)
    gaps = [0, 20, 40, 40, 40, 600, 650, 700, 760, 900, 901, 1000, 2000]
    made = {f"r{n}": random_recording(rng, n * 7, gaps, WORDS) for n in range(1, 14)}
    # No pauses: one run as long as the recording.
    made["flat"] = random_recording(rng, 900, [0, 5], WORDS[:5] + ["kelajak", "va:", "bahor,"])
    made["even"] = [("abc", i * 0.05, i * 0.05 + 0.04, False) for i in range(700)]
    made["dots"] = [("ha.", i * 0.3, i * 0.3 + 0.2, False) for i in range(300)]
    made["short"] = [("ha", i * 1.5, i * 1.5 + 0.2, False) for i in range(400)]
    made["empty"] = random_recording(rng, 400, [0, 5], ["  ", " ", "ab", "  "])
    return made


@pytest.mark.parametrize("profile", list(PROFILES))
def test_cues_keep_the_rules(spark, recordings, profile):
    got = cues_of(tokens_to_cues(frame(spark, recordings), PROFILES[profile]))
    for name, tokens in recordings.items():
        assert brute.faults(tokens, got.get(name, []), profile) == [], name


@pytest.mark.parametrize("profile", list(PROFILES))
def test_a_copied_profile_is_the_same_profile(spark, recordings, profile):
    df = frame(spark, recordings)
    copy = dataclasses.replace(PROFILES[profile], name="copy")
    assert cues_of(tokens_to_cues(df, copy)) == cues_of(tokens_to_cues(df, PROFILES[profile]))


def test_words_without_a_count_are_not_lost(spark):
    df = frame(spark, {"x": [("bir", 0.0, 1.5, False)]}).withColumn("n_words", F.lit(None).cast("long"))
    assert cues_of(tokens_to_cues(df)) == {"x": [(0.0, 1.5, "bir")]}


@pytest.mark.parametrize("profile", list(PROFILES))
def test_oversize_recordings_give_the_same_cues(spark, recordings, profile):
    """Blocks of 32 positions and chunks of 90 items, so every boundary is crossed."""
    limits = Limits(recording_words=50, block_rows=32, chunk_items=90, route_chunks=3)
    df = frame(spark, recordings)
    assert cues_of(tokens_to_cues(df, PROFILES[profile], limits)) == cues_of(tokens_to_cues(df, PROFILES[profile]))


@pytest.mark.parametrize("profile", list(PROFILES))
def test_oversize_recordings_give_the_same_runs(spark, recordings, profile):
    df = frame(spark, recordings)
    whole = cue_runs(df, PROFILES[profile]).select("transcript_id", "idx", "breaks", "run")
    cut = cue_runs(df, PROFILES[profile], Limits(recording_words=10, block_rows=16)).select(
        "transcript_id", "idx", "breaks", "run"
    )
    assert rows_of(whole, "transcript_id", "idx") == rows_of(cut, "transcript_id", "idx")


def test_chunks_must_outsize_a_cue(spark, recordings):
    with pytest.raises(ValueError):
        tokens_to_cues(frame(spark, recordings), STANDARD, Limits(10, 32, 50))


def test_orphan_word_gets_company(spark):
    # Eleven words, half a second apart: ten fill 5.5 seconds, and the last would stand alone.
    tokens = [(f"soz{i:02}", i * 0.5, i * 0.5 + 0.5, False) for i in range(12)]
    got = cues_of(tokens_to_cues(frame(spark, {"x": tokens})))["x"]
    assert [len(c[2].split()) for c in got] == [10, 2]
    assert got == [
        (0.0, 5.5, " ".join(f"soz{i:02}" for i in range(10))),
        (5.5, 6.0, "soz10 soz11"),
    ]


def test_social_cues_by_hand(spark):
    # A comma ends a cue of 0.9 seconds or more; a full stop ends any; 2.6 seconds are the most.
    comma = [("tong", 1.0, 1.5, False), ("otdi,", 1.5, 2.0, False), ("kun", 2.0, 2.5, False), ("chiqdi", 2.5, 3.0, False)]
    long = [(f"s{i}", 10.0 + i, 11.0 + i, False) for i in range(4)]
    stop = [("Ha.", 0.0, 1.0, False), ("Bor", 1.0, 2.0, False), ("edi.", 2.0, 3.0, False)]
    got = cues_of(tokens_to_cues(frame(spark, {"comma": comma, "long": long, "stop": stop}), SOCIAL))
    assert got["comma"] == [(1.0, 2.0, "tong otdi,"), (2.0, 3.0, "kun chiqdi")]
    assert got["long"] == [(10.0, 12.0, "s0 s1"), (12.0, 14.0, "s2 s3")]
    assert got["stop"] == [(0.0, 1.0, "Ha."), (1.0, 3.0, "Bor edi.")]


def test_pause_flag_carry_over_differs_by_profile(spark):
    first = [("bir", 0.0, 0.2, True), ("ikki", 0.85, 1.0, False), ("uch", 1.1, 1.9, False)]
    after_stop = [("bir", 0.0, 0.5, True), ("ha.", 0.6, 1.6, False), ("ikki", 2.25, 3.5, False)]
    df = frame(spark, {"first": first, "stop": after_stop})
    runs = {
        name: [
            (r[0], r[1])
            for r in rows_of(
                cue_runs(df, p).filter("breaks").select("transcript_id", "idx"), "transcript_id", "idx"
            )
        ]
        for name, p in PROFILES.items()
    }
    assert ("first", 3) not in runs["standard"]
    assert ("first", 3) in runs["basic"] and ("first", 3) in runs["social"]
    assert ("stop", 5) in runs["social"] and ("stop", 5) not in runs["basic"]


def test_gap_limits_are_exclusive(spark):
    for profile, gap, splits in [
        ("standard", 0.875, False),
        ("standard", 1.0, True),
        ("social", 0.75, False),
        ("social", 0.875, True),
    ]:
        tokens = [("bir", 0.0, 0.5, False), ("ikki", 0.5 + gap, 1.0 + gap, False)]
        runs = cue_runs(frame(spark, {"x": tokens}), PROFILES[profile])
        assert (runs.filter("breaks").count() == 2) == splits


def test_empty_input(spark):
    for profile in PROFILES.values():
        assert tokens_to_cues(frame(spark, {}), profile).count() == 0
