import random

import brute
import pytest
from pyspark.sql import functions as F

from cueweave.operators.sentences import texts_to_sentences, words_to_sentences
from cueweave.operators.speakers import (
    main_speakers,
    remap_speakers,
    speaker_remap,
    speaker_stats,
    tagged_lines,
)
from cueweave.plans import transform
from cueweave.schemas import Limits
from cueweave.sources.derived import transcripts_from_documents

CHARACTERS = "array<struct<text:string,start:double,end:double>>"
SCHEMA = (
    "transcript_id string, n_words long, idx long, type string, text string, start double, "
    f"end double, speaker string, characters {CHARACTERS}"
)
TEXTS = ["keyin", "Shunda,", "bir", "uch.", "to'rt!", "  ", " va ", "lekin?", "olti", ";", "«mana»", "yetti…"]


def words(spark, recordings):
    rows = [
        (name, len(tokens), i, kind, text, start, end, speaker, None)
        for name, tokens in recordings.items()
        for i, (kind, text, start, end, _, speaker) in enumerate(tokens)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def found(df):
    out = {}
    for row in df.orderBy("transcript_id", "sent_no").collect():
        out.setdefault(row.transcript_id, []).append((row.text, row.speaker))
        assert row.sent_no == len(out[row.transcript_id])
    return out


@pytest.fixture(scope="module")
def recordings():
    rng = random.Random(11)
    made = {}
    for n in range(1, 12):
        tokens, at = [], 0
        for _ in range(n * 9):
            at += rng.choice([0, 40, 600, 900, 950, 1800, 2000])
            kind = rng.choice(["word"] * 6 + ["punctuation", "spacing"])
            text = rng.choice([".", ",", "?"]) if kind == "punctuation" else rng.choice(TEXTS)
            end = at + rng.choice([50, 200])
            tokens.append((kind, text, at / 1000, end / 1000, False, rng.choice(["a", "b", "c", "", None])))
            at = end
        made[f"r{n:02}"] = tokens
    made["no-stop"] = [("word", "so", i * 1.0, i + 0.9, False, "ab"[i % 2]) for i in range(200)]
    return made


@pytest.mark.parametrize("timing", [False, True])
@pytest.mark.parametrize("limits", [Limits(), Limits(recording_words=20, block_rows=8)])
def test_sentences_match_brute_force(spark, recordings, timing, limits):
    got = found(words_to_sentences(words(spark, recordings), timing=timing, limits=limits))
    for name, tokens in recordings.items():
        assert got.get(name, []) == brute.sentences(tokens, timing), name


def test_pause_before_marker_splits(spark):
    tokens = [
        ("word", t, s, e, False, "x")
        for t, s, e in [
            ("bugun", 0.0, 0.2), ("kelganman", 0.25, 0.5), ("gaplashamiz", 0.55, 0.8),
            ("keyin", 2.0, 2.2), ("yana", 2.25, 2.4), ("davom", 2.45, 2.7),
        ]
    ]
    df = words(spark, {"r": tokens})
    assert len(found(words_to_sentences(df))["r"]) == 1
    timed = found(words_to_sentences(df, timing=True))["r"]
    assert len(timed) == 2 and timed[1][0].startswith("keyin")


def test_speaker_ranking_and_names(spark):
    tokens = [
        ("word", "a", 0.0, 1.0, False, "x"),
        ("word", "b.", 1.0, 2.0, False, "y"),
        ("word", "c", 2.0, 2.5, False, "y"),
        ("word", "d.", 2.5, 3.0, False, "z"),
        ("word", "e.", 3.0, 2.0, False, ""),
        ("punctuation", "!", 3.0, 9.0, False, "q"),
    ]
    df = words(spark, {"r": tokens})
    stats = {r.speaker: (float(r.seconds), r.n_spoken, r.first_idx) for r in speaker_stats(df).collect()}
    assert stats == {"x": (1.0, 1, 0), "y": (1.5, 2, 1), "z": (0.5, 1, 3)}
    remap = speaker_remap(df)
    assert {r.speaker: r.label for r in remap.collect()} == {"y": "speaker_0", "x": "speaker_1", "z": "speaker_2"}
    sentences = words_to_sentences(df)
    named = found(remap_speakers(sentences, remap))["r"]
    # Ties go to the speaker heard first.
    assert named == [("a b.", "speaker_1"), ("c d.", "speaker_0"), ("e.", None), ("!", None)]
    assert main_speakers(sentences).collect()[0].main_speaker == "x"
    lines = [r.line for r in tagged_lines(sentences).orderBy("sent_no").collect()]
    assert lines == ["a b.", "[y] c d.", "e.", "!"]
    everyone = [r.line for r in tagged_lines(sentences, tag_all=True).orderBy("sent_no").collect()]
    assert everyone == ["[x] a b.", "[y] c d.", "e.", "!"]
    hidden = [r.line for r in tagged_lines(sentences, hide_speakers=True).orderBy("sent_no").collect()]
    assert hidden == ["a b.", "c d.", "e.", "!"]


def test_plain_text_sentences(spark):
    df = spark.createDataFrame(
        [("t", "  Bir ikki .  Uch?! To'rt…besh…  olti "), ("e", " \n")], "transcript_id string, text string"
    )
    got = [r.text for r in texts_to_sentences(df).orderBy("sent_no").collect()]
    assert got == ["Bir ikki.", "Uch?!", "To'rt…besh…", "olti"]


def whole(df):
    """Texts put together from their parts, as ``found`` gives them."""
    out = {}
    for row in df.orderBy("transcript_id", "sent_no", "part_no").collect():
        got = out.setdefault(row.transcript_id, [])
        if row.sent_no > len(got):
            assert row.part_no == 0 and row.sent_no == len(got) + 1
            got.append((row.text, row.speaker))
        else:
            assert row.sent_no == len(got) and row.speaker == got[-1][1]
            got[-1] = (got[-1][0] + row.text, row.speaker)
    return out


@pytest.mark.parametrize(("block_rows", "timing"), [(1, True), (7, False)])
def test_parts_in_order_are_the_text(spark, recordings, timing, block_rows):
    df = words(spark, recordings)
    limits = Limits(block_rows=block_rows, part_chars=9)
    parts = words_to_sentences(df, timing=timing, limits=limits, ranked=True)
    plain = remap_speakers(words_to_sentences(df, timing=timing), speaker_remap(df))
    assert whole(parts) == found(plain)
    assert parts.filter("part_no > 0").count() > 50
    assert all(len(r.text) <= 9 + 8 for r in parts.collect())  # a part ends with the token that fills it


def test_one_recording_with_half_of_all_words(spark):
    """A sentence of 600,000 words in one recording, the other words in 300 recordings."""
    n = 600_000
    spoken = F.when(F.col("id") < n, F.lit("long")).otherwise(F.concat(F.lit("r"), F.col("id") % 300))
    at = F.when(F.col("id") < n, F.col("id")).otherwise(F.floor((F.col("id") - n) / 300))
    df = spark.range(2 * n).select(
        spoken.alias("transcript_id"), F.lit(n).cast("long").alias("n_words"), at.alias("idx"), F.lit("word").alias("type"),
        F.concat(F.lit("so"), F.col("id") % 10).alias("text"), (at * 0.5).alias("start"), (at * 0.5 + 0.4).alias("end"),
        F.when(at % 5 < 3, "a").otherwise("b").alias("speaker"), F.lit(None).cast(CHARACTERS).alias("characters"),
    )
    limits = Limits(block_rows=4_096, part_chars=1 << 15)
    parts = words_to_sentences(df, limits=limits, ranked=True).withColumn("task", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = sorted(parts.filter("transcript_id = 'long'").collect(), key=lambda r: r.part_no)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert "".join(r.text for r in rows) == " ".join(f"so{i % 10}" for i in range(n))
    assert {(r.sent_no, r.speaker) for r in rows} == {(1, "speaker_0")}
    assert len(rows) == -(-4 * n // (1 << 15)) and len({r.task for r in rows}) > 1
    assert parts.filter("transcript_id <> 'long'").count() == 300
    assert words_to_sentences(df.limit(0), limits=limits).count() == 0


def test_flow_moves_words_once(spark):
    """Words are read, and dealt to blocks, once: ranks, numbers and long sentences included."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    with_words = transcripts_from_documents(docs.filter("doc_id % 3 <> 0"))
    lines = tagged_lines(transform.sentences(with_words, script="source"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that reuse shows before the run
        plan = lines._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    dealt = [line for line in plan if "REPARTITION_BY_COL" in line and "ReusedExchange" not in line]
    scans = [line for line in plan if "FileScan" in line]
    assert len(dealt) == 1 and len(scans) == 2  # of words, and of segments where there are no words


@pytest.mark.parametrize("ranked", [True, False])
def test_outputs_deal_words_once(spark, ranked):
    """Tagged lines look at the sentences twice, outputs without speakers read fewer columns: words move once all the same."""
    documents = spark.createDataFrame([(1, "Bir ikki. Uch to'rt!", "a"), (2, "Besh olti", "b")], "doc_id long, text string, source string")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that reuse shows before the run
        lines = tagged_lines(transform.sentences(transcripts_from_documents(documents), ranked=ranked), hide_speakers=not ranked)
        plan = lines._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len([line for line in plan if "REPARTITION_BY_COL" in line and "ReusedExchange" not in line]) == 1
