import base64
import hashlib
import json
import mimetypes
import random
import re

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from cueweave.operators import attachments as att
from cueweave.operators import ordered
from cueweave.functions.text import clean_text
from cueweave.operators.cues import cue_runs, words_to_cues
from cueweave.operators.subtitles import (
    files_to_cyrillic,
    lines_to_cyrillic,
    standard_blocks,
    subtitle_files,
    text_lines,
)
from cueweave.operators.speakers import tagged_lines
from cueweave.operators.words import cue_tokens, untimed_words, words_from_transcripts
from cueweave.plans import incremental, transform
from cueweave.plans.writing import write_combined, write_parts, write_table
from cueweave.schemas import BASIC
from cueweave.sources.derived import transcripts_from_documents
from cueweave.sources.files import media_files
from cueweave.sources.subtitles import read_subtitle_lines, read_subtitles
from cueweave.sources.tables import words_from_turns
from cueweave.sources.transcripts import (
    land_words,
    quarantine,
    read_transcripts,
    readable,
    stem_clashes,
)
from cueweave.streaming.ingest import run_incrementally, stream_transcripts
from cueweave.streaming.tables import closing_token, run_to_table, spoken_runs, stream_table


def word(text, start, end, **more):
    return {"type": "word", "text": text, "start": start, "end": end, **more}


SPOKEN = {
    "text": "man manga yozdim keyin xudo haqida kitob oldim",
    "language": "uzb",
    "words": [
        word("man", 0.0, 0.2, speaker="x"),
        word("manga", 0.25, 0.4, speaker="x"),
        word("yozdim", 0.45, 0.9, speaker="x"),
        word("keyin", 2.0, 2.2, speaker="y"),
        word("xudo", 2.25, 2.4, speaker="y"),
        word("haqida", "2.45", "2.7", speaker_id="y"),
        {"type": "spacing", "text": " ", "start": 2.7, "end": 2.75},
        word("kitob", 2.75, 3.0),
        word("oldim", 3.05, 3.5),
    ],
    "additional_formats": [
        {"requested_format": "srt", "file_extension": ".SRT", "content": "first", "is_base64_encoded": False},
        {"requested_format": "srt", "file_extension": "srt", "content": "second"},
        {"requested_format": "docx", "content": base64.b64encode(b"\x00\xff").decode(), "is_base64_encoded": True},
        {"requested_format": "segmented_json", "file_extension": "json", "content": "{}"},
        {"requested_format": "html", "file_extension": "json", "content": "{}"},
        {"requested_format": None, "file_extension": None, "content": "lost"},
        {"requested_format": "pdf", "content": None},
    ],
}
SEGMENTS = {"segments": [{"text": " Bir ikki. ", "start": 0, "end": 2.5}, {"text": "Uch", "start": 3.6, "end": 4}]}
NAMES = ["Radio suhbat 1 tong.json", "Radio suhbat 2 tush.json", "Radio suhbat 3 kech.json"]


@pytest.fixture()
def corpus(tmp_path):
    folder = tmp_path / "JSON"
    folder.mkdir()
    for name, payload in zip(NAMES, [SPOKEN, SEGMENTS, {"words": []}]):
        (folder / name).write_text(json.dumps(payload, indent=2), encoding="utf-8")
    (folder / "notes.txt").write_text("x")
    return folder


def test_path_selection(spark, corpus):
    def stems(path, **more):
        return [r.stem for r in read_transcripts(spark, str(path), **more).orderBy("transcript_id").collect()]

    assert stems(corpus) == [n[:-5] for n in NAMES]
    assert stems(f"{corpus}/^Radio suhbat [12] .*[.]json$") == [n[:-5] for n in NAMES[:2]]
    assert stems(corpus / NAMES[2]) == [NAMES[2][:-5]]
    assert stems(corpus, glob="*1*.json") == [NAMES[0][:-5]]
    for path in (f"{corpus}/missing", f"{corpus}/^none.*$", f"{corpus}/away/x.json", f"{corpus}/notes.txt"):
        with pytest.raises(FileNotFoundError):
            read_transcripts(spark, path)
    with pytest.raises(ValueError):
        read_transcripts(spark, f"{corpus}/(")


def test_names_that_spark_skips_are_refused(spark, corpus):
    (corpus / "_draft.json").write_text("{}", encoding="utf-8")
    with pytest.raises(ValueError):
        read_transcripts(spark, str(corpus))


def test_output_names(spark, corpus):
    names = transform.output_names(read_transcripts(spark, f"{corpus}/{NAMES[0]}")).collect()
    stem = NAMES[0][:-5]
    assert {r.output: r.out_name for r in names} == {
        "standard": f"{stem}.srt",
        "numbered": f"{stem}.sentence.srt",
        "social_cyrillic": f"{stem}_social_cyrillic.srt",
        "social_latin": f"{stem}_social_latin.srt",
        "social_raw": f"{stem}_social_raw.srt",
        "sentences": f"{stem}.txt",
        "clean_json": f"{stem}_uz_clean.json",
    }


def test_unknown_fields_survive_in_raw(spark, corpus):
    df = read_transcripts(spark, str(corpus), keep_raw=True)
    language = df.select(F.try_variant_get("raw", "$.language", "string").alias("v")).collect()
    assert {r.v for r in language} == {"uzb", None}
    plain = read_transcripts(spark, str(corpus))
    assert df.drop("raw").exceptAll(plain).isEmpty() and plain.exceptAll(df.drop("raw")).isEmpty()


def test_bad_files_are_set_aside(spark, corpus):
    (corpus / "bad.json").write_text('{"words": [', encoding="utf-8")
    (corpus / "empty.json").write_text("\n", encoding="utf-8")
    df = read_transcripts(spark, str(corpus))
    assert readable(df).count() == 3
    assert sorted((r.stem, r.reason) for r in quarantine(df).collect()) == [
        ("bad", "malformed JSON"),
        ("empty", "malformed JSON"),
    ]


def test_words_of_transcripts(spark, corpus):
    df = read_transcripts(spark, str(corpus))
    words = words_from_transcripts(df)
    assert words.count() == 9
    rows = {r.idx: r for r in words.collect()}
    assert (rows[5].start, rows[5].end, rows[5].speaker) == (2.45, 2.7, "y")
    assert rows[7].speaker is None and rows[0].n_words == 9
    with_segments = words_from_transcripts(df, segments_as_words=True)
    assert with_segments.count() == 11
    assert cue_tokens(words).count() == 8


def test_unreadable_times(spark):
    rows = [("a", "s", None, [word("x", "oops", "1"), word("y", "1", "oops"), word("z", None, None), word("v", "1d", "2")], None, None, None)]
    schema = (
        "transcript_id string, stem string, text string, words array<struct<type:string,text:string,start:string,"
        "end:string,speaker_id:string,speaker:string,characters:array<struct<text:string,start:string,end:string>>>>, "
        "segments array<struct<text:string,start:string,end:string>>, additional_formats array<struct<requested_format:"
        "string,file_extension:string,content:string,is_base64_encoded:boolean>>, _corrupt_record string"
    )
    fields = ("type", "text", "start", "end", "speaker_id", "speaker", "characters")
    rows = [(*r[:3], [tuple(w.get(f) for f in fields) for w in r[3]], *r[4:]) for r in rows]
    words = words_from_transcripts(spark.createDataFrame(rows, schema))
    assert [(r.text, r.start, r.end) for r in words.orderBy("idx").collect()] == [
        ("x", None, 0.0), ("y", 1.0, 1.0), ("z", 0.0, 0.0), ("v", None, 0.0),
    ]
    assert sorted(r.text for r in untimed_words(words).collect()) == ["v", "x"]
    assert [r.text for r in cue_tokens(words).orderBy("idx").collect()] == ["y", "z"]


def test_standard_subtitles(spark, corpus):
    df = read_transcripts(spark, str(corpus))
    files = {r.transcript_id.rsplit("/", 1)[-1]: r.srt_text for r in transform.subtitles(df, script="source").collect()}
    assert files[NAMES[0]] == (
        "1\n00:00:00,000 --> 00:00:00,900\nman manga yozdim\n\n"
        "2\n00:00:02,000 --> 00:00:03,500\nkeyin xudo haqida kitob oldim\n"
    )
    assert files[NAMES[1]] == files[NAMES[2]] == ""
    numbered = transform.numbered_subtitles(df).filter("srt_text <> ''").collect()
    assert numbered[0].srt_text.split("\n")[2::4] == ["1", "2"]
    basic = transform.basic_subtitles(df).filter(F.col("transcript_id").endswith(NAMES[1])).collect()
    assert basic[0].srt_text == (
        "1\n00:00:00,000 --> 00:00:02,500\nBir ikki.\n\n2\n00:00:03,600 --> 00:00:04,000\nUch\n"
    )


def test_clean_flow(spark, corpus):
    df = read_transcripts(spark, str(corpus))
    whole = read_transcripts(spark, str(corpus), keep_raw=True)
    cleaned = {r.out_name: json.loads(r.json) for r in transform.clean_json(whole).collect()}
    payload = cleaned[NAMES[0][:-5] + "_uz_clean.json"]
    assert payload["text"].startswith("Men menga yozdim") and "Xudo haqida" in payload["text"]
    assert [w["text"] for w in payload["words"]][:2] == ["men", "menga"]
    assert payload["words"][0]["start"] == 0.0 and payload["words"][5]["start"] == "2.45"
    assert payload["language"] == "uzb" and payload["additional_formats"] == SPOKEN["additional_formats"]
    for before, after in zip(SPOKEN["words"], payload["words"], strict=True):
        assert {k: v for k, v in before.items() if k != "text"} == {k: v for k, v in after.items() if k != "text"}
    found = transform.sentences(df, clean=True)
    texts = {r.transcript_id.rsplit("/", 1)[-1]: r.txt for r in transform.sentence_files(found).collect()}
    assert texts == {NAMES[0]: "Men menga yozdim\nKeyin Xudo haqida kitob oldim\n", NAMES[1]: "Bir ikki.\nUch\n"}
    speakers = {r.speaker for r in found.collect()}
    assert speakers == {"speaker_0", "speaker_1", None}
    lines = [r.line for r in transform.combined_lines(found).collect()]
    assert lines == ["Men menga yozdim", "Keyin Xudo haqida kitob oldim", "Bir ikki.", "Uch"]
    assert json.loads((corpus / NAMES[0]).read_text()) == SPOKEN


def test_social_variants(spark, corpus):
    df = read_transcripts(spark, f"{corpus}/{NAMES[0]}")
    got = {r.variant: r.srt_text for r in transform.social_subtitles(df).collect()}
    assert "ман манга ёздим" in got["cyrillic"] and "man manga yozdim" in got["latin"] == got["raw"]


def test_file_parts_join_to_the_file(spark, corpus):
    cues = words_to_cues(words_from_transcripts(read_transcripts(spark, str(corpus))))
    whole = subtitle_files(standard_blocks(cues)).collect()[0].srt_text
    parts = subtitle_files(standard_blocks(cues), part_cues=1).orderBy("part_no").collect()
    assert len(parts) == 2 and "".join(p.srt_text for p in parts) == whole


@pytest.mark.parametrize(
    "stems, name",
    [
        (["a - 1", "a - 2"], "a_comb.txt"),
        (["only. "], "only_comb.txt"),
        (["x", "y"], "combined.txt"),
        (["--"], "combined.txt"),
        ([], "combined.txt"),
        (["ab", "ab c", "ab d"], "ab_comb.txt"),
    ],
)
def test_combined_name(spark, stems, name):
    df = spark.createDataFrame([(s,) for s in stems], "stem string")
    assert transform.combined_name(df).collect()[0].out_name == name


def test_attachments(spark, corpus):
    df = read_transcripts(spark, f"{corpus}/{NAMES[0]}")
    items = att.attachments(df, "j", "s")
    stem = NAMES[0][:-5]
    kept = {r.out_path: bytes(r.content) for r in att.last_per_path(items).collect()}
    assert kept == {
        f"s/{stem}.srt": b"second",
        f"j/{stem}.docx": b"\x00\xff",
        f"j/{stem}.segmented.json": b"{}",
        f"j/{stem}.html.json": b"{}",
    }
    supplied = att.supplied_formats(items)
    assert {r.format for r in supplied.collect()} == {"srt", "docx", "segmented_json", "json", "html"}
    assert att.without_supplied(df, supplied, "srt").isEmpty()
    assert att.without_supplied(df, supplied, "txt").count() == 1


def test_only_unfinished_work_is_pending(spark):
    recordings = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "transcript_id string, stem string")
    existing = spark.createDataFrame([("j/a.json",), ("s/a.srt",), ("j/b.json",)], "out_path string")
    left = incremental.pending(recordings, existing, "j", "s")
    assert sorted(r.stem for r in left.collect()) == ["b", "c"]
    assert [r.stem for r in incremental.pending(recordings, existing, "j").collect()] == ["c"]
    assert incremental.pending(recordings, existing, "j", overwrite=True).count() == 3


def test_media_catalog(spark, tmp_path):
    for name in ("b.MP3", "a.webm", "c.txt", "d"):
        (tmp_path / name).write_bytes(b"123")
    got = media_files(spark, str(tmp_path)).orderBy("file_name").collect()
    assert [(r.file_name, r.stem, r.length, r.mime_type) for r in got] == [
        ("a.webm", "a", 3, mimetypes.guess_type("a.webm")[0] or "audio/webm"),
        ("b.MP3", "b", 3, "audio/mpeg"),
    ]
    assert media_files(spark, f"{tmp_path}/^a.*$").count() == 1
    with pytest.raises(FileNotFoundError):
        media_files(spark, f"{tmp_path}/c.txt")


def test_subtitle_files_to_cyrillic(spark, tmp_path):
    body = "1\n00:00:01,000 --> 00:00:02,000\n<i>Salom</i> do'st\n\n2\r\n00:00:03,000 --> 00:00:04,000\n<b>Skoriy</b> kelyapti\n"
    (tmp_path / "a_latin.srt").write_bytes(body.encode())
    (tmp_path / "b.srt").write_bytes(b"x")
    files = read_subtitles(spark, str(tmp_path))
    assert files.count() == 1
    row = files_to_cyrillic(files, "srt_text").collect()[0]
    assert row.cyrillic_name == "a_cyrillic.srt"
    assert row.srt_text == body.replace("\r", "").replace("Salom", "Салом").replace("do'st", "дўст").replace(
        "Skoriy", "Скорий"
    ).replace("kelyapti", "келяпти")
    lines = lines_to_cyrillic(read_subtitle_lines(spark, str(tmp_path))).orderBy("line_no").collect()
    assert "\n".join(r.line for r in lines) + "\n" == row.srt_text
    odd = spark.createDataFrame([(1, "a\x0bb\x85c \r\nd"), (2, ""), (3, "\n")], "k int, t string")
    assert [(r.k, r.line) for r in text_lines(odd, "t", "k").orderBy("k", "line_no").collect()] == [
        (1, "a"), (1, "b"), (1, "c"), (1, ""), (1, "d"), (3, ""),
    ]


def test_sinks(spark, corpus, tmp_path):
    df = read_transcripts(spark, str(corpus)).withColumn("transcript_id", F.col("stem"))
    files = transform.subtitles(df, script="source").filter("srt_text <> ''")
    write_parts(files, f"{tmp_path}/srt", ("transcript_id",), "srt_text")
    back = spark.read.text(f"{tmp_path}/srt", wholetext=True).collect()
    assert [r.value for r in back] == [r.srt_text for r in files.collect()]
    found = transform.sentences(df, script="source")
    write_combined(transform.combined_lines(found), f"{tmp_path}/all", single_file=True)
    assert spark.read.text(f"{tmp_path}/all").count() == found.count()
    write_table(found, f"{tmp_path}/table", "speaker")
    assert spark.read.parquet(f"{tmp_path}/table").count() == found.count()
    clash = df.unionByName(df.withColumn("transcript_id", F.lit("other")))
    assert stem_clashes(clash).count() == 3
    totals = {r.output: (r.n_rows, r.n_transcripts) for r in transform.output_totals(a=found, b=files).collect()}
    assert totals == {"a": (3, 2), "b": (1, 1)}


def test_landed_words_need_no_exchange(spark, corpus):
    words = words_from_transcripts(read_transcripts(spark, str(corpus)))
    expected = words_to_cues(words, oversize=False).collect()
    try:
        land_words(words, "cueweave_words", 4)
        cues = words_to_cues(spark.table("cueweave_words"), oversize=False)
        assert "Exchange" not in cues._jdf.queryExecution().executedPlan().toString()
        assert sorted(cues.collect()) == sorted(expected)
    finally:
        spark.sql("DROP TABLE IF EXISTS cueweave_words")


def test_stream_equals_batch(spark, corpus, tmp_path):
    jobs = {"srt": lambda t: transform.subtitles(t), "sentences": lambda t: transform.sentences(t)}
    out = f"{tmp_path}/out"

    def run():
        stream = stream_transcripts(spark, str(corpus))
        query = run_incrementally(stream, jobs, out, f"{tmp_path}/state")
        query.awaitTermination()

    run()
    (corpus / "late.json").write_text(json.dumps(SPOKEN), encoding="utf-8")
    (corpus / "late bad.json").write_text("{\n", encoding="utf-8")
    run()
    batch = readable(read_transcripts(spark, str(corpus)))
    for name, job in jobs.items():
        streamed = spark.read.parquet(f"{out}/{name}").drop("batch_id")
        path = F.regexp_replace("transcript_id", "^file:/+", "/")
        left = streamed.withColumn("transcript_id", path)
        right = job(batch).withColumn("transcript_id", path)
        assert left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()
    assert [r.stem for r in spark.read.parquet(f"{out}/quarantine").collect()] == ["late bad"]


def test_row_jobs_on_a_stream(spark, tmp_path):
    source, out = tmp_path / "lines", tmp_path / "out"
    source.mkdir()
    (source / "a.txt").write_text("1\nsalom\n")
    stream = lines_to_cyrillic(spark.readStream.text(str(source)), "value")
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start(str(out))
    )
    query.awaitTermination()
    assert sorted(r.value for r in spark.read.parquet(str(out)).collect()) == ["1", "салом"]


def test_own_transform_of_social_files(spark, corpus):
    df = read_transcripts(spark, f"{corpus}/{NAMES[0]}")
    got = {r.variant: r.srt_text for r in transform.social_subtitles(df, transform=lambda t: F.concat(t, F.lit(" ha"))).collect()}
    assert "yozdim ha" in got["raw"] and "ёздим ҳа" in got["cyrillic"]
    for name, plain in {r.variant: r.srt_text for r in transform.social_subtitles(df).collect()}.items():
        assert got[name].count("\n") == plain.count("\n")


def test_clean_up_counts_what_it_changes(spark):
    texts = ["man manga boraman", "Toza gap.", "iso masih  bilan", None, "qur'on. keyin", "Bir Keyin ikki"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    seen = Observation()
    out = transform.observed_clean(df, "t", seen, marker_breaks=True)
    want = df.select("k", clean_text(F.col("t"), marker_breaks=True).alias("t"))
    assert out.columns == df.columns and sorted(out.collect()) == sorted(want.collect())
    counts = {r.rule: (r.step, r.n_changed, r.n_rows) for r in transform.rule_counts(spark, seen).collect()}
    assert counts["spacing"] == (1, 1, 6) and counts["common_words"] == (3, 1, 6) and counts["names"] == (4, 2, 6)
    assert counts["breaks"] == (5, 1, 6) and counts["capitals"][1] == 2  # the first text begins a sentence too
    assert "breaks" not in {r.rule for r in transform.rule_counts(spark, _observed(df)).collect()}


def _observed(df):
    seen = Observation()
    transform.observed_clean(df, "t", seen).collect()
    return seen


TOKENS = "transcript_id string, n_words long, idx long, text string, start double, end double, pause_after boolean"


def test_runs_on_a_stream_equal_the_batch_rule(spark, tmp_path):
    """Words in pieces, out of order within the lateness, some delivered twice."""
    rng = random.Random(8)
    rows = []
    for rec in "abc":
        at = 0
        for i in range(120):
            at += rng.choice([0, 40, 899, 900, 901, 2_000])
            rows.append((rec, 120, 3 * i, "so", at / 1000, (at + 300) / 1000, False))
            at += 300
    pieces = [rows[i::4] + rows[:5] for i in range(4)]
    for i, piece in enumerate(pieces):
        spark.createDataFrame(piece, TOKENS).coalesce(1).write.parquet(f"{tmp_path}/in/p{i}")
    tokens = spark.createDataFrame(rows, TOKENS)
    closing_token(tokens).write.parquet(f"{tmp_path}/in/z")
    stream = spark.readStream.schema(tokens.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    found = run_to_table(spoken_runs(stream, BASIC.gap_seconds), f"{tmp_path}/out")
    runs = cue_runs(tokens, BASIC).groupBy("transcript_id", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_words")
    )
    assert sorted(found.collect()) == sorted(runs.collect())
    again = run_to_table(spoken_runs(stream, BASIC.gap_seconds), f"{tmp_path}/out")  # nothing new: nothing twice
    assert again.count() == found.count()


def test_stream_of_a_table(spark):
    path = "/root/testdata/sf0.001/pages.parquet"
    pages = spark.read.parquet(path)
    lines = lambda df: lines_to_cyrillic(text_lines(df, "html", "page_id"))
    assert sorted(run_to_table(lines(stream_table(spark, path))).collect()) == sorted(lines(pages).collect())


def test_parts_at_their_offsets_are_the_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = transform.sentences(transcripts_from_documents(docs), script="source")
    files = transform.sentence_files(found, part_lines=7)
    texts = {(r.transcript_id, r.part_no): r.txt.encode() for r in files.collect()}
    whole = "".join(r.line + "\n" for r in transform.combined_lines(found).collect()).encode()
    rows = transform.combined_manifest(files).collect()
    assert len(rows) == len(texts) and sum(r.n_bytes for r in rows) == len(whole)
    for r in rows:
        text = texts[r.transcript_id, r.part_no]
        assert whole[r.byte_offset : r.byte_offset + r.n_bytes] == text and r.md5 == hashlib.md5(text).hexdigest()
    assert transform.combined_manifest(files.limit(0)).count() == 0


@pytest.fixture
def stored_documents(spark, tmp_path):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["Kitob", "oldim.", "u", "keldi,", "!"]) for _ in range(rng.randrange(400))) for _ in range(60)]
    rows = [(i, text if i % 10 else None, "s") for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents")
    return spark.read.parquet(f"{tmp_path}/documents")


def _same_in_many_parts(monkeypatch, documents, flow):
    """Rows of a flow with the session's parts, and then with parts by the size of the files; that plan, and its parts."""
    plain = sorted(flow().collect())
    monkeypatch.setattr(ordered, "TASK_BYTES", ordered.bytes_read(documents) // 12)
    parts = ordered.task_parts(documents)
    assert 12 <= parts <= 13
    found = flow()
    assert sorted(found.collect()) == plain
    return found._jdf.queryExecution().executedPlan().toString(), parts


@pytest.mark.parametrize("kind", ["subtitles", "turns"])
def test_cues_are_made_in_parts_that_fit_a_task(spark, monkeypatch, stored_documents, kind):
    def flow():
        if kind == "subtitles":
            return transform.subtitles(transcripts_from_documents(stored_documents), script="source")
        return words_to_cues(words_from_turns(stored_documents, "doc_id", None, "source", "text"), oversize=False)

    plan, parts = _same_in_many_parts(monkeypatch, stored_documents, flow)
    assert set(re.findall(r"hashpartitioning\(transcript_id#\d+, (\d+)\), REPARTITION", plan)) == {str(parts)}


def test_sentences_are_made_in_parts_that_fit_a_task(spark, monkeypatch, stored_documents):
    """And no join deals the words a second time, into other parts."""

    def flow():
        return tagged_lines(transform.sentences(transcripts_from_documents(stored_documents), script="source"))

    plan, parts = _same_in_many_parts(monkeypatch, stored_documents, flow)
    assert set(re.findall(r"hashpartitioning\(transcript_id#\d+, block#\d+L, (\d+)\), REPARTITION", plan)) == {str(parts)}
