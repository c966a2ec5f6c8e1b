import importlib

import pytest

from cueweave.sources.tables import has_oversize, words_from_turns
from cueweave.schemas import Limits

entry = importlib.import_module("__spark_entry__")


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["transcript_id", "cue_no", "times", "lines"]
    assert df.count() > 0


def test_words_run_through_all_turns(spark):
    """Positions and times of a recording with more turns than one block of turns."""
    turns = [(1, n, "a", "bir ikki") for n in range(1500)] + [(2, 0, "b", ""), (3, 7, "c", "uch")]
    df = spark.createDataFrame(turns, "conv long, turn long, role string, text string")
    words = words_from_turns(df, "conv", "turn", "role", "text").drop("characters")
    rows = words.filter("transcript_id = '1'").orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(3000))
    clock = 0
    for r in rows:
        pos, turn = r.idx % 2, r.idx // 2
        pause = {0: 2000, 1: 1000, 2: 700, 3: 800}.get((7 + turn * 13 + pos * 29) % 17, 40)
        stretch = 0 if len(r.text) < 4 else {5: 760, 8: 1200}.get(r.idx % 11, 0)
        clock += pause
        assert r.start == clock / 1000.0
        clock += 60 + 35 * len(r.text) + stretch
        assert (r.end, r.n_words) == (clock / 1000.0, 3000)
    assert words.filter("transcript_id = '3'").count() == 1
    assert has_oversize(df, "conv", "text", Limits(recording_words=2999))
    assert not has_oversize(df, "conv", "text", Limits(recording_words=3000))


@pytest.mark.parametrize("name", ["cues_standard", "sentences_timing"])
def test_results_do_not_depend_on_partitioning(spark, name):
    folder, before = "/root/testdata/sf0.001", spark.conf.get("spark.sql.shuffle.partitions")
    many = sorted(entry.queries()[name](spark, folder).collect())
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = sorted(entry.queries()[name](spark, folder).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert many == one


def test_cue_plan_has_one_exchange_after_the_words(spark, tmp_path):
    words = entry._words(spark, "/root/testdata/sf0.001")
    words.write.parquet(f"{tmp_path}/words")
    stored = spark.read.parquet(f"{tmp_path}/words")
    for profile in entry.PROFILES.values():
        plan = entry.words_to_cues(stored, profile)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1
        assert "characters" not in plan and "Python" not in plan
