"""Jump consistent hashing against the published loop, row by row."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueweave.llm import sharding

DOCS = "doc_id bigint, text string, shard string, slot int, _row int"


def slow_shard(key, shards):
    here, there = -1, 0
    while there < shards:
        here = there
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        there = int((here + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return here


def slow_key(value):
    return int(hashlib.md5(("" if value is None else str(value)).encode()).hexdigest()[:16], 16)


def test_jumps_are_those_of_the_loop():
    keys = np.random.default_rng(1).integers(0, 1 << 64, 400, dtype=np.uint64)
    keys[:3] = 0, 1, (1 << 64) - 1
    for shards in (1, 2, 7, 24, 1_000):
        here, there = sharding.jumps(keys, shards)
        assert here.tolist() == [slow_shard(int(k), shards) for k in keys]
        assert (there >= shards).all()
    assert [a.tolist() for a in sharding.jumps(np.array([], dtype=np.uint64), 3)] == [[], []]
    with pytest.raises(ValueError):
        sharding.jumps(keys, 0)


def test_growth_moves_into_new_shards_only():
    keys = np.random.default_rng(2).integers(0, 1 << 64, 50_000, dtype=np.uint64)
    before, after = sharding.jumps(keys, 24)[0], sharding.jumps(keys, 30)[0]
    went = before != after
    assert (after[went] >= 24).all() and abs(went.mean() - 6 / 30) < 0.01
    assert np.bincount(before, minlength=24).min() > 0.9 * len(keys) / 24


def check_places(rows, found, shards):
    crc = lambda t: zlib.crc32((t or "").encode())
    want = [
        (d, len((t or "").encode()) + 8, crc(t), "key", slow_shard(slow_key(d), shards), slow_shard(slow_key(d), shards + 1))
        for d, t in rows
    ]
    order = lambda r: (r[4], r[0] is not None, r[0] or 0, r[1], r[2])
    slots, rest = {}, []
    for r in sorted(want, key=order):
        slots[r[4]] = slots.get(r[4], -1) + 1
        rest.append((*r[:5], slots[r[4]], r[5]))
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, rest))


def test_documents_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = sharding.place(docs)
    assert found.columns == sharding.PLACED
    check_places([(r.doc_id, r.text) for r in docs.collect()], found.collect(), 24)


@pytest.mark.parametrize("shards", [1, 5])
def test_odd_rows(spark, shards):
    texts = [None, "", " ", "É\U0001f600", "a\x00b", "long " * 50_000]
    rows = [(d, t) for d in (None, -3, 0, 7, 7, 1 << 40) for t in texts]
    rows += [(5, "copy")] * 300 + [(i, "copy") for i in range(100, 300)]  # a repeated row, a repeated text
    given = [(d, t, "taken", 1, 2) for d, t in rows]
    found = sharding.place(spark.createDataFrame(given, DOCS).repartition(5), shards).collect()
    check_places(rows, found, shards)
    assert sharding.place(spark.createDataFrame([], DOCS)).collect() == []


def test_taken_names_and_moved_rows(spark):
    given = spark.createDataFrame([(i, f"t{i}", "old", 9, i) for i in range(500)] + [(None, None, None, None, None)], DOCS)
    rows = sharding.assign(given, ["doc_id"], 6)
    assert {r.doc_id: r.shard for r in rows.collect()} == {d: slow_shard(slow_key(d), 6) for d in [*range(500), None]}
    went = sharding.moved(given, ["doc_id"], 6, 8).collect()
    assert went and all(r.shard >= 6 > r.from_shard for r in went)
    stay = {d for d in range(500) if slow_shard(slow_key(d), 6) == slow_shard(slow_key(d), 8)}
    assert {r.doc_id for r in went} | stay >= set(range(500)) and not {r.doc_id for r in went} & stay
    with pytest.raises(ValueError):
        sharding.moved(given, ["doc_id"], 6, 5)


def test_shards_are_files_in_order(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sharding.write_shards(sharding.assign(docs, ["doc_id"], 4), f"{tmp_path}/out", ["doc_id"])
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(back.select(*docs.columns).collect()) == sorted(docs.collect())
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {f"shard={i}" for i in range(4)}
    told = {(r.shard, r.slot): r.doc_id for r in back.collect()}
    for shard in range(4):
        ids = [told[shard, i] for i in range(sum(s == shard for s, _ in told))]
        assert ids == sorted(ids)


def test_only_keys_pass_through_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = docs.select(sharding.shard_of(sharding.key_of("doc_id"), 24).alias("shard"), F.octet_length("text").alias("n"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("ArrowEvalPython") >= 1 and "MapInArrow" not in text
