"""The pipeline, stage by stage, against brute force on a small table."""

import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cueweave.llm import jaccard, packing
from test_groups import least_reachable

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input of each stage and what it returned, written and read as the driver does."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = [(9_000, None, "en", "src1", 0), (9_001, "12 34 !!", "de", None, 8), (9_002, "", None, "src2", 0)]
    odd += [(9_003, docs.first().text, "fr", "src0", 1), (None, "the and of " * 30, "en", "src3", 330)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    docs.write.parquet(f"{folder}/given")
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        before = spark.read.parquet(f"{folder}/{'given' if not found else list(found)[-1]}")
        stage(spark, before, FOLDER).write.parquet(f"{folder}/{name}")
        found[name] = (before, spark.read.parquet(f"{folder}/{name}"))
    return found


def test_columns_stay(stages):
    for name, (before, after) in stages.items():
        assert name == "sequences" or after.dtypes == before.dtypes


def test_language_rejects_only_what_is_no_language(stages):
    before, after = stages["language"]
    assert {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()} == {9_000, 9_001, 9_002}
    assert after.count() == before.count() - 3


def shingle_sets(rows):
    sets = []
    for text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    return sets


def test_one_of_each_group_stays(stages):
    """Groups are linked at 0.8 of the five-word shingles of two texts in common."""
    before, after = stages["near_duplicates"]
    rows = sorted(before.collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    sets = shingle_sets([r.text for r in rows])
    near = np.array([[5 * len(a & b) >= 4 * len(a | b) for b in sets] for a in sets])
    ids = list(range(len(rows)))  # rows are in order of id
    want = [rows[i] for i in sorted(set(least_reachable(near, ids)))]
    assert sorted(map(str, after.collect())) == sorted(map(str, want))


def test_groups_are_those_of_exact_similarity(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(5, " ".join(words)), (9, " ".join(words).upper()), (None, " ".join(words) + " end")]
    for i, n in enumerate((1, 5, 6, 7, 12)):  # n changed words of 300: 296 - 5 n shingles of 296 + 5 n in common
        rows.append((20 + i, " ".join(f"x{i}" if k % 20 == 10 and k < 20 * n else w for k, w in enumerate(words))))
    rng = np.random.default_rng(4)
    for i in range(120):  # a crowd of near copies, a line that many share, short texts
        part = [f"c{k}" for k in range(80)]
        part[int(rng.integers(0, 80))] = f"z{i}"
        rows.append((1_000 + i, " ".join(part)))
        rows.append((2_000 + i, " ".join([f"u{i}x{k}" for k in range(int(rng.integers(0, 12)))] + [f"line{k}" for k in range(9)])))
        rows.append((3_000 + i, " ".join(rng.choice(["a", "b"], 7))))
    rows += [(4_000, None), (4_001, " \t"), (4_002, "one two"), (4_003, "one TWO")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    rows.sort(key=lambda r: (r[0] is None, r[0]))
    sets = shingle_sets([text for _, text in rows])
    near = np.array([[5 * len(a & b) >= 4 * len(a | b) for b in sets] for a in sets])
    want = [rows[i] for i in sorted(set(least_reachable(near, list(range(len(rows))))))]
    found = corpus_pipeline.near_duplicates(spark, df, FOLDER).collect()
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, want))


def test_values_are_hidden(stages):
    before, after = stages["personal_data"]
    texts = {r.doc_id: r.text for r in before.collect()}
    found = {r.doc_id: r for r in after.collect()}
    assert set(texts) == set(found) and all(len(r.text) == r.n_chars for r in found.values())
    assert any(r.text != texts[d] for d, r in found.items())


def test_the_mix_repeats_and_drops(stages):
    before, after = stages["mixture"]
    texts = {r.doc_id: r.text for r in before.collect()}
    sizes = sum(len(t.split()) for t in texts.values())
    words = sum(len(r.text.split()) for r in after.collect())
    assert abs(words - 1.5 * sizes) <= 20
    assert {r.doc_id for r in after.collect()} <= set(texts)


def test_pieces_hold_every_id_once(stages):
    before, after = stages["sequences"]
    encoder = packing.Encoder(packing.vocabulary_path())
    want = defaultdict(int)
    for r in before.collect():
        want[r.doc_id] += len(encoder.ids(r.text))
    got, sequences = defaultdict(int), defaultdict(list)
    for r in after.collect():
        got[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_run_gives_the_same_again(spark):
    names = ["doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"]
    first, again = (
        corpus_pipeline.run(spark, FOLDER).agg(F.count("*"), F.sum(F.xxhash64(*names).cast("decimal(38,0)"))).first()
        for _ in range(2)
    )
    assert first == again and first[0] > 0


def test_fingerprints_come_first_and_texts_move_only_for_likely_pairs(spark, monkeypatch):
    """Close fingerprints propose pairs; of texts of 12,000 words that share 0.68, no text is read again."""
    proposed, compared = [], []
    close, still = jaccard.simhash.close_links, jaccard._still_possible

    def seen(nodes, *args):
        proposed.append(nodes.count())
        return close(nodes, *args)

    def left(pairs, nodes):
        compared.append((pairs.count(), still(pairs, nodes).count()))
        return still(pairs, nodes)

    monkeypatch.setattr(jaccard.simhash, "close_links", seen)
    monkeypatch.setattr(jaccard, "_still_possible", left)
    shared = [f"s{k}" for k in range(9_720)]
    rows = [(i, " ".join(shared + [f"t{i}x{k}" for k in range(2_280)])) for i in range(6)]
    rows.append((9, rows[0][1] + " end"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = corpus_pipeline.near_duplicates(spark, df, FOLDER).collect()
    assert sorted(r.doc_id for r in found) == list(range(6))
    assert len(proposed) == 1 and 6 <= proposed[0] <= 7
    assert sum(n for n, _ in compared) > 5 and sum(n for _, n in compared) == 1


def test_long_bitmaps_never_rule_out_what_is_alike():
    rng = np.random.default_rng(8)
    for size in (1, 3, 40, 900, 5_000):
        a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        for changed in (0, 1, size // 10, size // 5, size):
            b = np.unique(np.concatenate([a[changed:], rng.integers(0, 2**64, changed // 2, dtype=np.uint64)]))
            apart = len(np.setxor1d(a, b))
            assert jaccard.bits_apart(jaccard.long_bitmap(a), jaccard.long_bitmap(b)) <= apart


def test_slow_texts_are_those_of_long_stretches():
    texts = ["", " ", "a b", "a" * 499, "a" * 500, " " * 499, " " * 500, "a" + " \n" * 250 + "b", "a" + " " * 499 + "b"]
    texts += ["a  b " * 400, " " * 250 + "a" + " " * 250, "x " * 600, "x " * 5 + "y" * 500, "a" * 499 + " " + "b" * 499]
    for text in texts:
        assert packing.slow(text) == bool(re.search(r"\S{500}|\s{500}", text))
        assert packing.encoder(packing.vocabulary_path()).ids(text)[-1] == packing.END


def test_places_never_rule_out_the_first_hash_that_alike_sets_share(spark):
    """Pairs meet at the first hash they share at the latest; ends of prefixes bring no others together."""
    rng, none = np.random.default_rng(5), np.zeros(0, dtype=np.uint64)
    rows, pairs = [], 0
    for size in (1, 4, 5, 9, 10, 45, 200):
        a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        for gone, new in ((0, 0), (size // 10, size // 10), (size // 5, 0), (0, size // 4), (size // 9, size // 9)):
            b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 2**64, new, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 5 * both >= 4 * (len(a) + len(b) - both):
                x, y = ({int(h): i for i, h in enumerate(jaccard.prefix(s, none, none))} for s in (a, b))
                rows += [(pairs, len(a), x[h], len(b), y[h]) for h in x.keys() & y.keys()]
                pairs += 1
    rows.append((-1, 100, 15, 100, 15))
    given = spark.createDataFrame(rows, "pair int, a_size int, a_place int, b_size int, b_place int")
    kept = {r.pair for r in given.filter(jaccard._may_be_first("a_", "b_")).collect()}
    assert pairs > 20 and kept == set(range(pairs))


def test_a_short_bitmap_is_one_column(spark):
    rows = spark.createDataFrame([(0, 1, "a b c"), (1, 2, None)], "_row bigint, doc_id bigint, text string")
    found = jaccard._sets(rows, 5).collect()
    assert sorted(len(r["bitmap"]) for r in found) == [jaccard.WORDS] * 2
