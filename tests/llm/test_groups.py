"""SimHash, embeddings and suffixes against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from cueweave.llm import common, egojoin, simhash, suffix


def least_reachable(near, ids):
    label = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in np.flatnonzero(near[i]):
                low = min(label[i], label[j], key=lambda x: ids[x])
                if ids[label[i]] != ids[low]:
                    label[i], changed = low, True
    return [ids[x] for x in label]


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)]
    edges += [(500, 500 + i) for i in range(50)] + [(7, 7), (None, 3), (3, None)]
    found = dict(common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    nodes = sorted({x for e in edges if None not in e and e[0] != e[1] for x in e})
    near = np.zeros((len(nodes), len(nodes)), bool)
    for a, b in edges:
        if a is not None and b is not None and a != b:
            i, j = nodes.index(a), nodes.index(b)
            near[i, j] = near[j, i] = True
    assert [found[n] for n in nodes] == least_reachable(near, nodes)


def slow_fingerprint(text, shingle=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    stretches = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    votes = [xxhash.xxh64_intdigest(s, 42) for s in stretches]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in votes) > len(votes))


def test_fingerprints_of_odd_texts(monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 7)
    for text in (None, "", " \x0b\x1c ", "a", "A b C　d", "É é x", "a b c d", "a b c d e " * 9, "\x85 \x1f y"):
        assert simhash.fingerprint(text) == slow_fingerprint(text), text


@pytest.mark.parametrize("block", [2_048, 40])
def test_close_links_keep_every_component(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(1)
    prints = set()
    for _ in range(60):
        center = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 3, 120 if len(prints) < 500 else 4])):
            x = center
            for bit in rng.sample(range(64), rng.randrange(0, 6)):
                x ^= 1 << bit
            prints.add(x)
    prints = sorted(prints)
    values = np.array(prints, dtype=np.uint64)
    signed = values.view(np.int64).tolist()
    nodes = spark.createDataFrame([(i, p) for i, p in enumerate(signed)], "node bigint, fingerprint bigint")
    for bits, segments in ((4, 6), (6, 8)):
        found = dict(common.components(simhash.close_links(nodes, bits, segments)).collect())
        near = np.bitwise_count(values[:, None] ^ values[None, :]) <= bits
        assert [found.get(i, i) for i in range(len(prints))] == least_reachable(near, list(range(len(prints))))


def test_near_duplicates_of_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(9, base), (4, base + " end"), (7, base.upper()), (3, None), (2, ""), (None, " "), (5, "lonely"), (5, "lonely"), (None, "nobody has this")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, fingerprints int")
    found = simhash.near_duplicates(df).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert {c for _, c in by[9]} == {c for _, c in by[7]} == {c for _, c in by[4]} == {4}
    assert by[3] == by[2] == {("0" * 16, 2)} and ("0" * 16, 2) in by[None]
    assert {c for _, c in by[5]} == {5} and None in {c for _, c in by[None]}
    kept = simhash.first_of_groups(df, bits=4, shingle=5)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 2), (False, 4), (False, 5), (True, None)]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = sorted(docs.collect())
    values = np.array([slow_fingerprint(r.text) for r in rows], dtype=np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    want = least_reachable(near, [r.doc_id for r in rows])
    found = sorted(simhash.near_duplicates(docs).collect())
    assert [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in found] == [
        (r.doc_id, int(v), c) for r, v, c in zip(rows, values, want, strict=True)
    ]


# -- embeddings ---------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int, note string"


def slow_links(rows, threshold=0.98):
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.asarray(v, dtype=np.float32).astype(float)
        return v / np.linalg.norm(v)

    units = [unit(v) if label is not None else None for _, v, label, _ in rows]
    near = np.zeros((len(rows), len(rows)), bool)
    for i in range(len(rows)):
        for j in range(len(rows)):
            a, b = units[i], units[j]
            if i != j and a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b):
                near[i, j] = a @ b >= threshold
    return near


@pytest.mark.parametrize("block", [1_024, 16])
def test_links_of_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(egojoin, "BLOCK", block)
    monkeypatch.setattr(egojoin, "SUB", 8)
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(25):
        center, label = rng.normal(size=12), int(rng.integers(0, 3))
        for _ in range(int(rng.integers(1, 9))):
            v = center + rng.normal(size=12) * rng.choice([0.0, 0.02, 0.06])
            rows.append((len(rows), [float(x) for x in v], label, "x"))
    n = len(rows)
    rows += [(n + i, [1.0, 2.0, float(i)], 1, None) for i in range(3)]
    rows += [(n + 3, None, 1, None), (n + 4, [], 1, None), (n + 5, [0.0] * 12, 1, None)]
    rows += [(n + 6, [float("nan")] * 12, 1, None), (n + 7, [float("inf")] * 12, 1, None), (n + 8, rows[0][1], None, None)]
    rows += [(n + 9, [None] * 12, 1, None), (n + 10, [1e-30] * 12, 0, None), (n + 11, [1e30] * 12, 0, None)]
    near = slow_links(rows)
    want = least_reachable(near, [r[0] for r in rows])
    found = sorted(egojoin.linked(spark.createDataFrame(rows, VECTORS)).collect())
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in found] == [
        (r[0], int(near[i].sum()), want[i], want[i] == r[0]) for i, r in enumerate(rows)
    ]


def test_copies_count_as_links(spark):
    rows = [(i, [1.0, 2.0], 1, "") for i in range(5)] + [(None, [1.0, 2.0], 1, ""), (8, [1.0, 2.01], 1, "")]
    found = {r.vec_id: r for r in egojoin.linked(spark.createDataFrame(rows, VECTORS)).collect()}
    assert {r.n_links for r in found.values()} == {6} and {r.component_id for r in found.values()} == {0}
    assert found[0].kept and not found[None].kept and not found[8].kept
    assert egojoin.linked(spark.createDataFrame([], VECTORS)).count() == 0


# -- suffixes -------------------------------------------------------------------------


def slow_removal(rows, length=50):
    seen: dict[bytes, int] = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            if doc is not None:
                key = data[i : i + length]
                seen[key] = min(seen.get(key, doc), doc)
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if doc is not None and seen[data[i : i + length]] < doc:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def odd_documents():
    rng = random.Random(11)
    passage = "".join(rng.choice("abcdé ") for _ in range(90))
    rows = [(i, "".join(rng.choice("ab ") for _ in range(rng.randrange(0, 140)))) for i in range(30)]
    for i in range(30, 60):
        a = rng.randrange(0, 30)
        rows.append((i, f"{rng.random()}{passage[a : a + rng.randrange(45, 60)]}{rng.random()}"))
    rows += [(60, "z" * 300), (61, "z" * 90 + "y" + "z" * 49), (62, "zy" * 100), (63, "zy" * 60), (64, passage * 3)]
    rows += [(65, None), (66, ""), (None, passage), (None, "q"), (64, passage * 3), (64, passage + "!"), (1, passage)]
    rows += [(70, "\x00" * 120), (71, "\x00" * 60 + "x")]
    return rows


@pytest.mark.parametrize("many", [20_000, 5])
def test_repeated_stretches(spark, monkeypatch, many):
    monkeypatch.setattr(suffix, "ANCHOR_ROWS", many)
    monkeypatch.setattr(suffix, "PIECE", 256)
    rows = odd_documents()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, start int").repartition(3)
    found = suffix.remove_repeats(df).drop("kept").collect()
    assert sorted((tuple(r) for r in found), key=str) == slow_removal(rows)
    assert suffix.remove_repeats(df.limit(0)).count() == 0


def test_stretches_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    found = suffix.remove_repeats(docs).drop("kept").collect()
    assert sorted((tuple(r) for r in found), key=str) == slow_removal([tuple(r) for r in docs.collect()])


def test_partner_that_holds_the_gram_twice(spark):
    rng = random.Random(21)
    rows = []
    for i in range(0, 400, 2):  # passages ending in a phrase; the later document repeats the phrase
        word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
        phrase = word(rng.randrange(17, 30))
        passage = word(rng.choice([51, 65]) - len(phrase)) + phrase
        rows += [(i, word(60) + passage + word(60)), (i + 1, word(60) + passage + phrase + word(60))]
    found = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).drop("kept").collect()
    assert sorted((tuple(r) for r in found), key=str) == slow_removal(rows)


def test_groups_by_interval_expansion():
    rng = np.random.default_rng(2)
    text = rng.integers(97, 99, 400).astype(np.uint8)
    for length in (1, 3, 8, 20):
        order, group = suffix.shared_groups(text, length)
        heads = [text[i : i + length].tobytes() for i in order]
        assert heads == sorted(heads)
        same = [a == b for a, b in zip(heads, heads[1:], strict=False)]
        assert (np.diff(group) == 0).tolist() == same


def test_neighbouring_stretches_are_one_range():
    """Forty removed stretches of a run cost one range, not forty; and so do a run's that goes whole."""
    start, n = np.array([5, 100, 300]), np.array([40, 40, 7])
    mask = np.array([2.0**40 - 1, 2.0**3 + 2.0**4 + 2.0**39, np.nan])
    found = [r for ranges in suffix._ranges(start, n, mask, 50) for r in zip(*(x.tolist() for x in ranges), strict=True)]
    assert sorted(found) == [(0, 5, 94), (1, 103, 154), (1, 139, 189), (2, 300, 356)]


def test_ends_of_texts_are_told_apart():
    """Zero bytes at the end of a text are bytes, and not its end."""
    text = np.frombuffer(b"ab\x00\x00ab\x00\x00ab\x00", dtype=np.uint8)
    for length in (2, 3, 8, 50):
        order, group = suffix.shared_groups(text, length)
        heads = [text[i : i + length].tobytes() for i in order]
        assert heads == sorted(heads)
        same = [a == b for a, b in zip(heads, heads[1:], strict=False)]
        assert (np.diff(group) == 0).tolist() == same
