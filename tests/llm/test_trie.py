"""The prefix trie against a dictionary of all prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cueweave.llm import trie

TURNS = "conv_id bigint, turn bigint, role string, text string, key string, d int"
FIELDS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def slow_nodes(seqs):
    """seqs: {conv_id: [(role, text), ...]}"""
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(seqs):
        path = tuple(seqs[c])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = []
    for p, cs in members.items():
        stack, leaves, saved = [p], 0, 0
        while stack:
            q = stack.pop()
            leaves += not kids[q]
            saved += (len(members[q]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) if q else 0)
            stack += kids[q]
        digest = hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
        out.append((cs[0], len(p), members[p[:-1]][0] if p else None, len(cs), len(kids[p]), leaves, saved, digest))
    return sorted(out, key=str)


def slow_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    return out


def found(df):
    assert df.columns == FIELDS
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_the_given_conversations(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert found(trie.prefix_trie(table)) == slow_nodes(slow_rebuilt(rows))


@pytest.mark.parametrize(("block", "part", "batches"), [(1 << 16, 1 << 12, 2), (3, 2, 3), (4, 3, 1)])
def test_odd_conversations(spark, monkeypatch, block, part, batches):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "PART", part)
    monkeypatch.setattr(trie, "BATCHES", batches)
    rng = random.Random(batches)
    rows = []
    for c in range(120):
        if c % 20 == 0 and c % 40:
            continue  # bases that are absent
        for turn in range(rng.choice([1, 1, 2, 3, 9, 14])):
            rows.append((c, turn * 2 - 3, rng.choice(["user", "system"]), rng.choice(["hi there", "a b c", "é"])))
    rows += [(7, None, None, None), (7, None, "user", ""), (7, 0, "user", "tie"), (7, 0, "user", "tie"), (7, 0, "a", "tie")]
    rows += [(None, 1, "user", "nobody"), (1 << 40, 5, "user", " \t"), (41, None, "", "x " * 9_000)]
    rows += [(300 + 20 * i, t, "user", f"same {t}") for i in range(30) for t in range(6)]  # a group of copies
    for i in range(12):  # each goes on where the one before ends
        rows += [(2_000 + 20 * i, t, "user", f"step {t}") for t in range(i + 1)]
    df = spark.createDataFrame([(*r, "taken", 1) for r in rows], TURNS).repartition(3)
    sequences, convs = trie.rebuilt(df)
    assert found(trie.nodes(sequences, convs, batches)) == slow_nodes(slow_rebuilt(rows))


def test_no_turns(spark):
    assert trie.prefix_trie(spark.createDataFrame([], TURNS)).collect() == []
    only = spark.createDataFrame([(None, 1, "user", "x", "", 1)], TURNS)
    assert trie.prefix_trie(only).collect() == []
    turnless = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)  # its base is absent
    one = spark.createDataFrame([(turnless, 1, "user", "x", "", 1)], TURNS)
    assert found(trie.prefix_trie(one)) == slow_nodes({turnless: []})


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 41)] + [(0, 1 << 40), ((1 << 40) - 1, (1 << 40) + 5)]
    df = spark.createDataFrame(pairs, "low bigint, high bigint")
    for r in df.select("low", "high", trie.two_fattest(F.col("low"), F.col("high")).alias("f")).collect():
        assert r.low < r.f <= r.high
        if r.high <= 40:
            assert r.f & -r.f == max(x & -x for x in range(r.low + 1, r.high + 1))


def test_location_asks_few_handles(spark):
    """Exit nodes of long sequences are found in as many rounds as the length has digits."""
    rng = random.Random(3)
    words = lambda n, k: [(f"{k}-{i}", 0) for i in range(n)]
    seqs = {c: words(rng.randrange(1, 90), "p") + words(rng.randrange(0, 70), c) for c in range(60)}
    rows = [(c, d, hash(t) & 0xFFFF, hash(t) >> 20 & 0xFFFF, 1) for c, s in seqs.items() for d, (t, _) in enumerate(s, 1)]
    turns = spark.createDataFrame(rows, "conv_id bigint, d bigint, t1 bigint, t2 bigint, w bigint")
    paths = trie.prefixes(turns).cache()
    lengths = spark.createDataFrame([(c, len(s)) for c, s in seqs.items()], "owner bigint, len bigint")
    old = lengths.filter("owner < 40")
    built = trie.build(old, paths)
    explicit = set()
    olds = [seqs[c] for c in range(40)]
    for s in olds:
        for d in range(1, len(s) + 1):
            after = {tuple(o[d]) if len(o) > d else None for o in olds if o[:d] == s[:d]}
            if len(after) > 1 or None in after:
                explicit.add(tuple(s[:d]))
    assert built.count() == len(explicit)
    for r in trie.locate(lengths.filter("owner >= 40"), built, paths).collect():
        s = seqs[r.owner]
        assert r.p == max([d for d in range(1, len(s) + 1) if tuple(s[:d]) in explicit], default=0)


def test_edges_cut_far_apart(spark):
    """A batch parts from two edges of one conversation, and leaves the one between them whole."""
    ids = [r.id for r in spark.range(400).filter(F.pmod(F.xxhash64("id"), F.lit(trie.GROWTH)) == 0).collect()]
    later = [r.id for r in spark.range(400, 500).filter(F.pmod(F.xxhash64("id"), F.lit(trie.GROWTH)) != 0).collect()]
    turn = [("user", f"t{d}") for d in range(12)]
    seqs = {ids[0]: turn}
    for c, at in zip(ids[1:3], (4, 8), strict=True):  # parts the first conversation into three edges
        seqs[c] = turn[:at] + [("user", f"first {c}")]
    for c, at in zip(later[:3], (2, 10, 10), strict=True):
        seqs[c] = turn[:at] + [("user", f"second {c}")]
    rng = random.Random(5)
    for at, c in enumerate(ids[3:] + later[3:]):  # random trees over few turns
        tree = at % 8
        seqs[c] = [("user", f"tree {tree}")] + [("user", "x " * rng.choice([1, 1, 1, 1, 2])) for _ in range(rng.randrange(14))]
    rows = [(c, d, *t) for c, s in seqs.items() for d, t in enumerate(s, 1)]
    texts = spark.createDataFrame(rows, "conv_id bigint, d bigint, role string, text string")
    hashed = [F.xxhash64("role", "text").alias("t1"), F.xxhash64("text", F.lit(1), "role").alias("t2")]
    turns = texts.select("conv_id", "d", *hashed, trie.word_count(F.col("text")).alias("w"))
    convs = spark.createDataFrame([(c,) for c in seqs], "conv_id bigint")
    assert found(trie.nodes(turns, convs, 2)) == slow_nodes(seqs)
