"""Mixing, packing, language ID, pseudonyms, tool calls: exact properties and odd rows."""

import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from cueweave.llm import langid, mixing, packing, pii, toolcalls

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int"


def documents(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        source = rng.choice(["a", "a", "a", "a", "b", "c", "é", None])
        text = " ".join("w" * rng.randrange(1, 9) for _ in range(rng.choice([0, 1, 5, 40, 300])))
        rows.append((i, text, "en", source, len(text), 1))
    rows += [(None, "no id here", None, "b", None, 1), (5, rows[5][1], "en", rows[5][3], 3, 1), (407, None, "x", "c", 0, 1)]
    rows += [(400, "only words of z " * 4_000, None, "z", 0, 1), (401, " \n ", None, "empty", 0, 1)]
    return spark.createDataFrame(rows, DOCS), rows


# -- mixing ---------------------------------------------------------------------------


def test_targets():
    sizes = [("b", 100), (None, 400), ("a", 10), ("c", 0), ("d", 1000)]
    plan = mixing.allocate(sizes, (5.0, 2.0, 1.0), 1.5, 2.0)
    assert [s for s, *_ in plan] == ["a", "b", "c", "d", None]
    assert abs(sum(t for *_, t in plan) - 1.5 * 1510) < 1e-6
    assert all(t <= 2 * n + 1e-9 for _, n, t in plan)
    by = {s: t for s, _, t in plan}
    assert by["a"] == 20 and by["b"] == 200 and by["c"] == 0
    assert by["d"] / by[None] == pytest.approx(5 / 2) or by[None] == 800
    assert mixing.allocate([], (1.0,), 1.5, 2.0) == []


def test_permutation_and_tree():
    for n in (1, 2, 3, 17, 1000):
        assert sorted(mixing.permute(np.arange(n), n, 3).tolist()) == list(range(n))
    root = {"level": 0, "index": 0, "quota": [70, 5, 0, 1], "start": [0, 0, 0, 0]}
    found = list(mixing.leaves(root, 4, 1))
    assert len(found) == 16 and np.array([f["quota"] for f in found]).sum(axis=0).tolist() == root["quota"]
    assert max(sum(f["quota"]) for f in found) - min(sum(f["quota"]) for f in found) <= 1
    seen = [f["start"][0] for f in found if f["quota"][0]]
    assert seen == sorted(seen)


def test_taken_words(spark):
    df, rows = documents(spark)
    found = mixing.taken(df, block_words=64).collect()
    assert len(found) == len(rows)
    sizes, targets, taken = Counter(), {}, Counter()
    source = {r[0]: r[3] for r in rows}
    for r in found:
        assert 0 <= r.taken <= 2 * r.size
        s = source[r.doc_id]
        sizes[s] += r.size
        taken[s] += r.taken
        targets[s] = (r.target, r.source_size)
    want = mixing.allocate(list(sizes.items()), mixing.WEIGHTS, 1.5, 2.0)
    for s, n, t in want:
        assert targets[s] == (pytest.approx(t), n) and abs(taken[s] - t) <= 1
    again = mixing.taken(df.repartition(7), block_words=64).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert mixing.taken(df.limit(0)).count() == 0


def test_mixed_rows(spark):
    df, rows = documents(spark)
    plan = Counter()
    for r in mixing.taken(df, block_words=64).collect():
        plan[r.doc_id] += r.taken
    out = mixing.mixed(df, block_words=64)
    assert out.columns == df.columns
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
        assert r.text in {x[1] for x in rows if x[0] == r.doc_id} or r.n_chars == len(r.text)
    assert +words == +plan


# -- packing ----------------------------------------------------------------------------


def check_packing(found, texts, window):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(packing.vocabulary_path())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for doc, parts in pieces.items():
        ids = np.array([*exact.encode(texts[doc] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for p in sorted(parts, key=lambda r: r.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= window and at & (at - 1) == 0  # full, or a power of two
    assert sum(sum(p.length for p in s) < window for s in sequences.values()) <= window.bit_length()


ODD = ["", None, "a", "<|endoftext|> in text", "é𝒳 " * 50, "x" * 3_000, " " * 2_000, "\n\n\t\r\x00", "don't we'll 12345", "word " * 5_000]


@pytest.mark.parametrize("window,grid", [(2048, 8), (64, 4)])
def test_pieces(spark, window, grid):
    rng = random.Random(8)
    texts = {i: " ".join(rng.choice(["the", "of", "Ünder", "x1"]) for _ in range(rng.randrange(0, 3 * window // 4))) for i in range(250)}
    texts |= {1000 + i: t for i, t in enumerate(ODD)}
    df = spark.createDataFrame([(d, t, 1) for d, t in texts.items()], "doc_id bigint, text string, length int")
    check_packing(packing.pack(df, window, grid).collect(), texts, window)


def test_repeated_rows_and_none(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id bigint, text string")
    found = packing.pack(df).collect()
    assert sum(r.length for r in found) == sum({r.doc_id: r.doc_tokens * (2 if r.doc_id else 1) for r in found}.values())
    assert packing.pack(df.limit(0)).count() == 0


def test_least_squares():
    patterns = packing.combinations(16)
    assert (patterns.sum(axis=1) == 16).all() and len(set(map(tuple, patterns.tolist()))) == len(patterns)
    rng = np.random.default_rng(0)
    for _ in range(5):
        goal = rng.integers(0, 60, 16).astype(float)
        goal[0] = 0
        use = packing.nonnegative_least_squares(patterns, goal)
        table = np.zeros((16, len(patterns)))
        for row in patterns.T:
            np.add.at(table, (row, np.arange(len(patterns))), 1.0)
        table[0] = 0
        slope = table.T @ (goal - table @ use)
        assert (use >= 0).all() and (slope < 1e-4).all() and np.abs(slope[use > 1e-9]).max() < 1e-4  # optimal
        kinds, counts = packing.plan(goal.astype(int))
        spent = np.zeros(16)
        for row, n in zip(kinds, counts, strict=True):
            np.add.at(spent, row, n)
        assert (spent[1:] <= goal[1:]).all()


# -- language -----------------------------------------------------------------------------


def test_probabilities_add_up():
    texts = pd.DataFrame({"lang": ["aa"] * 6 + ["bb"] * 6, "text": ["abcab cabca", "bca bca"] * 3 + ["xyzzy xyx", "zyx z"] * 3})
    model = langid.build(texts)
    alphabet = sorted({c for t in texts["text"] for c in t})
    for context in ("abc", "bca", "xyz", "qqq", "ca "):
        grams = [langid.code_points(context + c) for c in alphabet]
        p = np.array([model.probabilities(g, np.array([3]), langid.ORDER)[0] for g in grams]).sum(axis=0)
        # The model also keeps room for one unseen character.
        room = model.probabilities(langid.code_points(context + "☃"), np.array([3]), langid.ORDER)[0]
        own = [len({c for t in texts["text"][texts["lang"] == g] for c in t}) for g in model.languages]
        assert len(own) == 2 and ((p + room) == pytest.approx(1.0, abs=0.02))


def test_scores_do_not_depend_on_batches(monkeypatch):
    texts = pd.DataFrame({"lang": ["aa", "bb"] * 5, "text": ["the cat sat " * 9, "über die tür " * 9] * 5})
    model = langid.build(texts)
    given = ["the tür", "", "x", "ab", "the cat sat on die tür " * 20]
    whole = langid.Scorer(model).entropies(given)
    for bits in (4, 20):
        monkeypatch.setattr(langid, "CACHE_BITS", bits)
        alone = np.vstack([langid.Scorer(model).entropies([t]) for t in given])
        assert np.allclose(whole, alone)
    points = langid.code_points(given[4])
    slow = -np.log2(model.probabilities(points, np.arange(len(points)), langid.ORDER)).mean(axis=0)
    assert np.allclose(whole[4], slow, atol=1e-4)


def test_held_out_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    odd = [(9_001, "de", None), (9_002, "de", "12 34 !!"), (9_003, None, "und der die das"), (None, "fr", "le la les"), (9_004, "en", "")]
    found = langid.predict(docs.union(spark.createDataFrame(odd, docs.schema))).collect()
    held = [r for r in found if r.doc_id in lang and r.held_out]
    assert {r.held_out for r in found if r.doc_id in lang and zlib.crc32(str(r.doc_id).encode()) % 5 == 0} == {True}
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97
    by = {r.doc_id: r for r in found}
    assert {by[i].lang_pred for i in (9_001, 9_002, 9_004)} == {"und"} and by[9_001].score == 0.0
    assert by[9_003].lang_pred in set(lang.values()) and by[None].held_out
    assert all(0 <= r.score <= 1 for r in found) and len(found) == len(lang) + len(odd)
    none = spark.createDataFrame([(1, None, "text")], docs.schema)
    assert [r.lang_pred for r in langid.predict(none).collect()] == ["und"]
    assert langid.predict(docs.limit(0)).count() == 0


# -- pseudonyms ------------------------------------------------------------------------------

VALUES = [
    ("card", "4929 3483-85146306"), ("card", "4845168114407329"), ("iban", "DE89 3704 0044 0532 0130 00"),
    ("date", "31.12.1999"), ("date", "2024-02-29"), ("date", "01/02/2003"), ("ip", "10.0.0.255"),
    ("phone", "+1 (017) 555-7713"), ("email", "Ana.b-7@x9.example.com"), ("secret", "AB12" * 10), ("secret", "0f" * 20),
]


@pytest.mark.parametrize("kind,value", VALUES)
def test_values_keep_their_form(kind, value):
    names = pii.Pseudonyms(b"k" * 32)
    text, kinds = pii.pseudonymise(f"see {value}, or {value}.", names)
    first, second = re.fullmatch(r"see (.*), or (.*)\.", text).groups()
    assert kinds == [kind, kind] and first == second != value
    shape = lambda v: re.sub("[a-f]" if kind == "secret" else "[^\\W\\d_]", "0" if kind == "secret" else "a", re.sub(r"\d", "0", v.lower()))
    if kind != "ip":
        assert shape(first) == shape(value)
    assert pii.PATTERN.fullmatch(first).lastgroup == kind
    assert names.replace(kind, first, undo=True) == value
    assert pii.Pseudonyms(b"other" * 5).replace(kind, value) != first


@pytest.mark.parametrize("value", ["4929 3483 8514 6307", "31.02.1999", "999.1.2.3", "DE88 3704 0044 0532 0130 00", "12:30", "v1.2.3", "CC BY-NC 4.0", "1234567"])
def test_invalid_values_stay(value):
    text = f"x {value} y"
    assert pii.pseudonymise(text, pii.Pseudonyms(b"k" * 32)) == (text, [])


CARD, IBAN = "4845168114407329", "BE68539007547034"


@pytest.mark.parametrize(
    "text,values",
    [
        (f"{CARD} 123", {"card": CARD}),
        (f"{CARD} 12/26", {"card": CARD}),
        (f"no 7 {CARD}", {"card": CARD}),
        (f"{CARD} 555-123-4567", {"card": CARD, "phone": "555-123-4567"}),
        ("1 2 3 4 4845 1681 1440 7329 end", {"card": "4845 1681 1440 7329"}),
        (f"{IBAN} EUR", {"iban": IBAN}),
        ("BE68 5390 0754 7034 IBAN", {"iban": "BE68 5390 0754 7034"}),
        (f"AB12 CDEF {IBAN} NOW", {"iban": IBAN}),
        ("2020-01-01 12344", {"date": "2020-01-01"}),
        (f"+1 {CARD}", {"card": CARD}),
        ("api_key = 'a8Xq-77tTz01'", {"secret": "a8Xq-77tTz01"}),
        ("password: " + "0f" * 20, {"secret": "0f" * 20}),
    ],
)
def test_values_beside_other_words(text, values):
    names = pii.Pseudonyms(b"k" * 32)
    want = text
    for kind, value in values.items():
        want = want.replace(value, names.replace(kind, value))
        assert names.replace(kind, names.replace(kind, value), undo=True) == value
    assert pii.pseudonymise(f"x {text}, y", names) == (f"x {want}, y", list(values))
    assert pii.pseudonymise(text, names)[0] == want


def test_permutations_are_bijections():
    names = pii.Pseudonyms(b"k" * 32)
    for n in (1, 2, 10, 97, 1000):
        found = [names.number(i, n, "t") for i in range(n)]
        assert sorted(found) == list(range(n)) and [names.number(x, n, "t", undo=True) for x in found] == list(range(n))


def test_hidden_documents(spark):
    rows = [(1, "a@b.example.com and 4845168114407329", 7), (1, None, 7), (None, "", 7), (2, "nothing here " * 1_000, 7), (3, "4845168114407329", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_card int")
    found = pii.hide(df).collect()
    assert len(found) == len(rows) and {r.n_values for r in found} == {0, 1, 2}
    by = {(r.doc_id, r.n_values): r.text for r in found}
    assert by[(1, 2)].endswith(by[(3, 1)]) and by[(1, 0)] is None and by[(2, 0)] == rows[3][1]
    assert pii.hide(df.limit(0)).count() == 0


# -- tool calls ---------------------------------------------------------------------------------

CALLS = "conv_id bigint, turn bigint, pos int, call_id string, name string, arguments string, level int"
RESULTS = "conv_id bigint, turn bigint, call_id string, content string"


def slow_links(calls, results, tools):
    out, owners = [], {}
    for i, c in sorted(enumerate(calls), key=lambda x: (x[1][1] is not None, x[1][1] or 0, x[1][2] is not None, x[1][2] or 0, x[0])):
        if c[0] is not None and c[3] is not None:
            owners.setdefault((c[0], c[3]), i)
    checked = [toolcalls.check(c[4], c[5], tools) for c in calls]
    sound = {k: checked[i][1] for k, i in owners.items() if checked[i][2] is None}
    level: dict = {}
    for _ in range(len(sound) + 1):
        for k, refs in sound.items():
            if all((k[0], r) in level for r in refs):
                level[k] = 1 + max((level[(k[0], r)] for r in refs), default=-1)
    answers = defaultdict(list)
    for conv, turn, call_id, content in results:
        if conv is not None and call_id is not None and (conv, call_id) in owners:
            answers[(conv, call_id)].append((turn, content))
        else:
            out.append((conv, turn, None, call_id, None, None, "orphan_result", None, content))
    for i, (conv, turn, pos, call_id, name, *_) in enumerate(calls):
        key, (plain, _, problem) = (conv, call_id), checked[i]
        owner = owners.get(key) == i
        told = sorted(answers[key])[0][1] if owner and answers.get(key) else None
        has = owner and bool(answers.get(key))
        at = level.get(key) if owner and problem is None else None
        keyless = None in key
        state = "duplicate_id" if not owner and not keyless else problem or ("unordered" if owner and at is None else "ok" if has else "no_result")
        out.append((conv, turn, pos, call_id, name, at, state, plain, told))
    return sorted(
        (
            (*row[:7], toolcalls.canonical({"arguments": None if row[7] is None else json.loads(row[7]), "id": row[3], "level": row[5], "name": row[4], "result": row[8], "status": row[6]}))
            for row in out
        ),
        key=str,
    )


def test_linked_calls(spark):
    ok = '{"q": "ü", "k": 1}'
    calls = [
        (1, 1, 0, "a", "search", ok), (1, 2, 0, "b", "read", '{"lines":[2,1],"doc":"${a}"}'), (1, 1, 1, "c", "compare", '{"b":"${b}","a":"x ${a}"}'),
        (1, 3, 0, "a", "search", ok), (1, 3, 1, "d", "read", '{"doc":"${d}"}'), (1, 3, 2, "e", "read", '{"doc":"${nowhere}"}'),
        (1, 3, 3, "f", "read", '{"doc":"${e}"}'), (2, 0, 0, "a", "search", '{"q": 1, "k": 1}'), (2, 0, 1, "b", "search", '{"q": "x", "k": true}'),
        (2, 0, 2, "c", "search", '{"q": "x"}'), (2, 0, 3, "g", "search", '{"q": "x", "k": 1, "z": 0}'), (2, 0, 4, "h", "none", "{}"),
        (2, 0, 5, "i", "search", "{"), (2, 0, 6, "j", "search", None), (2, 0, 7, "k", "search", "[1]"), (2, 0, 8, "l", "search", '{"q": NaN}'),
        (2, 1, 0, None, "search", ok), (None, 1, 0, "m", "search", ok), (3, 0, 0, "a", None, "{}"), (3, 1, 0, "z", "search", ok), (3, 1, 0, "z", "search", ok),
    ]
    calls += [(4, i, 0, f"n{i}", "read", json.dumps({"doc": "${n%d}" % (i - 1)}) if i else '{"doc": "start"}') for i in range(6)]
    results = [(1, 2, "a", "first"), (1, 1, "a", "earlier"), (1, 5, "b", None), (2, 5, "zz", "stray"), (2, 5, None, "no id"), (None, 1, "m", "x"), (3, 9, "z", "y" * 5_000)]
    df = spark.createDataFrame([(*c, 0) for c in calls], CALLS)
    found = toolcalls.link(df, spark.createDataFrame(results, RESULTS), toolcalls.TOOLS).collect()
    assert sorted((tuple(r) for r in found), key=str) == slow_links(calls, results, toolcalls.TOOLS)
    assert toolcalls.link(df.limit(0), spark.createDataFrame([], RESULTS), toolcalls.TOOLS).count() == 0


def test_calls_of_conversations(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    calls, results = toolcalls.from_conversations(turns)
    found = toolcalls.link(calls, results, toolcalls.TOOLS).collect()
    want = slow_links([tuple(r) for r in calls.collect()], [tuple(r) for r in results.collect()], toolcalls.TOOLS)
    assert sorted((tuple(r) for r in found), key=str) == want
    assert {"ok", "invalid_arguments", "no_result"} <= {r.status for r in found}
