"""URL filters and sketches: brute force on small tables, and rows that are odd."""

import hashlib
import re

import pytest

from cueweave.llm import sketch, urls

PAGES = "page_id bigint, url string, html string, extra int"
RULES = urls.rules_of("block net/, allow example.net/en/, block example.com/de/, allow org/fr/")


def canonical(url):
    return f'<html><head><LINK href="{url}" rel="canonical"></head></html>'


def test_rules_hosts_and_paths(spark):
    rows = [
        (1, "http://A.Example.NET/en/1?x#y", None, 0),
        (2, "https://example.net/EN/", None, 0),
        (3, "https://notexample.net/en/", None, 0),
        (4, "http://x.example.com/de/a", None, 0),
        (5, "http://x.example.com/de", None, 0),
        (6, "ftp://h.org/fr/?q", None, 0),
        (7, "h.org/fr/", None, 0),
        (8, None, None, 0),
        (9, "http://net", None, 0),
        (10, "", None, 0),
        (11, "http://b.net?u=http://c.org/fr/", None, 0),
    ]
    found = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, PAGES), RULES).collect()}
    want = {
        1: ("a.example.net", "/en/1", "example.net/en/", "allow"),
        2: ("example.net", "/EN/", "net/", "block"),
        3: ("notexample.net", "/en/", "net/", "block"),
        4: ("x.example.com", "/de/a", "example.com/de/", "block"),
        5: ("x.example.com", "/de", None, "allow"),
        6: ("h.org", "/fr/", "org/fr/", "allow"),
        7: ("", "", None, "allow"),
        8: ("", "", None, "allow"),
        9: ("net", "", None, "allow"),
        10: ("", "", None, "allow"),
        11: ("b.net", "", None, "allow"),
    }
    assert {k: (r.host, r.path, r.rule, r.verdict) for k, r in found.items()} == want


def test_verdicts_spread_over_aliases(spark):
    rows = [
        (1, "http://a.com/1", canonical("http://b.com/2"), 0),
        (2, "http://b.com/2", canonical("http://evil.net/x"), 0),  # blocked by rule at the end
        (3, "http://c.com/3", canonical("http://d.com/4"), 0),  # d is both: allow wins
        (4, "http://d.com/4", canonical("http://e.net/5"), 0),
        (5, "http://f.com/6", '<meta http-equiv="refresh" content="0; url=http://d.com/4">', 0),
        (6, "http://g.org/fr/7", canonical("http://d.com/4"), 0),
        (7, "http://h.com/8", "<p>canonical</p>", 0),
        (8, "http://h.net/9", canonical("http://g.org/fr/7"), 0),  # its own rule stays
        (9, "https://a.com/1/#part", None, 0),  # another writing of page 1
        (9, "https://a.com/1/#part", None, 0),
        (10, "http://i.com/a", None, 0),
    ]
    redirects = spark.createDataFrame([("http://i.com/a", "http://a.com/1"), (None, "x")], "src string, dst string")
    found = urls.judge(spark.createDataFrame(rows, PAGES), RULES, redirects).collect()
    verdict = {r.page_id: r.verdict for r in found}
    assert verdict == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "block", 9: "block", 10: "block"}
    assert len(found) == len(rows)
    assert {r.inherited for r in found if r.page_id in (3, 4, 5)} == {"allow"}


def test_a_page_of_a_linked_place_lends_its_rule(spark):
    rows = [
        (1, "http://example.com/de/", None, 0),  # its link is written without the slash, and fits no rule
        (2, "http://a.com/1", canonical("http://example.com/de"), 0),
        (3, "http://x.org/fr/", None, 0),
        (4, "http://b.com/1", canonical("http://x.org/fr"), 0),
        (5, "http://b.com/1", canonical("http://evil.net/"), 0),
    ]
    found = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, PAGES), RULES).collect()}
    assert found == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


TARGETS = [
    ("http://a.com/x/y?q#f", "/de/x", "http://a.com/de/x"), ("http://a.com/x/y?q#f", "z?a=1&amp;b=2", "http://a.com/x/z?a=1&b=2"),
    ("http://a.com/x/y/", "../new", "http://a.com/x/new"), ("http://a.com", "../../n/./m/..", "http://a.com/n/"),
    ("https://a.com/x", "//evil.net/b", "https://evil.net/b"), ("http://a.com/x?q", "?r", "http://a.com/x?r"),
    ("http://a.com/x", "http://b.com/../c", "http://b.com/../c"), ("http://a.com/x", "mailto:me@b.com", None), ("a.com/x", "/y", None),
]


def test_targets_are_read_on_their_page(spark):
    rows = [(i, src, canonical(dst), 0) for i, (src, dst, _) in enumerate(TARGETS)]
    rows += [(90, "http://c.com/1", '<meta http-equiv="refresh" content="0; url=../new">', 0)]
    rows += [(91, "http://d.com/1", '<base href="//e.net/k/">' + canonical("2"), 0)]
    found = urls.page_links(spark.createDataFrame(rows, PAGES)).collect()
    want = [(src, dst) for src, _, dst in TARGETS if dst] + [("http://c.com/1", "http://c.com/new"), ("http://d.com/1", "http://e.net/k/2")]
    assert sorted(map(tuple, found)) == sorted(want)
    rows = [(1, "http://a.com/1", canonical("//evil.net/b"), 0), (2, "http://b.example.com/1", canonical("/de/x"), 0)]
    found = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, PAGES), RULES).collect()}
    assert found == {1: "block", 2: "block"}


def test_long_chains_and_empty_tables(spark):
    n = 40
    rows = [(i, f"http://s.com/{i}", canonical(f"http://s.com/{i + 1}"), 0) for i in range(n)]
    rows += [(n, f"http://s.com/{n}", canonical("http://bad.net/"), 0)]
    assert {r.verdict for r in urls.judge(spark.createDataFrame(rows, PAGES), RULES).collect()} == {"block"}
    assert urls.judge(spark.createDataFrame([], PAGES), RULES).count() == 0


def test_native_plans(spark):
    for df in (
        urls.judge(spark.createDataFrame([(1, "http://a.net/", "", 0)], PAGES), RULES),
        sketch.compare_with_next(spark.createDataFrame([(1, "a b")], "doc_id long, text string")),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


TEXTS = [
    (5, "one two three four five six seven"),
    (4, "One two THREE four five six seven"),
    (9, None),
    (7, ""),
    (1, "é" * 9 + " ünd 𝒳𝒴 " + "wort " * 40),
    (3, "short"),
    (8, " \n\t "),
    (2, "x y z " * 3000),
]


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_next_document_and_edit(spark, parts):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    paired = {r.doc_id: r for r in sketch.with_next(df, ["text"], parts).collect()}
    order = sorted(TEXTS, reverse=True)
    assert len(paired) == len(order)
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        assert (paired[doc].text, paired[doc].next_text) == (text, after)


def test_edits_are_hashed_whole(spark):
    df = spark.createDataFrame([(*r, 1) for r in TEXTS], "doc_id long, text string, extra int")
    found = {r.doc_id: r for r in sketch.compare_with_next(df).collect()}
    order = [(d, t or "") for d, t in sorted(TEXTS, key=lambda r: -r[0])]
    for (doc, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        assert found[doc].n_chars == len(text)
        assert found[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= found[doc].near_edited <= 1 and 0 <= found[doc].near_next <= 1
    assert found[5].fingerprint == found[4].fingerprint and found[5].near_next == 1
    assert found[9].fingerprint == found[7].fingerprint == found[8].fingerprint == ""
    assert found[3].fingerprint not in ("", found[5].fingerprint)


def test_one_row_meets_itself_and_none_is_fine(spark):
    one = sketch.compare_with_next(spark.createDataFrame([(3, "a b c d e f g")], "doc_id long, text string"))
    assert [r.near_next for r in one.collect()] == [1.0]
    assert sketch.compare_with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = spark.createDataFrame([(3, "a"), (3, "a"), (None, "b"), (None, None)], "doc_id long, text string")
    assert sketch.compare_with_next(twice).count() == 4


def test_estimates_and_merging(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    found = {r.doc_id: r for r in sketch.compare_with_next(docs).collect()}
    texts = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)

    def shingles(text):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text)) if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    errors = []
    for (doc, text), (_, after) in zip(texts, texts[1:] + texts[:1], strict=True):
        k = len(text) // 3
        a, b = shingles(text), shingles(text[: len(text) - k] + after[:k])
        if len(a) > 100:
            errors.append(abs(len(a & b) / len(a) - found[doc].contained_in_edited))
    assert sum(errors) / len(errors) < 0.06

    halves = spark.createDataFrame([("a b c d e f g h i j k l m n o p", "q r s t u v w x y z 1 2 3 4 5 6")], "x string, y string")
    both = sketch.with_sketch(sketch.with_sketch(halves, "x", "sx"), "y", "sy")
    row = both.select(sketch.merge(both.sx, both.sy).alias("m"), "sx", "sy").first()
    assert row.m == sorted(set(row.sx) | set(row.sy))
