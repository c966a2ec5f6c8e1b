"""Spacing, sentence-end tests and Uzbek clean-up rules as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
# White space as the string library of the input format defines it; Java's \s lacks
# some.  Three ranges first, so that a letter is turned down after three comparisons.
SPACE = (
    r"[\t-\x20\x85-\xa0\u1680-\u3000&&[^\x0e-\x1b\x86-\x9f\u1681-\u1fff\u200b-\u2027"
    r"\u202a-\u202e\u2030-\u205e\u2060-\u2fff]]"
)
# Neither white space nor a punctuation mark: all else, in the same order of tests.
NOT_SPACE_OR_STOP = rf"(?!{SPACE})[^,.;:!?…]"
ELLIPSIS = "…"
STOPS = (".", "!", "?", ELLIPSIS)
SOFT_STOPS = (",", ";", ":")
GLUED = SOFT_STOPS + STOPS
GLUED_CLASS = r"[,.;:!?…]"
STOP_CLASS = r"[.!?…]"
# Signs written for an apostrophe.
APOSTROPHES = r"[\u02bb\u02bc\u2018\u2019`\u00b4']"
# Letters of a marker word, and the marker words of either rule.
MARKER_TOKEN = r"[A-Za-z\u0400-\u04ff\u2018\u2019']+"
TIMING_MARKERS = (
    "keyin",
    "shunda",
    "lekin",
    "ammo",
    "biroq",
    "xullas",
    "mana",
    "hozir",
    "umuman",
    "demak",
)
SENTENCE_MARKERS = (
    "Keyin",
    "Shunda",
    "Lekin",
    "Ammo",
    "Biroq",
    "Hozir",
    "Umuman",
    "Xullas",
    "Mana",
    "Demak",
)

# A word character is a letter, a number or "_"; an edge lies where that changes.
_W = r"[\p{L}\p{N}_]"
EDGE = rf"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"
_SUFFIX = r"([a-z‘’]*)"

# Fixed values: (word, what may follow it, replacement), applied in this order, letter
# case ignored, whole words only.
COMMON_WORDS = (
    ("manga", "", "menga"),
    ("man", "", "men"),
    ("misofir", "", "musofir"),
    ("bir birimiz", "", "bir-birimiz"),
    ("bir biriga", "", "bir-biriga"),
    ("bir birini", "", "bir-birini"),
    ("bir bir", "", "bir-bir"),
    ("ota onam", _SUFFIX, "ota-onam$1"),
)
PROPER_NOUNS = (
    ("iso", rf"{SPACE}+masih", "Iso Masih"),
    ("injil", "", "Injil"),
    ("tavrot", "", "Tavrot"),
    ("zabur", "", "Zabur"),
    ("iso", "", "Iso"),
    ("masih", "", "Masih"),
    ("rossiya", _SUFFIX, "Rossiya$1"),
    ("novosibirsk", _SUFFIX, "Novosibirsk$1"),
    (f"farg{APOSTROPHES}ona", _SUFFIX, "Farg‘ona$1"),
    (f"o{APOSTROPHES}zbekiston", _SUFFIX, "O‘zbekiston$1"),
    (f"qur{APOSTROPHES}on", "", "Qur’on"),
    ("xudo", _SUFFIX, "Xudo$1"),
)

# Marks sentence starts between two passes; a code point that never encodes text.
_MARK = "\ufdd0"


# Most rules find nothing to do in most texts, and a search for bytes is far cheaper than a pass of a
# regular expression.  A rule that looks before it rewrites reads its argument several times, so the
# argument is worked out once and named.


def named(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is read there."""
    return F.transform(F.array(value), body)[0]


def where(text: Column, needed: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """``text``, changed where that is needed."""
    return named(text, lambda t: F.when(needed(t), change(t)).otherwise(t))


def holds(text: Column, *parts: str) -> Column:
    """True where a text holds one of some strings, letter for letter."""
    return reduce(or_, [F.contains(text, F.lit(part)) for part in parts])


def strip_space(text: Column) -> Column:
    """Remove white space at both ends."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def tidy_spaces(text: Column) -> Column:
    """One space between words, none at the ends, none before a punctuation mark."""
    collapsed = F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))
    return F.regexp_replace(collapsed, rf" +({GLUED_CLASS})", "$1")


# Most tokens hold no white space at all and skip the rewriting.  These two read their
# argument more than once, so they are for stored columns, not for nested expressions.


def strip_token(text: Column) -> Column:
    """``strip_space`` for a column of single tokens."""
    return F.when(text.rlike(SPACE), strip_space(text)).otherwise(text)


def tidy_token(text: Column) -> Column:
    """``tidy_spaces`` for a column of single tokens."""
    return F.when(text.rlike(SPACE), tidy_spaces(text)).otherwise(text)


def ends_with_stop(text: Column) -> Column:
    """True where the text's last character ends a sentence."""
    return F.right(text, F.lit(1)).isin(*STOPS)


def ends_with_soft_stop(text: Column) -> Column:
    """True where the text's last character is a comma, semicolon or colon."""
    return F.right(text, F.lit(1)).isin(*SOFT_STOPS)


def takes_space(piece: Column) -> Column:
    """True where a tidied piece is set off by a space when put after other text."""
    return (piece != "") & ~F.left(piece, F.lit(1)).isin(*GLUED)


def split_sentences(text: Column) -> Column:
    """Array of the sentences of a plain text, cut after sentence-ending marks."""
    parts = F.split(tidy_spaces(text), rf"(?<={STOP_CLASS}){SPACE}+")
    return F.filter(F.transform(parts, strip_space), lambda part: part != "")


def opening_marker(text: Column, markers: tuple[str, ...] | None = None) -> Column:
    """True where the first letter group of a token is one of the markers."""
    first = F.lower(F.regexp_extract(text, MARKER_TOKEN, 0))
    return (first != "") & first.isin(*(markers or TIMING_MARKERS))


def tidy_readable(text: Column) -> Column:
    """Readable spacing: a space after punctuation, none before, clean line ends."""
    out = where(text, lambda t: holds(t, "  ", "\t", "\xa0"), lambda t: F.regexp_replace(t, r"[ \t\xa0]+", " "))
    spaced = rf"{GLUED_CLASS}(?<={SPACE}{GLUED_CLASS})"
    out = where(out, lambda t: t.rlike(spaced), lambda t: F.regexp_replace(t, rf"{SPACE}+({GLUED_CLASS})", "$1"))
    out = F.regexp_replace(out, rf"({GLUED_CLASS})(?={NOT_SPACE_OR_STOP})", "$1 ")
    # A line end that stands alone among white space stays as it is.
    loose = rf"\n(?:{SPACE}|(?<={SPACE}\n))"
    out = where(out, lambda t: t.rlike(loose), lambda t: F.regexp_replace(t, rf"{SPACE}*\n{SPACE}*", "\n"))
    out = where(out, lambda t: holds(t, "  "), lambda t: F.regexp_replace(t, r" {2,}", " "))
    return where(out, lambda t: F.left(t, F.lit(1)).rlike(SPACE) | F.right(t, F.lit(1)).rlike(SPACE), strip_space)


def repair_apostrophes(text: Column) -> Column:
    """Any apostrophe between two Latin letters becomes U+2019.

    The o'/g' rule that would give U+2018 is always overridden by this one, so
    U+2018 comes back only through the proper-noun rules.
    """
    return F.regexp_replace(text, rf"{APOSTROPHES}(?<=[A-Za-z]{APOSTROPHES})(?=[A-Za-z])", "’")


def _folded(text: Column) -> Column:
    """Lower case, with the four signs that ``(?iu)`` takes for a plain letter as that letter."""
    for sign, letter in (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s"), ("\u212a", "k")):
        text = F.replace(text, F.lit(sign), F.lit(letter))
    return F.lower(text)


def _rewrite(text: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    # The word is tried first and its left edge looked at afterwards: most positions then fail on one
    # character.  No rule brings in a word of another one, so the text as it was given tells which
    # rules have something to do.
    known = F.array(
        *[
            F.struct(
                F.lit(max(word.split(APOSTROPHES), key=len)).alias("part"),
                F.lit(f"(?iu){word}(?<!{_W}{word}){rest}{EDGE}").alias("pattern"),
                F.lit(replacement).alias("form"),
            )
            for word, rest, replacement in rules
        ]
    )

    def rewritten(given: Column, lower: Column) -> Column:
        needed = F.filter(known, lambda rule: F.contains(lower, rule["part"]))
        return F.aggregate(needed, given, lambda t, rule: F.regexp_replace(t, rule["pattern"], rule["form"]))

    return named(text, lambda given: named(_folded(given), lambda lower: rewritten(given, lower)))


def replace_common_words(text: Column) -> Column:
    """Put frequent words into their standard form."""
    return _rewrite(text, COMMON_WORDS)


def capitalize_names(text: Column) -> Column:
    """Give proper nouns their capital letters."""
    return _rewrite(text, PROPER_NOUNS)


def break_before_markers(text: Column, markers: tuple[str, ...] | None = None) -> Column:
    """End the sentence before a capitalized discourse marker."""
    markers = SENTENCE_MARKERS if markers is None else markers
    names = "|".join(re.escape(m) for m in markers)
    if not names:
        return F.regexp_replace(text, rf"\.{SPACE}*\.", ".")
    # The space is tried first and what precedes it looked at afterwards.
    before = rf"{SPACE}(?<!{STOP_CLASS}{SPACE}){SPACE}*({names}){EDGE}"
    out = where(text, lambda t: holds(t, *markers), lambda t: F.regexp_replace(t, before, ". $1"))
    return F.regexp_replace(out, rf"\.{SPACE}*\.", ".")


def capitalize_sentences(text: Column) -> Column:
    """Upper-case a plain Latin or Cyrillic letter that opens a sentence or line."""
    letters = "[a-zа-яё]"
    marked = F.regexp_replace(
        text, rf"(\n|{STOP_CLASS}{SPACE}+)(?={letters})", f"$1{_MARK}"
    )

    def opened(piece: Column) -> Column:
        first = F.left(piece, F.lit(1))
        return F.when(first.rlike(letters), F.concat(F.upper(first), F.substr(piece, F.lit(2)))).otherwise(piece)

    def joined(text: Column) -> Column:
        return F.array_join(F.transform(F.split(text, _MARK), opened), "")

    return named(marked, lambda t: F.when(holds(t, _MARK), joined(t)).otherwise(opened(t)))


def clean_text(text: Column, marker_breaks: bool = False) -> Column:
    """Full clean-up of running text."""
    out = repair_apostrophes(tidy_readable(text))
    out = _rewrite(out, COMMON_WORDS + PROPER_NOUNS)
    if marker_breaks:
        out = break_before_markers(out)
    return capitalize_sentences(tidy_readable(out))


#: The rules of ``clean_text`` in order, by name; "breaks" is for whole transcripts only.
CLEAN_STEPS = (
    ("spacing", tidy_readable),
    ("apostrophes", repair_apostrophes),
    ("common_words", replace_common_words),
    ("names", capitalize_names),
    ("breaks", break_before_markers),
    ("spacing_again", tidy_readable),
    ("capitals", capitalize_sentences),
)


# A token without any of these is not touched by the rules for words and names.
_OPENINGS = "|".join(sorted({word.split(" ")[0] for word, _, _ in COMMON_WORDS + PROPER_NOUNS if APOSTROPHES not in word}))
_MAY_CHANGE = f"(?iu){APOSTROPHES}|{_OPENINGS}"


def clean_token(text: Column) -> Column:
    """Clean-up of one word, without touching spacing or sentence starts."""
    return where(
        text, lambda t: t.rlike(_MAY_CHANGE), lambda t: _rewrite(repair_apostrophes(t), COMMON_WORDS + PROPER_NOUNS)
    )
