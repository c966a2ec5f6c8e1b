"""Latin and Cyrillic Uzbek letters as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from cueweave.functions.text import APOSTROPHES, holds, named, where

# Letter pairs to Cyrillic, applied in this order.
PAIRS = (
    ("O'", "Ў"),
    ("o'", "ў"),
    ("G'", "Ғ"),
    ("g'", "ғ"),
    ("S[hH]", "Ш"),
    (r"[s\u017f][hH]", "ш"),
    ("C[hH]", "Ч"),
    ("c[hH]", "ч"),
    ("NG", "НГ"),
    ("Ng", "Нг"),
    ("n[gG]", "нг"),
    ("Y[oO]", "Ё"),
    ("y[oO]", "ё"),
    ("Y[uU]", "Ю"),
    ("y[uU]", "ю"),
    ("Y[aA]", "Я"),
    ("y[aA]", "я"),
    ("Y[eE]", "Е"),
    ("y[eE]", "е"),
)
# One Latin letter to one Cyrillic letter.
LATIN = "abcdefghijklmnopqrstuvwxyz"
LATIN_AS_CYRILLIC = "абцдефгҳижклмнопқрстуввхйз"
# One Cyrillic letter to one Latin character.
CYRILLIC = "АБВГДЕЖЗИЫЙКҚЛМНОПРСТУФХҲЦЭЪЬ" + "абвгдежзиыйкқлмнопрстуфхҳцэъь"
CYRILLIC_AS_LATIN = "ABVGDEJZIIYKQLMNOPRSTUFXHSE''" + "abvgdejziiykqlmnoprstufxhse''"
# One Cyrillic letter to two Latin characters.
CYRILLIC_AS_PAIR = (
    ("Ғ", "G‘"),
    ("ғ", "g‘"),
    ("Ё", "Yo"),
    ("ё", "yo"),
    ("Ч", "Ch"),
    ("ч", "ch"),
    ("Ш", "Sh"),
    ("ш", "sh"),
    ("Щ", "Sh"),
    ("щ", "sh"),
    ("Ю", "Yu"),
    ("ю", "yu"),
    ("Я", "Ya"),
    ("я", "ya"),
    ("Ў", "O‘"),
    ("ў", "o‘"),
)
CYRILLIC_BLOCK = r"[\u0400-\u04ff]"
VOWELS_AND_SIGNS = "[АаЕеЁёИиОоУуЎўЭэЮюЯяЪъЬь]"


def _spellings(pair: str) -> list[str]:
    """The strings that a pattern of :data:`PAIRS` stands for."""
    parts = re.findall(r"\[([^\]]+)\]|(.)", pair.replace(r"\u017f", "\u017f"))
    return ["".join(letters) for letters in product(*[several or one for several, one in parts])]


def _replaced(text: Column, forms: Sequence[tuple[str, str]]) -> Column:
    """A text with strings replaced one after the other; those that it does not hold are passed over.

    No replacement may bring in another one's string.
    """
    known = F.array(*[F.struct(F.lit(part).alias("part"), F.lit(form).alias("form")) for part, form in forms])

    def replaced(given: Column) -> Column:
        needed = F.filter(known, lambda x: F.contains(given, x["part"]))
        return F.aggregate(needed, given, lambda t, x: F.replace(t, x["part"], x["form"]))

    return named(text, replaced)


def to_cyrillic(text: Column) -> Column:
    """Latin Uzbek text in Cyrillic letters; other characters stay.

    Pairs go first, then ``e`` at the start of a word, then single letters.
    """
    # Here and below a letter is tried first and what precedes it looked at afterwards.
    out = F.regexp_replace(text, APOSTROPHES, "'")
    out = _replaced(out, [(spelt, letters) for pair, letters in PAIRS for spelt in _spellings(pair)])
    out = F.regexp_replace(out, r"e(?<!\p{L}e)", "э")
    out = where(out, lambda t: holds(t, "E"), lambda t: F.regexp_replace(t, r"E(?<!\p{L}E)", "Э"))
    source = LATIN + LATIN.upper() + "\u212a'"
    target = LATIN_AS_CYRILLIC + LATIN_AS_CYRILLIC.upper() + "Къ"
    return F.translate(out, source, target)


def to_latin(text: Column) -> Column:
    """Cyrillic Uzbek text in Latin letters; other characters stay.

    ``е`` reads ``ye`` unless a Cyrillic consonant stands before it.
    """
    out = text
    for letter, form in (("Е", "Ye"), ("е", "ye")):
        opening = rf"{letter}(?:(?<!{CYRILLIC_BLOCK}{letter})|(?<={VOWELS_AND_SIGNS}{letter}))"
        out = where(out, lambda t, c=letter: holds(t, c), lambda t, p=opening, r=form: F.regexp_replace(t, p, r))
    out = _replaced(out, CYRILLIC_AS_PAIR)
    return F.translate(out, CYRILLIC, CYRILLIC_AS_LATIN)


def in_script(text: Column, script: str | Column) -> Column:
    """Text in the wanted script: ``latin``, ``cyrillic`` or, for anything else, as is.

    ``script`` may be a column, to choose per row.
    """
    if isinstance(script, str):
        if script == "latin":
            return to_latin(text)
        return to_cyrillic(text) if script == "cyrillic" else text
    return (
        F.when(script == "latin", to_latin(text))
        .when(script == "cyrillic", to_cyrillic(text))
        .otherwise(text)
    )
