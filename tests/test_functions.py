import random

import brute
import pytest
from pyspark.sql import functions as F

from cueweave.functions.pauses import with_pauses
from cueweave.functions.script import LATIN, LATIN_AS_CYRILLIC, PAIRS, in_script, to_cyrillic, to_latin
from cueweave.functions.subtitles import (
    cyrillic_file_name,
    is_meta_line,
    subtitle_line_to_cyrillic,
    wrap_two_lines,
)
from cueweave.functions.text import (
    _W,
    APOSTROPHES,
    COMMON_WORDS,
    EDGE,
    GLUED_CLASS,
    NOT_SPACE_OR_STOP,
    PROPER_NOUNS,
    SPACE,
    break_before_markers,
    capitalize_names,
    clean_text,
    clean_token,
    repair_apostrophes,
    replace_common_words,
    strip_space,
    tidy_readable,
    tidy_spaces,
)
from cueweave.functions.timecode import srt_timecode
from cueweave.operators.cues import words_to_cues
from cueweave.operators.sentences import words_to_sentences
from cueweave.schemas import SOCIAL, STANDARD


def applied(spark, function, values, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r.out for r in df.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


def test_space_class_is_the_string_library_s(spark):
    chars = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    got = applied(spark, lambda c: c.rlike(f"^{SPACE}\\z"), chars)
    assert [c for c, space in zip(chars, got) if space] == [c for c in chars if c.isspace()]


def test_spacing(spark):
    texts = ["", " a  b ", "a , b", "a .\x1cb", "a , , b", " x !", "\n", "ab"]
    assert applied(spark, tidy_spaces, texts) == [brute.tidy(t) for t in texts]
    assert applied(spark, strip_space, texts) == [t.strip() for t in texts]


def test_timecodes(spark):
    got = applied(spark, srt_timecode, [0.0, -3.0, 0.0025, 0.0035, 3661.9996, 362439.001, 59.9995], "double")
    assert got == [
        "00:00:00,000",
        "00:00:00,000",
        "00:00:00,002",
        "00:00:00,004",
        "01:01:02,000",
        "100:40:39,001",
        "00:01:00,000",
    ]


def test_to_latin(spark):
    pairs = {
        "Дўстим бугун келади, биз уни кутамиз.": "Do‘stim bugun keladi, biz uni kutamiz.",
        "Ер еее оеЕ ШЕ ъе": "Yer yeyeye oyeYe ShE 'ye",
        "Ўғил Ҳаёт Щука Қ ь": "O‘g‘il Hayot Shuka Q '",
    }
    assert applied(spark, to_latin, list(pairs)) == list(pairs.values())


def test_to_cyrillic(spark):
    pairs = {
        "Salom do'st, O‘zbek gʻoz G`": "Салом дўст, Ўзбек ғоз Ғ",
        "SHahar Shahar sHa choy CHOY": "Шаҳар Шаҳар ша чой ЧОЙ",
        "yangi YANGI yaNGi yaNgi": "янги ЯНГИ яНГи яНги",
        "erta -e e-e me E Ee yetti Yer": "эрта -э э-э ме Э Эе етти Ер",
        "K ſh W ma'no": "К ш В маъно",
    }
    assert applied(spark, to_cyrillic, list(pairs)) == list(pairs.values())


def test_script_modes(spark):
    df = spark.createDataFrame(
        [("latin", "Шу"), ("cyrillic", "shu"), ("source", "shuШ")], "mode string, text string"
    )
    by_row = [r[0] for r in df.select(in_script(F.col("text"), F.col("mode"))).collect()]
    assert by_row == ["Shu", "шу", "shuШ"]
    assert applied(spark, lambda c: in_script(c, "source"), ["Шu"]) == ["Шu"]


def test_subtitle_lines(spark):
    lines = ["1", " ", "00:00:01,000 --> 00:00:02,500", "²", "<i>Salom</i> do'st", "<b>Bahor</b> keldi",
             "er<u>er", "a < b > e", "x <"]
    got = applied(spark, subtitle_line_to_cyrillic, lines)
    assert got == lines[:4] + [
        "<i>Салом</i> дўст",
        "<b>Баҳор</b> келди",
        "эр<u>эр",
        "а < b > э",
        "х <",
    ]
    assert applied(spark, is_meta_line, lines) == [True] * 4 + [False] * 5


def test_cyrillic_file_names(spark):
    got = applied(spark, cyrillic_file_name, ["a_latin.srt", "a.srt", "a.SRT", "a"])
    assert got == ["a_cyrillic.srt", "a_cyrillic.srt", "a.SRT_cyrillic.srt", "a_cyrillic.srt"]


def test_wrapping(spark):
    texts = [
        "",
        "one",
        "a" * 50,
        "a" * 50 + " " + "b" * 50 + " c",
        "word " * 30,
        ("x" * 42 + " ") * 2,
        "x" * 41 + " yy " + "z" * 40,
        "ab " * 14 + "abcdef " * 9,
        "aa " * 13 + "b" * 45 + " c",
    ]
    assert applied(spark, wrap_two_lines, texts) == [brute.two_lines(t) for t in texts]


def test_clean_up(spark):
    text = "manga kitob bergan man edim, xudo haqida iso aytgan so'z o'zbekiston uchun"
    assert applied(spark, clean_text, [text, "bo'lib", "3.14 ,x", "a.  b\n c! é? ё"]) == [
        "Menga kitob bergan men edim, Xudo haqida Iso aytgan so’z O‘zbekiston uchun",
        "Bo’lib",
        "3. 14, x",
        "A. B\nC! é? Ё",
    ]
    tokens = ["Man", "XUDOga", "man.", "mané", "_man", "qur'on", "a'b'c", "xudo‘", "İso", "novosibirſKda"]
    assert applied(spark, clean_token, tokens) == [
        "men", "Xudoga", "men.", "mané", "_man", "Qur’on", "a’b’c", "Xudo‘", "Iso", "Novosibirskda",
    ]
    breaks = ["bir Keyin Shunda ikki", "bir. Keyin", "bir keyin", "Keyin", "x Keyinchalik", "a. . b"]
    assert applied(spark, break_before_markers, breaks) == [
        "bir. Keyin. Shunda ikki", "bir. Keyin", "bir keyin", "Keyin", "x Keyinchalik", "a. b",
    ]
    assert applied(spark, tidy_readable, ["a \tb ,c", " x \n\n y ", "e…f"]) == ["a b, c", "x\ny", "e… f"]


CHARACTERS = "array<struct<text:string,start:double,end:double>>"
WORDS = (
    "transcript_id string, n_words long, idx long, type string, text string, start double, "
    f"end double, speaker string, characters {CHARACTERS}"
)


def spelled(text, base, *times):
    return [(c, base + a, base + b) for c, (a, b) in zip(text, times)]


# Four letters of a tenth of a second; the last one goes on for a second more.
TOSHA = spelled("tosha", 20, (0.0, 0.1), (0.1, 0.2), (0.2, 0.3), (0.3, 0.4), (0.4, 1.5))
# Even letters: nothing is hidden.
DARYO = spelled("daryo", 22, (0.0, 0.1), (0.1, 0.2), (0.2, 0.3), (0.3, 0.4), (0.4, 0.6))
# The mark at the end is not spoken; the letter before it holds the pause.
OQDI = spelled("oqdi,", 10, (0.0, 0.125), (0.125, 0.25), (0.25, 0.375), (0.375, 1.5), (1.5, 1.5))


def word_rows(spark, *rows):
    made = [
        ("r", len(rows), i, "word", text, start, end, "s", characters)
        for i, (text, start, end, characters) in enumerate(rows)
    ]
    return spark.createDataFrame(made, WORDS)


def test_stretched_characters(spark):
    df = word_rows(
        spark,
        ("tosha", 20.0, 21.5, TOSHA),
        ("daryo", 22.0, 22.6, DARYO),
        ("oqdi,", 10.0, 11.5, OQDI),
        ("yo'q", 1.0, 2.0, None),
        ("ha", 1.0, 2.0, [("h", 1.0, 1.1), ("a", 1.1, 2.0)]),
    )
    got = {r.text: (r.speech_end, r.pause_gap) for r in with_pauses(df).collect()}
    # Twice the median letter (0.1 s) is kept of the last one: it ends at 20.4 + 0.2.
    assert got["tosha"] == (pytest.approx(20.6), pytest.approx(0.9))
    assert got["daryo"] == (22.6, 0.0)
    assert got["oqdi,"] == (10.375 + 0.25, 11.5 - 10.625)
    assert got["yo'q"] == got["ha"] == (2.0, 0.0)
    off = {r.text: (r.speech_end, r.pause_gap) for r in with_pauses(df, False).collect()}
    assert off["tosha"] == (21.5, 0.0)


def test_detected_pauses_split_cues_and_sentences(spark):
    four = word_rows(
        spark,
        ("suv", 9.5, 9.9, None),
        ("oqdi,", 10.0, 11.5, OQDI),
        ("kun", 11.54, 12.0, None),
        ("botdi", 12.1, 12.7, None),
    )
    assert words_to_cues(four, STANDARD).count() == 1
    assert [c.text for c in words_to_cues(four, STANDARD, True).orderBy("cue_no").collect()] == [
        "suv oqdi,",
        "kun botdi",
    ]
    social = words_to_cues(four, SOCIAL, True).orderBy("cue_no").collect()
    assert social[0].end < 11.5 and social[0].end < social[1].start
    five = word_rows(
        spark,
        ("qir", 19.0, 19.4, None),
        ("oshib", 19.5, 19.9, None),
        ("tosha", 20.0, 21.5, TOSHA),
        ("keng", 21.56, 21.9, None),
        ("daryo", 22.0, 22.6, DARYO),
    )
    assert words_to_sentences(five, timing=True).count() == 1
    split = words_to_sentences(five, timing=True, pause_detection=True).orderBy("sent_no").collect()
    assert [s.text for s in split] == ["qir oshib tosha", "keng daryo"]


def test_own_markers_are_plain_text(spark):
    got = applied(spark, lambda c: break_before_markers(c, ("A.B", "C")), ["x AxB y", "x A.B y", "x C y"])
    assert got == ["x AxB y", "x. A.B y", "x. C y"]


def test_rules_that_look_first_change_what_plain_patterns_change(spark):
    """Searches before a rule spare passes, and no result: every rule against its patterns alone."""
    rng = random.Random(8)
    bits = " |  |\n|\t|\xa0|\u2003|.|,|!|…| .| \n|e|E|sh|ſh|SH|Yo|o'|O‘|ng|NG|man|Manga|mİsofir|bir birİmiz|bir bir|ota onam"
    bits = (bits + "|iso masih|ıso|İso\nmasih|farg'ona|FARG`ona|o’zbekiston|qur'on|xudoga|Roſſiya|novosibirsK|a|b|1|_|ß|ў").split("|")
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(3_000)] + ["", None, "\n", " \n"]

    def chain(*steps):
        def change(text):
            for pattern, form in steps:
                text = F.regexp_replace(text, pattern, form)
            return text

        return change

    tidy = chain(
        (r"[ \t\xa0]+", " "),
        (rf"{SPACE}+({GLUED_CLASS})", "$1"),
        (rf"({GLUED_CLASS})(?={NOT_SPACE_OR_STOP})", "$1 "),
        (rf"{SPACE}*\n{SPACE}*", "\n"),
        (r" {2,}", " "),
        (rf"^{SPACE}+|{SPACE}+\z", ""),
    )
    apostrophes = chain((rf"(?<=[A-Za-z]){APOSTROPHES}(?=[A-Za-z])", "’"))
    words, names = (
        chain(*[(f"(?iu){w}(?<!{_W}{w}){rest}{EDGE}", form) for w, rest, form in rules]) for rules in (COMMON_WORDS, PROPER_NOUNS)
    )
    letters = chain((APOSTROPHES, "'"), *PAIRS, (r"(?<!\p{L})e", "э"), (r"(?<!\p{L})E", "Э"))
    source, target = LATIN + LATIN.upper() + "\u212a'", LATIN_AS_CYRILLIC + LATIN_AS_CYRILLIC.upper() + "Къ"
    for rule, plain in (
        (tidy_readable, tidy),
        (repair_apostrophes, apostrophes),
        (replace_common_words, words),
        (capitalize_names, names),
        (clean_token, lambda t: names(words(apostrophes(t)))),
        (to_cyrillic, lambda t: F.translate(letters(t), source, target)),
    ):
        assert applied(spark, rule, texts) == applied(spark, plain, texts)


def test_clean_up_is_a_shallow_expression(spark):
    """Rules are folded over, not nested: the analyzer's rounds do not run out on a deep use of them."""
    raw = spark.createDataFrame([("Iso  masih ,keyin manga",)], "text string")
    deep = F.col("text")
    for _ in range(2):
        deep = to_latin(to_cyrillic(clean_text(deep, marker_breaks=True)))
    assert raw.select(deep).first()[0]
