"""DuckDB statements that restate the queries, independently of the Spark code."""

from __future__ import annotations

import mimetypes

PHRASES = (
    " manga kitob bergan man edim, xudo haqida iso aytgan so'z o'zbekiston uchun ",
    " ota onamlar ROSSIYADA,novosibirskda. keyin  Keyin Shunda man ketdim ! bir birimiz",
    "\n\n qur'on va INJIL .tavrot\u00a0zabur; farg'onada SHaHaR choy yo'l yulduz yana yetti e-e NG Ng bir bir ",
    " Xudoga iso Masih… erta ertalab Ertaga G'alaba o\u02bbg\u02bcil Manga Demak 3.14 bir biriga bir birini",
)
OWN_MARKERS = ("the", "la", "der", "el", "and", "die")
NAME_ENDINGS = ("_latin.srt", ".srt", ".SRT", "", "_latin.srt.srt")
MEDIA_ENDINGS = (".mp3", ".WAV", ".txt", ".json", "", ".webm", ".Json", ".wma", ".m4a")


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def pick(values: tuple[str, ...], key: str) -> str:
    return f"([{', '.join(q(v) for v in values)}])[({key} % {len(values)})::INT + 1]"


def words_cte(table: str, key: str, turn: str, speaker: str, prefix: str = "") -> str:
    return f"""
turn_tokens AS (
  SELECT {q(prefix)} || CAST({key} AS VARCHAR) AS transcript_id, {key} AS k, {turn} AS turn,
         {speaker} AS speaker,
         list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda t: t <> '') AS toks
  FROM {table}),
tok_rows AS (
  SELECT transcript_id, k, turn, speaker, unnest(toks) AS text,
         generate_subscripts(toks, 1) - 1 AS pos FROM turn_tokens),
tok_idx AS (
  SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY turn, pos) - 1 AS idx,
         count(*) OVER (PARTITION BY transcript_id) AS n_words FROM tok_rows),
tok_len AS (
  SELECT *, CASE (k * 7 + turn * 13 + pos * 29) % 17
              WHEN 0 THEN 2000 WHEN 1 THEN 1000 WHEN 2 THEN 700 WHEN 3 THEN 800 ELSE 40 END AS pause,
         CASE WHEN length(text) >= 4 AND idx % 11 = 5 THEN 760
              WHEN length(text) >= 4 AND idx % 11 = 8 THEN 1200 ELSE 0 END AS stretch
  FROM tok_idx),
tok_ms AS (
  SELECT *, 60 + 35 * length(text) + stretch AS dur,
         sum(pause + 60 + 35 * length(text) + stretch)
           OVER (PARTITION BY transcript_id ORDER BY idx) AS end_ms
  FROM tok_len),
words AS (
  SELECT transcript_id, n_words, idx, 'word' AS type, text,
         CAST(end_ms - dur AS DOUBLE) / 1000.0e0 AS "start", CAST(end_ms AS DOUBLE) / 1000.0e0 AS "end",
         speaker, end_ms - dur AS start_ms, stretch
  FROM tok_ms)"""


WORDS = words_cte("conversations", "conv_id", "turn", "role")
DOCUMENT_WORDS = words_cte("documents", "doc_id", "0", "source", "doc-")

# Closing punctuation of every fifth word as its own token.
PUNCTUATED = """
marked AS (
  SELECT *, idx % 5 = 0 AND regexp_full_match(text, '.+[.,;:!?…]') AS cut FROM words),
words_p AS (
  SELECT transcript_id, idx * 2 AS idx, 'word' AS type,
         CASE WHEN cut THEN left(text, length(text) - 1) ELSE text END AS text,
         "start", "end", speaker FROM marked
  UNION ALL
  SELECT transcript_id, idx * 2 + 1, 'punctuation', right(text, 1), "end", "end", speaker
  FROM marked WHERE cut)"""

# Word ends shortened where the last spoken character is stretched.
PAUSES = """
letters AS (
  SELECT transcript_id, idx, "start", "end", j, substr(text, j, 1) AS ch, length(text) AS len,
         CAST(start_ms + CASE WHEN j = 1 THEN 0 ELSE 60 + 35 * (j - 1) END AS DOUBLE) / 1000.0e0 AS cs,
         CAST(start_ms + 60 + 35 * j + CASE WHEN j = length(text) THEN stretch ELSE 0 END AS DOUBLE) / 1000.0e0 AS ce
  FROM (SELECT *, unnest(range(1, length(text) + 1)) AS j FROM words) x),
heard AS (
  SELECT *, max(j) OVER (PARTITION BY transcript_id, idx) AS anchor FROM letters
  WHERE len >= 3 AND ce - cs > 0 AND regexp_matches(ch, '[\\p{L}\\p{N}]')),
shape AS (
  SELECT transcript_id, idx, any_value("start") AS ws, any_value("end") AS we,
         max(cs) FILTER (WHERE j = anchor) AS a_s, max(ce) FILTER (WHERE j = anchor) AS a_e,
         list_sort(list(ce - cs) FILTER (WHERE j < anchor)) AS before
  FROM heard GROUP BY transcript_id, idx),
measure AS (
  SELECT *, a_e - a_s AS d, before[len(before)] AS mx,
         CASE WHEN len(before) % 2 = 1 THEN before[(len(before) + 1) // 2]
              ELSE (before[len(before) // 2] + before[len(before) // 2 + 1]) / 2 END AS med
  FROM shape WHERE len(before) >= 2),
cuts AS (
  SELECT transcript_id, idx, ws, we, a_e,
         a_s + least(d, least(0.30e0, greatest(0.16e0, mx * 1.25e0, med * 2.0e0))) AS cut
  FROM measure
  WHERE a_e - ws > 0 AND d >= 0.35e0 AND d / (a_e - ws) >= 0.45e0 AND d - mx >= 0.18e0
    AND (d >= mx * 2.5e0 OR d >= med * 4.0e0)),
paused AS (
  SELECT w.* EXCLUDE ("end"), w."end" AS raw_end,
         CASE WHEN c.cut IS NOT NULL THEN greatest(w."start", least(w."end", c.cut)) ELSE w."end" END AS "end",
         CASE WHEN c.cut IS NOT NULL THEN greatest(w."end" - c.cut, 0.0e0) ELSE 0.0e0 END AS pause_gap
  FROM words w LEFT JOIN (SELECT * FROM cuts WHERE cut < a_e AND cut > ws) c
    USING (transcript_id, idx))"""
NO_PAUSES = """
paused AS (SELECT *, "end" AS raw_end, 0.0e0 AS pause_gap FROM words)"""

STOP = "right({0}, 1) IN ('.', '!', '?', '…')"
SOFT = "right({0}, 1) IN (',', ';', ':')"
SPACED = "left({0}, 1) NOT IN (',', '.', ';', ':', '!', '?', '…')"


def sentences_cte(source: str, timing: str | None = None) -> str:
    """Sentence rows from ``source``; ``timing`` is the extra break condition."""
    return f"""
s_tok AS (
  SELECT *, lag({STOP.format('text')}) OVER w AS stop_before,
         last_value(CASE WHEN type = 'word' THEN {{'e': "end", 'p': pause_gap >= 0.6}} END IGNORE NULLS)
           OVER (PARTITION BY transcript_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM {source} WINDOW w AS (PARTITION BY transcript_id ORDER BY idx)),
s_gap AS (
  SELECT *, greatest("start" - before.e, 0.0e0) AS gap, before.p AS flag,
         lower(regexp_extract(text, '[A-Za-z\u0400-\u04ff\u2018\u2019'']+')) AS marker FROM s_tok),
s_no AS (
  SELECT *, sum(CASE WHEN coalesce(stop_before, true)
                       OR (type = 'word' AND coalesce({timing or 'false'}, false)) THEN 1 ELSE 0 END)
              OVER (PARTITION BY transcript_id ORDER BY idx) AS sent_no FROM s_gap),
s_votes AS (
  SELECT transcript_id, sent_no, speaker, count(*) AS n, min(idx) AS first_idx
  FROM s_no WHERE type = 'word' AND speaker IS NOT NULL GROUP BY ALL),
s_best AS (
  SELECT transcript_id, sent_no, speaker FROM s_votes
  QUALIFY row_number() OVER (PARTITION BY transcript_id, sent_no ORDER BY n DESC, first_idx) = 1),
s_text AS (
  SELECT transcript_id, sent_no,
         regexp_replace(trim(string_agg(CASE WHEN type = 'word' THEN ' ' || text ELSE text END, '' ORDER BY idx)),
                        ' +([,.;:!?…])', '\\1', 'g') AS text
  FROM s_no GROUP BY ALL),
sentences AS (
  SELECT t.transcript_id, CAST(t.sent_no AS BIGINT) AS sent_no, t.text, b.speaker
  FROM s_text t LEFT JOIN s_best b USING (transcript_id, sent_no))"""


def by_time(gap: float, hard: float, markers: tuple[str, ...]) -> str:
    names = ", ".join(q(m) for m in markers)
    return f"(gap >= {hard} OR (gap >= {gap} AND marker IN ({names})) OR (flag AND gap >= {min(gap, 0.6)}))"


MARKERS = ("keyin", "shunda", "lekin", "ammo", "biroq", "xullas", "mana", "hozir", "umuman", "demak")
TIMED = by_time(0.9, 1.8, MARKERS)

REMAP = """
talk AS (
  SELECT transcript_id, speaker, sum(CAST(greatest("end" - "start", 0) AS DECIMAL(18,6))) AS seconds,
         count(*) AS n_spoken, min(idx) AS first_idx
  FROM words WHERE type = 'word' AND speaker <> '' GROUP BY ALL),
remap AS (
  SELECT transcript_id, speaker, 'speaker_' || (row_number() OVER (
    PARTITION BY transcript_id ORDER BY seconds DESC, n_spoken DESC, first_idx) - 1) AS label FROM talk)"""

RUN_BREAK = {
    "standard": "gap > 0.9 OR (coalesce(pause_before, false) AND nth > 2 AND gap >= 0.6)",
    "basic": "gap > 0.9 OR (coalesce(pause_before, false) AND gap >= 0.6)",
    "social": "gap > 0.75 OR (coalesce(flag_before, false) AND gap >= 0.6) OR hard_before",
}


def runs_cte(profile: str, source: str = "paused") -> str:
    hard = STOP.format("text")
    return f"""
r_tok AS (
  SELECT transcript_id, idx, text, "start" AS st, "end" AS en, pause_gap >= 0.6 AS pause
  FROM {source} WHERE type = 'word' AND text <> ''),
r_prev AS (
  SELECT *, st - lag(en) OVER w AS gap, lag(pause) OVER w AS pause_before, lag({hard}) OVER w AS hard_before,
         last_value(CASE WHEN NOT {hard} THEN pause END IGNORE NULLS)
           OVER (PARTITION BY transcript_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS flag_before,
         row_number() OVER w AS nth
  FROM r_tok WINDOW w AS (PARTITION BY transcript_id ORDER BY idx)),
r_brk AS (SELECT *, coalesce({RUN_BREAK[profile]}, true) AS breaks FROM r_prev),
runs AS (
  SELECT *, last_value(CASE WHEN breaks THEN idx END IGNORE NULLS)
    OVER (PARTITION BY transcript_id ORDER BY idx) AS run FROM r_brk)"""


def pack_cte(name: str, source: str, opens: str, ends: str, stripped: str = "trim({0})") -> str:
    """Greedy packing of ``source`` (transcript_id, run, idx, st, en, piece, spaced, hard,
    soft) as a recursion over the position in the run."""
    return f"""
{name}_in AS (
  SELECT *, row_number() OVER (PARTITION BY transcript_id, run ORDER BY idx) AS n FROM {source}),
{name}_fold AS (
  SELECT transcript_id, run, n, 1 AS cue, st AS since, length(piece) AS chars, 1 AS cnt, hard AS stopped,
         {ends.format(hard='hard', soft='soft', chars='length(piece)', cnt='1', secs='(en - st)', pushed='false')} AS closed,
         idx, st, en, piece, spaced
  FROM {name}_in WHERE n = 1
  UNION ALL
  SELECT transcript_id, run, n, CASE WHEN o THEN cue + 1 ELSE cue END, CASE WHEN o THEN st ELSE since END,
         CASE WHEN o THEN length(piece) ELSE c2 END, CASE WHEN o THEN 1 ELSE cnt + 1 END, hard,
         CASE WHEN o THEN {ends.format(hard='hard', soft='soft', chars='length(piece)', cnt='1', secs='(en - st)', pushed='(NOT was_closed)')}
              ELSE {ends.format(hard='hard', soft='soft', chars='c2', cnt='(cnt + 1)', secs='secs', pushed='false')} END,
         idx, st, en, piece, spaced
  FROM (
    SELECT *, was_closed OR ({opens}) AS o FROM (
      SELECT i.transcript_id, i.run, i.n, f.cue, f.since, f.chars, f.cnt, f.stopped, f.closed AS was_closed,
             f.chars + length(i.piece) + CASE WHEN i.spaced THEN 1 ELSE 0 END AS c2, i.en - f.since AS secs,
             i.idx, i.st, i.en, i.piece, i.spaced, i.hard, i.soft
      FROM {name}_fold f JOIN {name}_in i ON i.transcript_id = f.transcript_id AND i.run = f.run AND i.n = f.n + 1))),
{name} AS (
  SELECT transcript_id, min(idx) AS idx, arg_min(st, n) AS st, arg_max(en, n) AS en,
         {stripped.format("string_agg(CASE WHEN spaced THEN ' ' || piece ELSE piece END, '' ORDER BY n)")} AS text
  FROM {name}_fold GROUP BY transcript_id, run, cue)"""


PACK = {
    "standard": (
        "c2 > 84 OR secs > 5.5 OR (chars >= 28 AND stopped)",
        "false",
    ),
    "social": (
        "(c2 > 60 OR cnt + 1 > 9 OR secs > 2.600001e0) AND NOT hard",
        "({hard} OR (NOT {pushed} AND {soft} AND ({chars} >= 20 OR {cnt} >= 5 OR {secs} >= 0.9)))",
    ),
    "basic": ("c2 > 84 OR secs > 5.5", "false"),
}
MERGE = {
    "standard": ("c2 > 84 OR secs > 5.5", "1.0"),
    "social": ("c2 > 60 OR secs > 2.600001e0", "0.9"),
}


def cues_cte(profile: str, pauses: bool = False) -> str:
    spaced = "true" if profile == "basic" else SPACED.format("text")
    opens, ends = PACK[profile]
    parts = [
        PAUSES if pauses else NO_PAUSES,
        runs_cte(profile),
        f"""
items AS (
  SELECT transcript_id, run, idx, st, en, text AS piece, {spaced} AS spaced,
         {STOP.format('text')} AS hard, {SOFT.format('text')} AS soft FROM runs)""",
        pack_cte("packed", "items", opens, ends),
    ]
    last = "packed"
    if profile in MERGE:
        opens, shortest = MERGE[profile]
        parts.append(f"""
m_flag AS (
  SELECT *, en - st >= {shortest} OR row_number() OVER (PARTITION BY transcript_id ORDER BY idx) = 1 AS long
  FROM packed),
m_items AS (
  SELECT transcript_id, idx, st, en, text AS piece, {SPACED.format('text')} AS spaced, false AS hard, false AS soft,
         last_value(CASE WHEN long THEN idx END IGNORE NULLS) OVER (PARTITION BY transcript_id ORDER BY idx) AS run
  FROM m_flag)""")
        parts.append(pack_cte("merged", "m_items", opens, "false"))
        last = "merged"
    if profile == "standard":
        parts.append(f"""
b_prev AS (
  SELECT *, lag(text) OVER (PARTITION BY transcript_id ORDER BY idx) AS before FROM merged),
b_word AS (
  SELECT *, string_split(before, ' ')[-1] AS moved FROM b_prev),
b_flag AS (
  SELECT *, coalesce(len(string_split(text, ' ')) = 1 AND len(string_split(before, ' ')) >= 3
    AND length(before) - length(moved) - 1 <= 84
    AND length(moved || CASE WHEN {SPACED.format('text')} THEN ' ' ELSE '' END || text) <= 84, false) AS receives
  FROM b_word),
b_next AS (
  SELECT *, coalesce(lead(receives) OVER (PARTITION BY transcript_id ORDER BY idx), false) AS gives FROM b_flag),
balanced AS (
  SELECT transcript_id, idx, st, en,
         CASE WHEN receives THEN moved || CASE WHEN {SPACED.format('text')} THEN ' ' ELSE '' END || text
              WHEN gives THEN left(text, length(text) - length(string_split(text, ' ')[-1]) - 1)
              ELSE text END AS text
  FROM b_next)""")
        last = "balanced"
    parts.append(f"""
cues AS (
  SELECT transcript_id, row_number() OVER (PARTITION BY transcript_id ORDER BY idx) AS cue_no,
         st AS "start", en AS "end", text FROM {last} WHERE text <> '')""")
    return ",".join(parts)


def timecode(seconds: str) -> str:
    ms = f"CAST(round_even(greatest({seconds}, 0) * 1000, 0) AS BIGINT)"
    return (
        f"printf('%02d:%02d:%02d,%03d', {ms} // 3600000, ({ms} // 60000) % 60, ({ms} // 1000) % 60, {ms} % 1000)"
    )


def block(text: str) -> str:
    return (
        f"CASE WHEN cue_no > 1 THEN chr(10) ELSE '' END || cue_no || chr(10) || {timecode('\"start\"')} || ' --> ' || "
        f"{timecode('\"end\"')} || chr(10) || {text} || chr(10)"
    )


def wrap_cte(source: str, keys: str, name: str = "wrapped") -> str:
    """Two lines of 42 characters for each ``text`` of ``source``, word by word."""
    on = " AND ".join(f"i.{k.strip()} = f.{k.strip()}" for k in keys.split(","))
    named = ", ".join(f"i.{k.strip()}" for k in keys.split(","))
    return f"""
{name}_w AS (
  SELECT {keys}, list_filter(string_split(text, ' '), lambda w: w <> '') AS w FROM {source}),
{name}_i AS (
  SELECT {keys}, unnest(w) AS word, generate_subscripts(w, 1) AS n, len(w) AS total FROM {name}_w),
{name}_f AS (
  SELECT {keys}, n, total, word AS l1, '' AS l2, 1 AS line FROM {name}_i WHERE n = 1
  UNION ALL
  SELECT {named}, i.n, i.total,
         CASE WHEN line = 1 AND length(l1) + 1 + length(word) <= 42 THEN l1 || ' ' || word ELSE l1 END,
         CASE WHEN line = 1 AND length(l1) + 1 + length(word) <= 42 THEN l2
              WHEN line <= 2 AND l2 = '' THEN word
              WHEN line <= 2 AND length(l2) + 1 + length(word) <= 42 THEN l2 || ' ' || word ELSE l2 END,
         CASE WHEN line = 1 AND length(l1) + 1 + length(word) <= 42 THEN 1
              WHEN line <= 2 AND (l2 = '' OR length(l2) + 1 + length(word) <= 42) THEN 2 ELSE 3 END
  FROM {name}_f f JOIN {name}_i i ON {on} AND i.n = f.n + 1),
{name}_l AS (
  SELECT {keys}, CASE WHEN l2 = '' THEN l1 ELSE l1 || ' ' || l2 END AS one,
         CASE WHEN l2 = '' THEN l1 ELSE l1 || chr(10) || l2 END AS two
  FROM {name}_f WHERE n = total),
{name} AS (
  SELECT {keys}, CASE WHEN length(one) > 84
    THEN rtrim(left(rtrim(left(one, 83)) || '…', 42)) || chr(10) || ltrim(substr(rtrim(left(one, 83)) || '…', 43))
    ELSE two END AS lines FROM {name}_l)"""


def replace_all(text: str, *rules: tuple[str, str]) -> str:
    for pattern, replacement in rules:
        text = f"regexp_replace({text}, {q(pattern)}, {q(replacement)}, 'g')"
    return text


PAIRS = (
    ("[\u02bb\u02bc\u2018\u2019\u00b4`']", "'"),
    ("O'", "Ў"), ("o'", "ў"), ("G'", "Ғ"), ("g'", "ғ"), ("S[hH]", "Ш"), ("s[hH]", "ш"), ("C[hH]", "Ч"), ("c[hH]", "ч"),
    ("NG", "НГ"), ("Ng", "Нг"), ("n[gG]", "нг"), ("Y[oO]", "Ё"), ("y[oO]", "ё"), ("Y[uU]", "Ю"), ("y[uU]", "ю"),
    ("Y[aA]", "Я"), ("y[aA]", "я"), ("Y[eE]", "Е"), ("y[eE]", "е"),
    (r"(^|[^\p{L}])e", r"\1э"), (r"(^|[^\p{L}])E", r"\1Э"),
)
SMALL_LATIN, SMALL_CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абцдефгҳижклмнопқрстуввхйз"


def cyrillic(text: str) -> str:
    source = SMALL_LATIN + SMALL_LATIN.upper() + "'"
    target = SMALL_CYRILLIC + SMALL_CYRILLIC.upper() + "ъ"
    return f"translate({replace_all(text, *PAIRS)}, {q(source)}, {q(target)})"


def latin(text: str) -> str:
    vowels = "[АаЕеЁёИиОоУуЎўЭэЮюЯяЪъЬь]"
    other = "(^|[^\u0400-\u04ff])"
    out = text
    for letter, form in (("Е", "Ye"), ("е", "ye")):
        rules = [(f"({vowels}){letter}", rf"\1{form}"), (f"{other}{letter}", rf"\1{form}")]
        out = replace_all(out, *(rules * 3))
    for letter, form in zip("ҒғЁёЧчШшЩщЮюЯяЎў", "G‘ g‘ Yo yo Ch ch Sh sh Sh sh Yu yu Ya ya O‘ o‘".split()):
        out = f"replace({out}, {q(letter)}, {q(form)})"
    source = "АБВГДЕЖЗИЫЙКҚЛМНОПРСТУФХҲЦЭЪЬабвгдежзиыйкқлмнопрстуфхҳцэъь"
    target = "ABVGDEJZIIYKQLMNOPRSTUFXHSE''abvgdejziiykqlmnoprstufxhse''"
    return f"translate({out}, {q(source)}, {q(target)})"


MARKS = ",.;:!?…"
TIDY = (
    ("[ \\t\u00a0]+", " "),
    (rf"[\s\u00a0]+([{MARKS}])".replace("\\u00a0", "\u00a0"), r"\1"),
    (rf"([{MARKS}])([^\s{MARKS}])", r"\1 \2"),
    (r"\s*\n\s*", "\n"),
    (" {2,}", " "),
    (r"^\s+|\s+$", ""),
)
# U+2019 itself is left out, so that a second pass finds what the first stepped over.
APOSTROPHE = ("([A-Za-z])[\u02bb\u02bc\u2018\u00b4`']([A-Za-z])", r"\1’\2")
NW = r"[^\p{L}\p{N}_]"
TAIL = "([a-z‘’]*)"
APOS = "[\u02bb\u02bc\u2018\u2019\u00b4`']"


def word_rules(*rules: tuple[str, str]) -> list[tuple[str, str]]:
    """Whole-word, case-blind rules; twice each, since neighbours share a separator."""
    out = []
    for pattern, replacement in rules:
        groups = pattern.count("(")
        rule = (f"(?i)(^|{NW}){pattern}($|{NW})", rf"\1{replacement}\{2 + groups}")
        out += [rule, rule]
    return out


# Word rules.
CLEAN_WORDS = word_rules(
    ("manga", "menga"), ("man", "men"), ("misofir", "musofir"), ("bir birimiz", "bir-birimiz"),
    ("bir biriga", "bir-biriga"), ("bir birini", "bir-birini"), ("bir bir", "bir-bir"),
    ("ota onam" + TAIL, r"ota-onam\2"), (r"iso\s+masih", "Iso Masih"), ("injil", "Injil"), ("tavrot", "Tavrot"),
    ("zabur", "Zabur"), ("iso", "Iso"), ("masih", "Masih"), ("rossiya" + TAIL, r"Rossiya\2"),
    ("novosibirsk" + TAIL, r"Novosibirsk\2"), (f"farg{APOS}ona{TAIL}", r"Farg‘ona\2"),
    (f"o{APOS}zbekiston{TAIL}", r"O‘zbekiston\2"), (f"qur{APOS}on", "Qur’on"), ("xudo" + TAIL, r"Xudo\2"),
)
# Fixed values.
SENTENCE_MARKERS = "Keyin|Shunda|Lekin|Ammo|Biroq|Hozir|Umuman|Xullas|Mana|Demak"
BREAKS = ((rf"([^.!?…\s])\s+({SENTENCE_MARKERS})($|{NW})", r"\1. \2\3"),) * 2 + ((r"\.\s*\.", "."),)


def token(text: str) -> str:
    return replace_all(text, APOSTROPHE, APOSTROPHE, *CLEAN_WORDS)


def clean(text: str, breaks: bool = False) -> str:
    out = token(replace_all(text, *TIDY))
    return capitals(replace_all(out, *(BREAKS if breaks else ()), *TIDY))


def capitals(out: str) -> str:
    letters = "[a-zа-яё]"
    marked = f"regexp_replace({out}, '(\\n|[.!?…]\\s+)({letters})', '\\1' || chr(1) || '\\2', 'g')"
    return (
        f"array_to_string(list_transform(string_split({marked}, chr(1)), lambda p: "
        f"CASE WHEN regexp_matches(p, '^{letters}') THEN upper(left(p, 1)) || substr(p, 2) ELSE p END), '')"
    )


CLEAN_STEPS = (
    ("spacing", replace_all("text", *TIDY)),
    ("apostrophes", replace_all("text", APOSTROPHE, APOSTROPHE)),
    ("common_words", replace_all("text", *CLEAN_WORDS[:16])),
    ("names", replace_all("text", *CLEAN_WORDS[16:])),
    ("breaks", replace_all("text", *BREAKS)),
    ("spacing_again", replace_all("text", *TIDY)),
    ("capitals", capitals("text")),
)

SEEDED = f"seeded AS (SELECT doc_id, text || {pick(PHRASES, 'doc_id')} AS text FROM documents)"

TRANSCRIPTS = """
docs AS (
  SELECT doc_id, 'doc-' || doc_id AS transcript_id, source || ' ' || printf('%09d', doc_id) AS stem, text,
         list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda t: t <> '') AS toks,
         list_filter(string_split(text, chr(10)), lambda l: trim(l, ' ') <> '') AS lines
  FROM documents),
doc_words AS (
  SELECT transcript_id, len(toks) AS n_words, unnest(toks) AS text, generate_subscripts(toks, 1) - 1 AS idx
  FROM docs WHERE doc_id % 3 <> 0),
doc_ms AS (SELECT *, idx * 420 + (idx // 9) * 950 AS ms FROM doc_words),
t_words AS (
  SELECT transcript_id, CAST(n_words AS BIGINT) AS n_words, CAST(idx AS BIGINT) AS idx,
         CASE WHEN regexp_matches(text, '^[.,;:!?]+$') THEN 'punctuation' ELSE 'word' END AS type, text,
         CAST(ms AS DOUBLE) / 1000.0e0 AS "start",
         CAST(ms + 60 + 30 * length(text) AS DOUBLE) / 1000.0e0 AS "end",
         's' || ((idx // 14) % 3) AS speaker
  FROM doc_ms),
doc_segments AS (
  SELECT transcript_id, len(lines) AS n_words, unnest(lines) AS text, generate_subscripts(lines, 1) - 1 AS idx
  FROM docs WHERE doc_id % 3 = 0),
t_segments AS (
  SELECT transcript_id, CAST(n_words AS BIGINT) AS n_words, CAST(idx AS BIGINT) AS idx, 'word' AS type, text,
         CAST(idx * 4000 AS DOUBLE) / 1000.0e0 AS "start", CAST(idx * 4000 + 3500 AS DOUBLE) / 1000.0e0 AS "end",
         CAST(NULL AS VARCHAR) AS speaker
  FROM doc_segments)"""

# Segments joined to one text, then split after sentence marks.
SEGMENT_SENTENCES = """
seg_text AS (
  SELECT transcript_id, regexp_replace(trim(regexp_replace(string_agg(trim(text), ' ' ORDER BY idx), '\\s+', ' ', 'g')),
           ' +([,.;:!?…])', '\\1', 'g') AS text
  FROM t_segments GROUP BY transcript_id),
seg_parts AS (
  SELECT transcript_id, list_filter(string_split(regexp_replace(text, '([.!?…])\\s+', '\\1' || chr(1), 'g'), chr(1)),
                                    lambda s: s <> '') AS parts FROM seg_text),
segment_sentences AS (
  SELECT transcript_id, generate_subscripts(parts, 1) AS sent_no, unnest(parts) AS text FROM seg_parts)"""

ITEMS = """
raw_items AS (
  SELECT transcript_id, stem, list_filter([
      {'rf': 'SRT', 'fe': '.srt', 'c': CASE WHEN doc_id % 4 = 0 THEN text END},
      {'rf': 'txt', 'fe': NULL, 'c': CASE WHEN doc_id % 5 <> 0 THEN text END},
      {'rf': 'segmented_json', 'fe': 'json', 'c': text},
      {'rf': 'docx', 'fe': 'docx', 'c': text},
      {'rf': 'html', 'fe': 'json', 'c': CASE WHEN doc_id % 2 = 0 THEN text END},
      {'rf': NULL, 'fe': 'TXT', 'c': CASE WHEN doc_id % 7 = 0 THEN text END},
      {'rf': NULL, 'fe': NULL, 'c': text}], lambda i: i.c IS NOT NULL) AS items
  FROM docs),
item_rows AS (
  SELECT transcript_id, stem, generate_subscripts(items, 1) - 1 AS pos, unnest(items) AS item FROM raw_items),
named_items AS (
  SELECT transcript_id, stem, pos, item.c AS content, coalesce(lower(item.rf), '') AS requested_format,
         coalesce(nullif(ltrim(lower(coalesce(item.fe, '')), '.'), ''), lower(item.rf)) AS extension
  FROM item_rows),
items AS (
  SELECT *, CASE WHEN requested_format = 'srt' OR extension = 'srt' THEN 'srt/' || stem || '.srt'
                 WHEN requested_format = 'txt' OR extension = 'txt' THEN 'txt/' || stem || '.txt'
                 WHEN requested_format = 'segmented_json' THEN 'json/' || stem || '.segmented.json'
                 WHEN extension = 'json' AND requested_format NOT IN ('', 'json')
                   THEN 'json/' || stem || '.' || requested_format || '.json'
                 ELSE 'json/' || stem || '.' || extension END AS out_path
  FROM named_items WHERE extension <> ''),
supplied AS (
  SELECT transcript_id, format, arg_max(out_path, pos) AS out_path FROM (
    SELECT transcript_id, pos, out_path, extension AS format FROM items
    UNION SELECT transcript_id, pos, out_path, requested_format FROM items WHERE requested_format <> '')
  GROUP BY ALL)"""

LISTING = f"""
listing AS (
  SELECT page_id, regexp_replace(url, '[^A-Za-z0-9/.]+', '_', 'g') || {pick(MEDIA_ENDINGS, 'page_id')} AS path FROM pages),
named AS (SELECT *, string_split(path, '/')[-1] AS file_name FROM listing),
suffixed AS (SELECT *, regexp_extract(file_name, '^.+(\\.[^.]+)$', 1) AS suffix FROM named)"""


def with_(*ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(c.strip() for c in ctes)}\n{select}"


LINE_SPLIT = "'\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]'"


def lines_cte(source: str, keys: str, text: str) -> str:
    return f"""
line_lists AS (SELECT {keys}, string_split_regex({text}, {LINE_SPLIT}) AS ls FROM {source}),
line_cut AS (SELECT {keys}, CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END AS ls FROM line_lists),
lines AS (SELECT {keys}, CAST(generate_subscripts(ls, 1) AS BIGINT) AS line_no, unnest(ls) AS line FROM line_cut)"""


def body_cyrillic(line: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({line}, '<[^>]+>|[^<]+|<'), lambda p: "
        f"CASE WHEN regexp_matches(p, '^<[^>]+>') THEN p ELSE {cyrillic('p')} END), '')"
    )


def meta(line: str) -> str:
    clock = r"\d{2}:\d{2}:\d{2},\d{3}"
    return (
        f"(trim({line}) = '' OR regexp_full_match(trim({line}), '[0-9]+') "
        f"OR regexp_full_match(trim({line}), '{clock}\\s+-->\\s+{clock}'))"
    )


FILES = f"""
parts AS (
  SELECT transcript_id, (cue_no - 1) // 1000 AS part_no, string_agg(b, '' ORDER BY cue_no) AS srt_text
  FROM (SELECT c.transcript_id, c.cue_no, {block('lines')} AS b FROM cues c JOIN wrapped USING (transcript_id, cue_no))
  GROUP BY ALL)"""
CUE_COLUMNS = 'SELECT transcript_id, cue_no, "start", "end", text FROM cues'


def statements() -> dict[str, str]:
    found: dict[str, str] = {}
    found["words"] = with_(WORDS, select="""
SELECT transcript_id, n_words, idx, text, "start", "end", speaker, length(text) AS n_characters FROM words""")
    found["transcript_words"] = with_(
        TRANSCRIPTS, select="SELECT * FROM t_words UNION ALL SELECT * FROM t_segments")
    found["speaker_stats"] = with_(WORDS, REMAP, select="""
SELECT transcript_id, speaker, CAST(seconds AS DOUBLE) AS seconds, n_spoken, first_idx FROM talk""")
    found["speaker_remap"] = with_(WORDS, REMAP, select="SELECT * FROM remap")
    plain = sentences_cte("paused")
    found["sentences_punct"] = with_(WORDS, NO_PAUSES, plain, select="SELECT * FROM sentences")
    found["remapped_sentences"] = with_(WORDS, REMAP, NO_PAUSES, plain, select="""
SELECT transcript_id, sent_no, text, coalesce(label, speaker) AS speaker
FROM sentences LEFT JOIN remap USING (transcript_id, speaker)""")
    punctuated = ", ".join(["paused AS (SELECT *, 0.0e0 AS pause_gap FROM words_p)"])
    found["sentences_punctuated"] = with_(WORDS, PUNCTUATED, punctuated, plain, select="SELECT * FROM sentences")
    found["sentences_timing"] = with_(
        WORDS, NO_PAUSES, sentences_cte("paused", TIMED), select="SELECT * FROM sentences")
    found["sentences_markers"] = with_(
        WORDS, PUNCTUATED, punctuated, sentences_cte("paused", by_time(0.7, 1.5, OWN_MARKERS)),
        select="SELECT * FROM sentences")
    found["sentences_pauses"] = with_(
        WORDS, PAUSES, sentences_cte("paused", TIMED), select="SELECT * FROM sentences")
    found["sentence_parts"] = with_(WORDS, NO_PAUSES, plain, f"""
pieces AS (
  SELECT transcript_id, sent_no, idx, CASE WHEN {SPACED.format('text')} THEN ' ' || text ELSE text END AS piece FROM s_no),
dealt AS (
  SELECT *, (sum(length(piece)) OVER (PARTITION BY transcript_id, sent_no ORDER BY idx) - length(piece)) // 40 AS part_no
  FROM pieces),
parts AS (
  SELECT transcript_id, sent_no, part_no, string_agg(piece, '' ORDER BY idx) AS text FROM dealt GROUP BY ALL)""", select="""
SELECT transcript_id, CAST(p.sent_no AS BIGINT) AS sent_no, CAST(part_no AS BIGINT) AS part_no,
       CASE WHEN part_no = 0 THEN ltrim(p.text) ELSE p.text END AS text, speaker
FROM parts p JOIN sentences s USING (transcript_id, sent_no)""")
    found["text_sentences"] = """
WITH tidy AS (
  SELECT doc_id, regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' +([,.;:!?…])', '\\1', 'g') AS text FROM documents),
parts AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?…])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS p FROM tidy)
SELECT doc_id, generate_subscripts(p, 1) AS sent_no, unnest(p) AS text FROM parts"""
    found["segment_sentences"] = with_(
        TRANSCRIPTS, SEGMENT_SENTENCES, select="SELECT * FROM segment_sentences")
    best = """
main AS (
  SELECT transcript_id, speaker AS main_speaker FROM (
    SELECT transcript_id, speaker, count(*) AS n, min(sent_no) AS f FROM sentences WHERE speaker <> '' GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY transcript_id ORDER BY n DESC, f) = 1)"""
    found["main_speaker"] = with_(WORDS, NO_PAUSES, plain, best, select="SELECT * FROM main")
    found["tagged_lines"] = with_(WORDS, NO_PAUSES, plain, best, select="""
SELECT transcript_id, sent_no, CASE WHEN speaker <> main_speaker THEN '[' || speaker || '] ' || text ELSE text END AS line
FROM sentences LEFT JOIN main USING (transcript_id)""")
    found["all_tagged_lines"] = with_(WORDS, NO_PAUSES, plain, select="""
SELECT transcript_id, sent_no, CASE WHEN speaker <> '' THEN '[' || speaker || '] ' || text ELSE text END AS line FROM sentences""")
    found["pause_detection"] = with_(
        WORDS, PAUSES, select='SELECT transcript_id, idx, "end" AS speech_end, pause_gap FROM paused')

    found["streamed_runs"] = with_(DOCUMENT_WORDS, NO_PAUSES, runs_cte("basic"), select="""
SELECT transcript_id, min(idx) AS run, min(st) AS "start", max(en) AS "end", count(*) AS n_words
FROM runs GROUP BY transcript_id, run""")
    found["cue_tokens"] = with_(WORDS, PUNCTUATED, select="""
SELECT transcript_id, idx, text, "start", "end", speaker FROM words_p WHERE type = 'word' AND text <> ''""")
    short = cues_cte("basic").replace("84", "60").replace("5.5", "3.0")
    found["cues_basic_short"] = with_(WORDS, short, select=CUE_COLUMNS, recursive=True)
    wide = cues_cte("social").replace("0.75", "1.25")
    found["cues_social_wide"] = with_(WORDS, wide, select=CUE_COLUMNS, recursive=True)
    for profile in ("standard", "social", "basic"):
        found[f"cue_runs_{profile}"] = with_(
            WORDS, PAUSES, runs_cte(profile), select="SELECT transcript_id, idx, breaks, run FROM runs")
        found[f"cues_{profile}"] = with_(WORDS, cues_cte(profile), select=CUE_COLUMNS, recursive=True)
        found[f"cues_{profile}_pauses"] = with_(
            WORDS, cues_cte(profile, True), select=CUE_COLUMNS, recursive=True)
    found["document_cues"] = with_(DOCUMENT_WORDS, cues_cte("standard"), select=CUE_COLUMNS, recursive=True)
    found["wrap_lines"] = with_(
        WORDS, NO_PAUSES, plain, wrap_cte("sentences", "transcript_id, sent_no"),
        select="SELECT * FROM wrapped", recursive=True)

    found["timecodes"] = f"""
SELECT l_orderkey, l_linenumber, {timecode('(CAST(l_extendedprice AS DOUBLE) / 7.0e0)')} AS timecode FROM lineitem"""
    standard, wrapped = cues_cte("standard"), wrap_cte("cues", "transcript_id, cue_no")
    found["srt_text"] = with_(WORDS, standard, wrapped, FILES, select="""
SELECT transcript_id, coalesce(part_no, 0) AS part_no, coalesce(srt_text, '') AS srt_text
FROM (SELECT DISTINCT transcript_id FROM words) LEFT JOIN parts USING (transcript_id)""", recursive=True)
    in_cyrillic = f"changed AS (SELECT transcript_id, cue_no, {cyrillic('text')} AS text FROM cues)"
    found["srt_cyrillic"] = with_(
        WORDS, standard, in_cyrillic, wrap_cte("changed", "transcript_id, cue_no"),
        select=f"SELECT c.transcript_id, c.cue_no, {block('lines')} AS block FROM cues c JOIN wrapped USING (transcript_id, cue_no)",
        recursive=True)
    found["srt_numbered"] = with_(
        WORDS, standard, select=f"SELECT transcript_id, cue_no, {block('CAST(cue_no AS VARCHAR)')} AS block FROM cues",
        recursive=True)
    found["srt_basic"] = with_(WORDS, cues_cte("basic"), select=f"""
SELECT transcript_id, (cue_no - 1) // 1000 AS part_no, string_agg({block('text')}, '' ORDER BY cue_no) AS srt_text
FROM cues GROUP BY ALL""", recursive=True)
    found["srt_social_variants"] = with_(WORDS, cues_cte("social"), select=f"""
SELECT 'raw' AS variant, transcript_id, cue_no, {block('text')} AS block FROM cues
UNION ALL SELECT 'cyrillic', transcript_id, cue_no, {block(cyrillic('text'))} FROM cues
UNION ALL SELECT 'latin', transcript_id, cue_no, {block(latin('text'))} FROM cues""", recursive=True)
    found["srt_social_own"] = with_(WORDS, cues_cte("social"), select=f"""
SELECT 'raw' AS variant, transcript_id, cue_no, {block("('- ' || text)")} AS block FROM cues
UNION ALL SELECT 'cyrillic', transcript_id, cue_no, {block(cyrillic("('- ' || text)"))} FROM cues""", recursive=True)
    steps = [f"c{i} AS (SELECT doc_id, {rule} AS text FROM {f'c{i - 1}' if i > 1 else 'seeded'})" for i, (_, rule) in enumerate(CLEAN_STEPS, 1)]
    found["clean_summary"] = with_(SEEDED, *steps, select="\nUNION ALL ".join(
        f"""SELECT CAST({i} AS INTEGER) AS step, '{name}' AS rule, count(*) FILTER (WHERE a.text <> b.text) AS n_changed, count(*) AS n_rows
FROM {f'c{i - 1}' if i > 1 else 'seeded'} a JOIN c{i} b USING (doc_id)""" for i, (name, _) in enumerate(CLEAN_STEPS, 1)))
    found["subtitle_lines"] = with_(
        WORDS, standard, wrapped, FILES, lines_cte("parts", "transcript_id, part_no", "srt_text"),
        select="SELECT * FROM lines", recursive=True)
    found["srt_to_cyrillic"] = with_(lines_cte("pages", "page_id", "html"), select=f"""
SELECT page_id, line_no, CASE WHEN {meta('line')} THEN line ELSE {body_cyrillic('line')} END AS line FROM lines""")
    found["streamed_cyrillic"] = found["srt_to_cyrillic"]
    found["srt_files_to_cyrillic"] = with_(
        WORDS, standard, wrapped, FILES, lines_cte("parts", "transcript_id, part_no", "srt_text"),
        select=f"""
SELECT transcript_id, part_no, string_agg(CASE WHEN {meta('line')} THEN line ELSE {body_cyrillic('line')} END, chr(10) ORDER BY line_no) || chr(10) AS srt_text
FROM lines GROUP BY ALL""", recursive=True)

    found["tidy_spaces"] = """
SELECT doc_id, regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' +([,.;:!?…])', '\\1', 'g') AS text FROM documents"""
    found["to_cyrillic"] = with_(SEEDED, select=f"SELECT doc_id, {cyrillic('text')} AS text FROM seeded")
    found["to_latin"] = with_(
        SEEDED, f"cyr AS (SELECT doc_id, {cyrillic('text')} AS text FROM seeded)",
        select=f"SELECT doc_id, {latin('text')} AS text FROM cyr")
    found["script_by_row"] = with_(SEEDED, select=f"""
SELECT doc_id, {pick(('latin', 'cyrillic', 'source'), 'doc_id')} AS mode,
       CASE doc_id % 3 WHEN 0 THEN {latin('text')} WHEN 1 THEN {cyrillic('text')} ELSE text END AS text FROM seeded""")
    found["clean_text"] = with_(SEEDED, select=f"SELECT doc_id, {clean('text')} AS text FROM seeded")
    found["clean_text_breaks"] = with_(SEEDED, select=f"SELECT doc_id, {clean('text', True)} AS text FROM seeded")
    found["output_names"] = """
SELECT 'doc-' || doc_id AS transcript_id, output, source || ' ' || printf('%09d', doc_id) || ending AS out_name
FROM documents, (VALUES ('standard', '.srt'), ('numbered', '.sentence.srt'), ('social_cyrillic', '_social_cyrillic.srt'),
  ('social_latin', '_social_latin.srt'), ('social_raw', '_social_raw.srt'), ('sentences', '.txt'),
  ('clean_json', '_uz_clean.json')) AS e(output, ending)"""
    found["untimed_words"] = with_(TRANSCRIPTS, select="""
SELECT transcript_id, idx, text, 'unreadable start' AS reason FROM t_words WHERE type = 'word' AND idx % 97 = 5""")
    found["quarantine"] = """
SELECT '/c/' || doc_id || '.json' AS transcript_id, CAST(doc_id AS VARCHAR) AS stem, 'malformed JSON' AS reason,
       CAST(length(CAST(to_json({'text': text, 'lang': lang}) AS VARCHAR)) - 1 AS INTEGER) AS n_chars
FROM documents WHERE doc_id % 50 = 0"""
    found["clean_json"] = with_(SEEDED, select=f"""
SELECT doc_id, {clean('text', True)} AS text, lang, n_chars, 'men' AS word, CAST(0.5 AS DOUBLE) AS start, CAST(-0.25 AS DOUBLE) AS logprob
FROM seeded JOIN (SELECT doc_id, lang, n_chars FROM documents) USING (doc_id)""")
    found["clean_tokens"] = with_(
        SEEDED, words_cte("seeded", "doc_id", "0", "'s'"),
        select=f"SELECT transcript_id, idx, {token('text')} AS text FROM words")
    found["clean_payload"] = with_(TRANSCRIPTS, select=f"""
SELECT * REPLACE ({token('text')} AS text) FROM t_words
UNION ALL SELECT * REPLACE ({clean('text')} AS text) FROM t_segments""")
    name = f"'page ' || page_id || {pick(NAME_ENDINGS, 'page_id')}"
    found["cyrillic_names"] = f"""
SELECT page_id, CASE WHEN n LIKE '%\\_latin.srt' ESCAPE '\\' THEN left(n, length(n) - 10)
                     WHEN n LIKE '%.srt' THEN left(n, length(n) - 4) ELSE n END || '_cyrillic.srt' AS name
FROM (SELECT page_id, {name} AS n FROM pages)"""

    found["attachments"] = with_(TRANSCRIPTS, ITEMS, select="""
SELECT transcript_id, pos, requested_format, extension, out_path, md5(content) AS content_md5
FROM items QUALIFY row_number() OVER (PARTITION BY out_path ORDER BY transcript_id DESC, pos DESC) = 1""")
    found["supplied_formats"] = with_(TRANSCRIPTS, ITEMS, select="SELECT * FROM supplied")
    found["pending_work"] = with_(TRANSCRIPTS, ITEMS, select="""
SELECT transcript_id, stem FROM docs
WHERE 'srt/' || stem || '.srt' NOT IN (SELECT out_path FROM items)
   OR 'txt/' || stem || '.txt' NOT IN (SELECT out_path FROM items)""")
    media = "('.wav', '.mp3', '.flac', '.m4a', '.aac', '.ogg', '.opus', '.mp4', '.wma', '.webm')"
    kinds = {
        ".wav": "audio/wav", ".mp3": "audio/mpeg", ".flac": "audio/flac", ".m4a": "audio/mp4", ".aac": "audio/aac",
        ".ogg": "audio/ogg", ".opus": "audio/opus", ".mp4": "audio/mp4", ".wma": "audio/x-ms-wma", ".webm": "audio/webm",
    }
    mimes = " ".join(
        f"WHEN {q(ending)} THEN {q(mimetypes.guess_type('x' + ending)[0] or kind)}"
        for ending, kind in kinds.items()
    )
    found["media_catalog"] = with_(LISTING, select=f"""
SELECT page_id, path, file_name, left(file_name, length(file_name) - length(suffix)) AS stem,
       CASE lower(suffix) {mimes} END AS mime_type
FROM suffixed WHERE lower(suffix) IN {media}""")
    found["path_regex"] = with_(LISTING, select="""
SELECT page_id, path, file_name FROM suffixed
WHERE lower(suffix) = '.json' AND regexp_matches(file_name, '^[0-9]*[13579][^0-9].*[.][jJ]son$')""")
    found["combined_name"] = with_(TRANSCRIPTS, select="""
SELECT count(*) AS n_files, CASE WHEN max(b) <> '' THEN max(b) || '_comb.txt' ELSE 'combined.txt' END AS out_name
FROM docs, (SELECT trim(left(lo, n), ' ._-') AS b FROM (
  SELECT lo, max(n) AS n FROM (SELECT min(stem) AS lo, max(stem) AS hi FROM docs),
    (SELECT unnest(range(0, 200)) AS n) WHERE n <= length(lo) AND left(lo, n) = left(hi, n) GROUP BY lo))""")
    flow = [
        TRANSCRIPTS,
        SEGMENT_SENTENCES,
        "words AS (SELECT * FROM t_words)",
        "paused AS (SELECT *, 0.0e0 AS pause_gap FROM words)",
        plain,
        """
all_sentences AS (
  SELECT transcript_id, sent_no, text FROM sentences
  UNION ALL SELECT transcript_id, sent_no, text FROM segment_sentences)""",
    ]
    found["transcript_lines"] = with_(*flow, REMAP, """
shown AS (
  SELECT transcript_id, sent_no, text, coalesce(label, speaker) AS speaker
  FROM sentences LEFT JOIN remap USING (transcript_id, speaker)
  UNION ALL SELECT transcript_id, sent_no, text, NULL FROM segment_sentences)""", best.replace("FROM sentences", "FROM shown"), select="""
SELECT transcript_id, sent_no, CASE WHEN speaker <> main_speaker THEN '[' || speaker || '] ' || text ELSE text END AS line
FROM shown LEFT JOIN main USING (transcript_id)""")
    found["combined_text"] = with_(*flow, select="SELECT transcript_id, sent_no, text AS line FROM all_sentences")
    found["sentence_files"] = with_(*flow, select="""
SELECT transcript_id, (sent_no - 1) // 5000 AS part_no, string_agg(text, chr(10) ORDER BY sent_no) || chr(10) AS txt
FROM all_sentences GROUP BY ALL""")
    found["combined_manifest"] = with_(*flow, """
files AS (
  SELECT transcript_id, (sent_no - 1) // 5000 AS part_no, string_agg(text, chr(10) ORDER BY sent_no) || chr(10) AS txt
  FROM all_sentences GROUP BY ALL)""", select="""
SELECT transcript_id, part_no, CAST(coalesce(sum(octet_length(encode(txt))) OVER (
         ORDER BY transcript_id, part_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset,
       octet_length(encode(txt)) AS n_bytes, md5(txt) AS md5 FROM files""")
    counted = "SELECT '{0}' AS output, count(*) AS n_rows, count(DISTINCT transcript_id) AS n_transcripts FROM ({1})"
    found["output_totals"] = "\nUNION ALL ".join(
        counted.format(name, statement)
        for name, statement in (
            ("cues", found["cues_standard"]),
            ("social_cues", found["cues_social"]),
            ("sentences", found["sentences_punct"]),
        )
    )
    t_words = "words AS (SELECT * FROM t_words)"
    found["transcript_subtitles"] = with_(TRANSCRIPTS, t_words, standard, wrapped, FILES, select="""
SELECT transcript_id, coalesce(part_no, 0) AS part_no, coalesce(srt_text, '') AS srt_text
FROM docs LEFT JOIN parts USING (transcript_id)""", recursive=True)
    cleaned = f"changed AS (SELECT transcript_id, cue_no, {cyrillic(clean('text'))} AS text FROM cues)"
    found["transcript_subtitles_clean"] = with_(
        TRANSCRIPTS, f"words AS (SELECT * REPLACE ({token('text')} AS text) FROM t_words)", standard, cleaned,
        wrap_cte("changed", "transcript_id, cue_no"), FILES, select="""
SELECT transcript_id, coalesce(part_no, 0) AS part_no, coalesce(srt_text, '') AS srt_text
FROM docs LEFT JOIN parts USING (transcript_id)""", recursive=True)
    found["basic_subtitles"] = with_(
        TRANSCRIPTS, ITEMS.replace("items AS (\n  SELECT *, CASE", "files AS (\n  SELECT *, CASE").replace("FROM items", "FROM files"),
        "words AS (SELECT * FROM t_words UNION ALL SELECT * FROM t_segments)",
        cues_cte("basic"), f"""
texts AS (SELECT transcript_id, (cue_no - 1) // 1000 AS part_no, string_agg({block('text')}, '' ORDER BY cue_no) AS srt_text
          FROM cues GROUP BY ALL)""",
        select="""
SELECT transcript_id, coalesce(part_no, 0) AS part_no, coalesce(srt_text, '') AS srt_text
FROM docs LEFT JOIN texts USING (transcript_id)
WHERE transcript_id NOT IN (SELECT transcript_id FROM supplied WHERE format = 'srt')""", recursive=True)
    return found
