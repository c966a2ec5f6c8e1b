"""PII: format-preserving Feistel pseudonyms.

Values are found by pattern and validated (Luhn for cards, mod 97 for IBANs, octets for
addresses, the calendar for dates, area and line for phones); each is replaced by another
valid value of the same printed form.  The replacement is a keyed permutation of the
format's domain (balanced Feistel rounds over its size, walked until inside), so equal values stay
linked across documents, different ones stay apart, and the key holder can undo it.

* card: all digits but the check digit are permuted, then the check digit is set anew;
* IBAN: country stays, the rest is permuted within its letters and digits, then checked;
* date (yyyy-mm-dd, dd.mm.yyyy, dd/mm/yyyy): a day of 1900-2099 becomes another one;
* phone, IPv4 address: digits or octets; e-mail: letters and digits of the mailbox part
  and host, dots and signs stay, the last label stays;
* secret (long token or key assignment, hex digits): hex digits.

The printed form alone decides the domain, so separators do not matter: "4929-3483 ..."
and "49293483..." map to the same digits.

Defined cases: null text stays null; texts without values are unchanged; a number that fails
its check is left alone; overlapping finds go to the
first pattern in order; repeated rows are treated alike; more columns are kept.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from datetime import date, timedelta
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueweave.llm.common import slices

KINDS = ("email", "secret", "iban", "card", "ip", "date", "phone")
#: What each kind looks like, in the order of precedence.
FORMS = {
    "email": r"(?P<email>[A-Za-z0-9À-ÖØ-öø-ÿ._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24})",
    "assigned": r"(?<![A-Za-z])(?i:(?:api|access|auth|client|private|secret|signing)[_-]?)?(?i:key|secret|token|password|passwd|pwd)"
    r"[\"']?[ \t]{0,4}[:=][ \t]{0,4}[\"']?(?P<assigned>(?=[A-Za-z_./+=~-]{0,127}[0-9])[0-9A-Za-z_./+=~-]{7,127}[0-9A-Za-z_/+=~-])",
    "secret": r"(?<![0-9A-Za-z])(?P<secret>[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])(?P<iban>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![0-9A-Za-z])",
    "card": r"(?<![\w+])(?P<card>[0-9](?:[ -]?[0-9]){12,18})(?!\w)",
    "ip": r"(?<![\w.])(?P<ip>(?:[0-9]{1,3}\.){3}[0-9]{1,3})(?![\w]|\.[0-9])",
    "date": r"(?<![\w.])(?P<date>[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?!\w)",
    "phone": r"(?<![\w+])(?P<phone>\+[0-9]{1,3}[ -]?(?:\([0-9]{2,4}\)[ -]?)?[0-9]{2,4}(?:[ -]?[0-9]{2,4}){1,3}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?!\w)",
}
#: One pass over the text.
PATTERN = re.compile("|".join(FORMS.values()))
#: Each kind alone, for places where another one fails its check.
ALONE = {kind: re.compile(form) for kind, form in FORMS.items()}
#: IBAN lengths by country.
LENGTHS = {
    c: int(n)
    for n, countries in (part.split(":") for part in (
        "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,CR,HR,LI,LV "
        "22:BG,BH,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST "
        "26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,YE "
        "31:MT,SC 32:LC 33:RU"
    ).split())
    for c in countries.split(",")
}
GROUP = re.compile(r"\W?\w+")
HEX = re.compile(r"[0-9a-f]{32,128}|[0-9A-F]{32,128}")
#: What any value holds at least; texts without it are not searched further.
HINT = re.compile(r"[0-9@]|[a-f]{32}|[A-F]{32}")
DAY_ONE, DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


class Pseudonyms:
    """Keyed permutations of formats."""

    def __init__(self, key: bytes, rounds: int = 8) -> None:
        self.key, self.rounds = key, rounds

    def _round(self, value: int, turn: int, n: int, kind: str, bits: int) -> int:
        message = f"{kind}|{n}|{turn}|{value}".encode()
        digest = hashlib.blake2b(message, key=self.key, digest_size=32).digest()
        return int.from_bytes(digest, "big") & ((1 << bits) - 1)

    def number(self, value: int, n: int, kind: str, undo: bool = False) -> int:
        """A bijection of 0..n-1, or its inverse."""
        if n < 2:
            return value
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        low = (1 << half) - 1
        while True:
            left, right = value >> half, value & low
            if undo:
                for turn in reversed(range(self.rounds)):
                    left, right = right ^ self._round(left, turn, n, kind, half), left
            else:
                for turn in range(self.rounds):
                    left, right = right, left ^ self._round(right, turn, n, kind, half)
            value = (left << half) | right
            if value < n:
                return value

    def symbols(self, text: str, kind: str, undo: bool = False) -> str:
        """Permute the digits, lower and upper letters of a text within their own classes."""
        value, n = 0, 1
        classes = [next((c for c in _CLASSES if x in c), None) for x in text]
        for x, c in zip(text, classes, strict=True):
            if c:
                value, n = value * len(c) + c.index(x), n * len(c)
        shape = "".join("0aAx"[_CLASSES.index(c)] if c else "" for c in classes)
        value = self.number(value, n, f"{kind}|{shape}", undo)
        out = list(text)
        for at in range(len(text) - 1, -1, -1):
            if c := classes[at]:
                value, digit = divmod(value, len(c))
                out[at] = c[digit]
        return "".join(out)

    def replace(self, kind: str, text: str, undo: bool = False) -> str | None:
        """The pseudonym of a found value, None if it fails its check."""
        return getattr(self, f"_{kind}")(text, undo)

    def _email(self, text: str, undo: bool) -> str:
        body, dot, last = text.rpartition(".")
        return self.symbols(body, "email", undo) + dot + last

    def _secret(self, text: str, undo: bool) -> str:
        if not HEX.fullmatch(text):  # of a key assignment
            fresh = self.symbols(text, "assigned", undo)
            while HEX.fullmatch(fresh):
                fresh = self.symbols(fresh, "assigned", undo)
            return fresh
        digits = string.hexdigits[:16]
        value = self.number(int(text, 16), 16 ** len(text), f"secret{len(text)}", undo)
        found = "".join(digits[(value >> (4 * i)) & 15] for i in reversed(range(len(text))))
        return found.upper() if text != text.lower() else found

    def _card(self, text: str, undo: bool) -> str | None:
        digits = [c for c in text if c.isdigit()]
        if luhn(digits):
            return None
        body = self.number(int("".join(digits[:-1])), 10 ** (len(digits) - 1), f"card{len(digits)}", undo)
        fresh = f"{body:0{len(digits) - 1}d}0"
        fresh = fresh[:-1] + str(-luhn(list(fresh)) % 10)
        return _print_like(text, fresh)

    def _iban(self, text: str, undo: bool) -> str | None:
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
            return None
        body = self.symbols(plain[4:], f"iban{plain[:2]}", undo)
        check = 98 - _mod97(body + plain[:2] + "00")
        fresh = iter(f"{plain[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(fresh) for c in text)

    def _ip(self, text: str, undo: bool) -> str | None:
        octets = [int(x) for x in text.split(".")]
        if max(octets) > 255:
            return None
        value = self.number(int.from_bytes(bytes(octets), "big"), 2**32, "ip", undo)
        return ".".join(str(x) for x in value.to_bytes(4, "big"))

    def _date(self, text: str, undo: bool) -> str | None:
        mark = text[4] if text[4] == "-" else text[2]
        parts = [int(x) for x in text.split(mark)]
        year, month, day = parts if mark == "-" else parts[::-1]
        try:
            n = (date(year, month, day) - DAY_ONE).days
        except ValueError:
            return None
        if not 0 <= n < DAYS:
            return None
        fresh = DAY_ONE + timedelta(self.number(n, DAYS, "date", undo))
        return fresh.strftime({"-": "%Y-%m-%d", ".": "%d.%m.%Y", "/": "%d/%m/%Y"}[mark])

    def _phone(self, text: str, undo: bool) -> str | None:
        digits = [c for c in text if c.isdigit()]
        if not 7 <= len(digits) <= 15:
            return None
        head = re.match(r"\+[0-9]{1,3}(?=[ -(])", text)  # the country code stays
        kept = len(head.group()) - 1 if head else 0
        rest = digits[kept:]
        fresh = self.number(int("".join(rest)), 10 ** len(rest), f"phone{''.join(digits[:kept])}|{len(rest)}", undo)
        return _print_like(text, "".join(digits[:kept]) + f"{fresh:0{len(rest)}d}")


_CLASSES = (string.digits, string.ascii_lowercase, string.ascii_uppercase, "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß")


def luhn(digits: list[str]) -> int:
    """0 for a valid number: the weighted digit sum modulo 10."""
    total = 0
    for at, digit in enumerate(reversed(digits)):
        n = int(digit) * (1 + at % 2)
        total += n - 9 * (n > 9)
    return total % 10


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _print_like(shape: str, digits: str) -> str:
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in shape)


def _parts(kind: str, text: str) -> list[tuple[int, int]]:
    """Stretches of a failed find between word borders, whole words and usual groups of cards first, then longer ones."""
    words = [m.span() for m in re.finditer(r"[0-9A-Z]+" if kind == "iban" else r"[0-9]+", text)]
    ways = []
    for i, (a, _) in enumerate(words if kind != "phone" else [(0, 0)]):
        for j in range(i, len(words)):
            z = words[j][1]
            part = text[a:z]
            plain = re.sub(r"[^0-9A-Z]", "", part)
            if kind == "iban":
                good = len(plain) == LENGTHS.get(plain[:2]) and plain[2:4].isdigit()
            elif kind == "card":
                good = 13 <= len(plain) <= 19
            else:
                good = bool(ALONE[kind].fullmatch(part))
            if good and z - a < len(text):
                usual = i == j or [z - a for a, z in words[i : j + 1]] in ([4] * 4, [4, 6, 5], [4, 6, 4])
                ways.append((not usual, a - z, a, z))
    return [(a, z) for *_, a, z in sorted(ways)]


def pseudonymise(text: str, names: Pseudonyms) -> tuple[str, list[str]]:
    """The text with pseudonyms, and the kind of each value replaced."""
    kinds: list[str] = []
    if not HINT.search(text):
        return text, kinds
    cached = lru_cache(maxsize=None)(names.replace)
    out: list[str] = []

    def found(match: re.Match) -> tuple[int, int, str, str] | None:
        """Where a value is, its kind, and its pseudonym."""
        kind, (a, z) = match.lastgroup, match.span(match.lastgroup)
        said = "secret" if kind == "assigned" else kind
        if (fresh := cached(said, text[a:z])) is not None:
            return a, z, said, fresh
        later = list(FORMS)[list(FORMS).index(kind) + 1 :]
        for other in later:  # whole finds of other kinds that begin here
            if (m := ALONE[other].match(text, a, match.endpos)) and (fresh := cached(other, m.group(other))) is not None:
                return m.start(), m.end(), other, fresh
        if kind in ("card", "iban", "phone"):
            for low, high in _parts(kind, text[a:z]):
                if (fresh := cached(kind, text[a + low : a + high])) is not None:
                    return a + low, a + high, kind, fresh
        return None

    def scan(at: int, end: int) -> None:
        """Append text[at:end] with pseudonyms."""
        start = at
        while match := PATTERN.search(text, start, end):
            value = found(match)
            if value is None:
                start = GROUP.match(text, match.start(), end).end()
                continue
            a, z, kind, fresh = value
            if a > match.start() and a > match.start(match.lastgroup):  # something may stand before it
                out.append(text[at : match.start()])
                scan(match.start(), a)
            else:
                out.append(text[at:a])
            out.append(fresh)
            kinds.append(kind)
            at = start = z
        out.append(text[at:end])

    scan(0, len(text))
    return "".join(out), kinds


def hide(docs: DataFrame, key: str = "cueweave") -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and added columns: n_<kind> for each kind, n_values.

    ``key`` is the secret of the permutation; give one of your own.
    """
    counts = [f"n_{kind}" for kind in KINDS] + ["n_values"]
    kept = [f for f in docs.schema.fields if f.name not in counts]
    schema = T.StructType([*kept, *[T.StructField(c, T.LongType()) for c in counts]])
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(secret)
        for batch in slices(batches):
            done = [(t, []) if t is None else pseudonymise(t, names) for t in batch["text"].to_pylist()]
            texts = pa.array([t for t, _ in done], pa.string())
            given = [texts if f.name == "text" else batch[f.name] for f in kept]
            made = [pa.array([k.count(kind) for _, k in done], pa.int64()) for kind in KINDS]
            made.append(pa.array([len(k) for _, k in done], pa.int64()))
            yield pa.RecordBatch.from_arrays([*given, *made], names=schema.names)

    named = docs.select(*[f.name for f in kept])
    spread = named.withColumn("text", F.col("text").cast("string"))
    return spread.mapInArrow(work, schema)
