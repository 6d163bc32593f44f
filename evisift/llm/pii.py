"""Format-preserving Feistel pseudonyms for personal data (operator 1).

Validated values (card numbers by check digit, IBANs by remainder, social security numbers by their ranges, IPv4
addresses by octets, calendar dates, telephone numbers, e-mail local parts, quoted hexadecimal secrets) are read as
one integer of a finite domain, permuted by a keyed Feistel network and written back in the same format; check digits
are computed anew. Equal values get equal pseudonyms in every document and layout. Numbers that fail validation stay as they are,
and so do dates with years of two digits or names of months, and telephone numbers without separators or +.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, table
from .registry import query

ROUNDS = 8
#: Demonstration key; a deployment passes its own secret.
DEMO_KEY = b"evisift-demo-key"


class Feistel:
    """Keyed permutation of 0 .. n-1: an alternating Feistel network on Z_a x Z_b, walked until it lands below n.

    ``apply`` conjugates a step of one with the network, so that no value maps to itself (n > 1); ``undo`` inverts it.
    """

    def __init__(self, n: int, key: bytes, tweak: str):
        self.n = n
        self.a = math.isqrt(n - 1) + 1
        self.b = -(-n // self.a)
        self.key, self.tweak = key, tweak.encode()

    def _round(self, i: int, half: int, mod: int) -> int:
        raw = half.to_bytes((half.bit_length() + 7) // 8 or 1, "big")
        digest = hashlib.blake2b(bytes([i]) + self.tweak + b"\0" + raw, key=self.key[:64], digest_size=64).digest()
        return int.from_bytes(digest, "big") % mod

    def _forward(self, x: int) -> int:
        while True:
            left, right = divmod(x, self.b)
            for i in range(0, ROUNDS, 2):
                left = (left + self._round(i, right, self.a)) % self.a
                right = (right + self._round(i + 1, left, self.b)) % self.b
            x = left * self.b + right
            if x < self.n:
                return x

    def _back(self, x: int) -> int:
        while True:
            left, right = divmod(x, self.b)
            for i in range(ROUNDS - 2, -1, -2):
                right = (right - self._round(i + 1, left, self.b)) % self.b
                left = (left - self._round(i, right, self.a)) % self.a
            x = left * self.b + right
            if x < self.n:
                return x

    def apply(self, x: int) -> int:
        return self._back((self._forward(x) + 1) % self.n)

    def undo(self, x: int) -> int:
        return self._back((self._forward(x) - 1) % self.n)


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        v = int(c) * (2 - i % 2)
        total += v - 9 * (v > 9)
    return str(-total % 10)


def _radix(c: str, hexadecimal: bool) -> int:
    if hexadecimal:
        return 16
    return 10 if c.isdigit() else 26


def _permute_chars(chars: str, key: bytes, kind: str, undo: bool, hexadecimal: bool = False) -> str:
    """Digits stay digits and letters letters, letter case by position; the whole string is one mixed-radix integer."""
    value, size = 0, 1
    for c in chars:
        r = _radix(c, hexadecimal)
        value = value * r + (int(c, 16) if r == 16 else int(c) if r == 10 else ord(c.lower()) - 97)
        size *= r
    shape = "".join("x" if hexadecimal else "9" if c.isdigit() else "a" for c in chars)
    net = Feistel(size, key, f"{kind}:{shape}")
    value = net.undo(value) if undo else net.apply(value)
    out = []
    for c in reversed(chars):
        value, d = divmod(value, _radix(c, hexadecimal))
        new = "0123456789abcdef"[d] if hexadecimal or c.isdigit() else chr(97 + d)
        out.append(new.upper() if c.isupper() or hexadecimal and chars.upper() == chars else new)
    return "".join(reversed(out))


def _refill(template: str, keep: Callable[[str], bool], chars: str) -> str:
    it = iter(chars)
    return "".join(next(it) if keep(c) else c for c in template)


def _card(s: str, key: bytes, undo: bool) -> str | None:
    digits = re.sub(r"\D", "", s)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    new = digits[0] + _permute_chars(digits[1:-1], key, "card", undo)
    return _refill(s, str.isdigit, new + luhn_digit(new))


#: Characters of an IBAN by country (IBAN registry).
IBAN_LENGTHS = {c: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 33: "RU", 32: "LC",
}.items() for c in countries.split()}


def iban_end(s: str) -> int | None:
    """Where the country's length ends an IBAN that ``s`` begins with; None if it ends inside a word or not in ``s``."""
    left = IBAN_LENGTHS.get(s[:2].upper(), 0)
    for i, c in enumerate(s):
        left -= c != " "
        if not left:
            return i + 1 if i + 1 == len(s) or s[i + 1] == " " else None
    return None


def _iban_rest(country: str, body: str) -> int:
    return int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def _iban(s: str, key: bytes, undo: bool) -> str | None:
    flat = re.sub(r"\s", "", s).upper()
    if not 15 <= len(flat) <= 34 or f"{98 - _iban_rest(flat[:2], flat[4:]):02d}" != flat[2:4]:
        return None
    body = _permute_chars(flat[4:], key, "iban" + flat[:2], undo)
    return _refill(s, str.isalnum, f"{flat[:2]}{98 - _iban_rest(flat[:2], body):02d}{body}")


def _ssn(s: str, key: bytes, undo: bool) -> str | None:
    area, group, serial = (int(x) for x in s.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    net = Feistel(898 * 99 * 9999, key, "ssn")
    x, serial = divmod(net.undo(x) if undo else net.apply(x), 9999)
    area, group = divmod(x, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _ipv4(s: str, key: bytes, undo: bool) -> str | None:
    octets = s.split(".")
    if any(int(o) > 255 or str(int(o)) != o for o in octets):
        return None
    net = Feistel(1 << 32, key, "ipv4")
    x = int.from_bytes(bytes(map(int, octets)), "big")
    return ".".join(map(str, (net.undo(x) if undo else net.apply(x)).to_bytes(4, "big")))


# Country calling codes of one and two digits; all others have three.
SHORT_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def calling_code(digits: str) -> str:
    """The country calling code that ``digits`` of an international number begin with (codes are free of prefixes)."""
    return next((digits[:n] for n in (1, 2) if digits[:n] in SHORT_CODES), digits[:3])


def _phone(s: str, key: bytes, undo: bool) -> str | None:
    """The calling code, a trunk zero in brackets and the layout stay; the national number is permuted, alike in every layout.

    A number of three, three and four digits without + is one of calling code 1.
    """
    shown = s.replace("(0)", "()")
    digits = re.sub(r"\D", "", shown)
    if not 8 <= len(digits) <= 15:
        return None
    code = calling_code(digits) if s[0] == "+" else "1"
    keep = len(code) if s[0] == "+" else 0
    new = _refill(shown, str.isdigit, digits[:keep] + _permute_chars(digits[keep:], key, f"phone{code}", undo))
    return new.replace("()", "(0)")


FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


@lru_cache(maxsize=2)
def _days(late: bool) -> list[int]:
    """Days of the domain whose day of the month is above 12 (``late``), or not: only the former can be told day first by a slash or hyphen."""
    return [d for d in range(FIRST_DAY, LAST_DAY + 1) if (datetime.date.fromordinal(d).day > 12) == late]


def _date(s: str, key: bytes, undo: bool) -> str | None:
    """Years first, or day first with dots, or month first with slashes or hyphens, and day first where that is no date.

    One date gets one pseudonym in every layout. Days of the month above 12 are permuted among themselves and so are the others, so
    that a pseudonym is read in the order its value was read in.
    """
    parts = re.split(r"[-/.]", s)
    order = (0, 1, 2) if len(parts[0]) == 4 else (2, 1, 0) if "." in s or int(parts[0]) > 12 else (2, 0, 1)
    try:
        date = datetime.date(*(int(parts[i]) for i in order))
    except ValueError:
        return None
    if not FIRST_DAY <= date.toordinal() <= LAST_DAY:
        return None
    days = _days(date.day > 12)
    at = bisect_left(days, date.toordinal())
    net = Feistel(len(days), key, "late date" if date.day > 12 else "early date")
    new = datetime.date.fromordinal(days[net.undo(at) if undo else net.apply(at)])
    fields = {order[0]: f"{new.year:04d}", order[1]: f"{new.month:02d}", order[2]: f"{new.day:02d}"}
    return re.sub(r"\d+", lambda m, it=iter(range(3)): fields[next(it)], s)


def _email(s: str, key: bytes, undo: bool) -> str | None:
    local, _, domain = s.partition("@")
    chars = "".join(c for c in local if c.isascii() and c.isalnum())
    if not chars:
        return None
    return _refill(local, lambda c: c.isascii() and c.isalnum(), _permute_chars(chars, key, "email@" + domain.lower(), undo)) + "@" + domain


def _secret(s: str, key: bytes, undo: bool) -> str | None:
    if len(set(s.lower())) < 4:
        return None
    return _permute_chars(s, key, "secret", undo, hexadecimal=True)


#: Kind, pattern, permutation. The first kind whose pattern and validation hold at a place wins.
KINDS: list[tuple[str, str, Callable[[str, bytes, bool], str | None]]] = [
    ("email", r"(?<![\w.%+-])[\w.%+-]{1,64}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])", _email),
    ("secret", r"(?:(?<=[\"'=:])|(?<=[=:] ))[0-9A-Fa-f]{32,128}(?![A-Za-z0-9])", _secret),
    ("iban", r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    ("phone", r"(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![\w])|(?<![\w(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?!\w)|(?<![\w.+-])(?<!\) )[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}(?!\w|[.-][0-9])", _phone),
    ("ipv4", r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9])", _ipv4),
    ("ssn", r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", _ssn),
    ("date", r"(?<![\w./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?:(?=T[0-9]{2}:)|(?!\w|[./-][0-9]))", _date),
    ("card", r"(?<!\w)(?<![0-9]-)(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?!\w|-[0-9])", _card),
]
PATTERNS = [(kind, re.compile(pattern, 0 if kind == "email" else re.ASCII), change) for kind, pattern, change in KINDS]
HINT = re.compile(r"[0-9@]")


def find_values(text: str) -> list[tuple[int, int, str]]:
    """Non-overlapping (start, end, kind) of validated values, left to right; an earlier kind of KINDS wins an overlap."""
    if not HINT.search(text):
        return []
    taken: list[tuple[int, int, str]] = []
    for kind, pattern, change in PATTERNS:
        new, at = [], 0
        while m := pattern.search(text, at):
            start, at = m.span()
            ends = [at]
            if kind == "iban":
                # The pattern runs on into words that follow; what is behind the value, or begins in a failed match, is searched as well.
                if cut := iban_end(m[0]):
                    ends = [start + cut] if start + cut == at else [start + cut, at]
                at = start + 1
            for end in ends:
                i = bisect_left(taken, (start,))
                free = (i == 0 or taken[i - 1][1] <= start) and (i == len(taken) or taken[i][0] >= end)
                if free and change(text[start:end], b"probe", False) is not None:
                    new.append((start, end, kind))
                    at = end
                    break
        taken = sorted(taken + new)
    return taken


def pseudonymise(text: str, key: bytes, undo: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with every validated value replaced, and the spans (kind, start, end) that were replaced.

    ``undo`` expects a text written by this function and gives the input back.
    """
    out, at, spans = [], 0, find_values(text)
    change = {kind: f for kind, _, f in PATTERNS}
    for start, end, kind in spans:
        out += [text[at:start], _cached(change[kind], text[start:end], key, undo)]
        at = end
    return ("".join(out) + text[at:] if spans else text), spans


@lru_cache(maxsize=50_000)
def _cached(change, value: str, key: bytes, undo: bool) -> str:
    return change(value, key, undo)


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))


def feistel_pseudonyms(df: DataFrame, key: bytes, text: str = "text", out: str = "pseudonymised", spans: str = "pii_spans") -> DataFrame:
    """``df`` with the pseudonymised text and the replaced spans (character offsets in the given text).

    Null text stays null with no spans; empty text stays empty. Row-local: no shuffle, repeated rows are repeated.
    """
    def make(batch: pa.RecordBatch) -> dict:
        texts, found = [], []
        for t in batch.column(text).to_pylist():
            new, where = (None, []) if t is None else pseudonymise(t, key)
            texts.append(new)
            found.append([{"start": s, "end": e, "kind": k} for s, e, k in where])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        return {out: pa.array(texts, pa.string()), spans: pa.array(found, kind)}

    return map_rows(df, text, [(out, T.StringType()), (spans, SPAN)], make)


@query("op1_feistel_pseudonyms")
def op1_feistel_pseudonyms(spark, sf_dir):
    """Every document with its pseudonymised text and the number of replaced values by kind."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = feistel_pseudonyms(docs, DEMO_KEY)
    counts = [F.expr(f"size(filter(pii_spans, x -> x.kind = '{k}'))").alias(f"n_{k}") for k, _, _ in KINDS]
    return done.select("doc_id", F.col("pseudonymised").alias("text"), F.size("pii_spans").alias("n_replaced"), *counts, "pii_spans")
