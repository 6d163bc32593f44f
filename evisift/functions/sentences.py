"""The sentence splitters (C26, T05) — one function per variant, never unified — and offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import STRIP_CHARS
from .text import bind, squash, strip

_MARK = "\x1e"


# What ends a sentence of (a), and the noncharacter that is put behind it to cut there.
_UNIT_END = rf"[.!?\x{{3002}}\x{{ff01}}\x{{ff1f}}]\s*|\n+|{_MARK}"
_SEAM = "\uffff"
#: Numbers (2 to the power 5) that a running total adds up one by one; whole blocks of them come before.
_BLOCK = 32


def _pieces(c: Column) -> Column:
    return F.filter(F.transform(c, strip), lambda p: p != "")


def _totals_before(sizes: Column) -> Column:
    """Sum of the numbers before each one, by blocks: nothing grows from step to step, as the state of a fold would."""
    add = lambda a, start, n: F.aggregate(F.slice(a, start, n), F.lit(0), lambda x, y: x + y)

    def of(s: Column) -> Column:
        heads = F.sequence(F.lit(0), F.shiftright(F.size(s), 5))
        blocks = F.transform(heads, lambda b: add(s, b * _BLOCK + 1, F.lit(_BLOCK)))
        starts = bind(blocks, lambda bl: F.transform(heads, lambda b: add(bl, F.lit(1), b)))
        return bind(starts, lambda st: F.transform(s, lambda _, i: F.get(st, F.shiftright(i, 5)) + add(s, F.shiftright(i, 5) * _BLOCK + 1, i % _BLOCK)))

    return bind(sizes, of)


def units_at(c: Column) -> Column:
    """C27 for (a): struct(offset, text) of each sentence.

    The text is cut into runs with all their white space, whose lengths tell the places: it is not searched from its start for each
    sentence. Only a text that holds the seam itself is.
    """

    def place(raw: Column) -> Column:
        ahead = lambda r: F.length(r) - F.length(F.ltrim(r, F.lit(STRIP_CHARS)))
        at = lambda before: F.transform(raw, lambda r, i: F.struct((F.get(before, i) + ahead(r)).alias("offset"), strip(r).alias("text")))
        return F.filter(bind(_totals_before(F.transform(raw, F.length)), at), lambda x: x["text"] != "")

    runs = F.split(F.regexp_replace(c, _UNIT_END, f"$0{_SEAM}"), _SEAM)
    return F.when(F.contains(c, F.lit(_SEAM)), with_offsets(c, split_units(c))).otherwise(bind(runs, place))


def split_units(c: Column) -> Column:
    """(a) after any stop even without space, or at newlines."""
    return _pieces(F.split(F.regexp_replace(c, r"([.!?\x{3002}\x{ff01}\x{ff1f}])\s*|\n+", f"$1{_MARK}"), _MARK))


def split_ws_semicolon(c: Column) -> Column:
    """(b) whitespace needed after the stop, semicolons included, text squashed first."""
    return _pieces(F.split(F.regexp_replace(squash(c), r"([.!?\x{3002}\x{ff01}\x{ff1f};\x{ff1b}])\s+", f"$1{_MARK}"), _MARK))


def split_claims(c: Column) -> Column:
    """(c) whitespace after the stop, or newlines."""
    return _pieces(F.split(F.regexp_replace(c, r"([.!?\x{3002}\x{ff01}\x{ff1f}])\s+|\n+", f"$1{_MARK}"), _MARK))


def split_cjk_stops(c: Column) -> Column:
    """(d) CJK stops and newlines only: English text stays one sentence per line."""
    return _pieces(F.split(c, r"[\x{3002}\x{ff01}\x{ff1f}\n]+"))


def split_keep_stop(c: Column) -> Column:
    """(e) directly after any stop, then at newlines."""
    return _pieces(F.split(F.regexp_replace(c, r"([\x{3002}\x{ff01}\x{ff1f}.!?])", f"$1{_MARK}"), f"[{_MARK}\n]"))


def split_ascii(c: Column) -> Column:
    """(f) ASCII stops followed by whitespace."""
    return _pieces(F.split(F.regexp_replace(c, r"([.!?])\s+", f"$1{_MARK}"), _MARK))


def split_ws(c: Column) -> Column:
    """(g) whitespace needed after the stop, no semicolons."""
    return _pieces(F.split(F.regexp_replace(c, r"([.!?\x{3002}\x{ff01}\x{ff1f}])\s+", f"$1{_MARK}"), _MARK))


def with_offsets(text: Column, parts: Column) -> Column:
    """0-based offset of each part by incremental search from the previous end."""
    zero = F.struct(F.lit(0).alias("cur"), F.array().cast("array<struct<offset:int,text:string>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        at = F.call_function("locate", p, text, acc["cur"] + 1) - 1
        at = F.when(at < 0, acc["cur"]).otherwise(at)
        return F.struct(
            (at + F.length(p)).alias("cur"),
            F.array_append(acc["out"], F.struct(at.alias("offset"), p.alias("text"))).alias("out"),
        )

    return F.aggregate(parts, zero, step, lambda a: a["out"])
