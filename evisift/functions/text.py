"""Cleaning and scalar text functions as Column expressions (operators C01-C34)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .chars import CJK, KANA, LOOSE, STRIP_CHARS, WORD, WS


def strip(c: Column) -> Column:
    """Strip all Unicode whitespace on both ends (SQL trim removes spaces only)."""
    return F.btrim(c, F.lit(STRIP_CHARS))


def falsy_or(*cs: Column) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable.

    A costly expression mentioned inside a higher-order function would otherwise be
    evaluated again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squash(c: Column) -> Column:
    """Collapse every whitespace run to one space and strip. Single blanks, most of a text, are not rewritten."""
    return strip(F.regexp_replace(c, LOOSE, " "))


def normalize_text(c: Column) -> Column:
    """C01. The order of the steps is part of the contract."""
    c = F.translate(c, "\r", "\n")
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{200b}\x{200c}\x{200d}\x{2060}\x{feff}\x{ad}]", "")
    c = F.regexp_replace(F.regexp_replace(c, "ﬁ", "fi"), "ﬂ", "fl")
    c = F.regexp_replace(c, r"\x{fffd}", "")
    c = F.regexp_replace(c, f"([{WORD}])-\n([{WORD}])", "$1$2")
    c = F.regexp_replace(c, "[ \t]+", " ")
    c = F.regexp_replace(c, "\n{3,}", "\n\n")
    return strip(c)


def detect_lang(c: Column) -> Column:
    """Kana, then CJK ideographs, else English."""
    return F.when(c.rlike(f"[{KANA}]"), "ja").when(c.rlike(f"[{CJK}]"), "zh").otherwise("en")


def detect_lang_two_way(c: Column) -> Column:
    """CJK ideographs or English."""
    return F.when(c.rlike(f"[{CJK}]"), "zh").otherwise("en")


def hash_tokens(c: Column) -> Column:
    """ASCII alphanumeric runs or single CJK characters, lower-cased."""
    return F.transform(F.regexp_extract_all(c, F.lit(f"[A-Za-z0-9]+|[{CJK}]"), F.lit(0)), F.lower)


def approx_token_count(c: Column) -> Column:
    """C15 on normalized text."""
    return F.regexp_count(c, F.lit(f"[A-Za-z0-9]+|[{CJK}]"))


def content_key(c: Column) -> Column:
    """First eight sha256 bytes in reverse byte order; exact-duplicate key only."""
    h = F.sha2(c, 256)
    return F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(8)])


def hamming64(a: Column, b: Column) -> Column:
    """C10 on BIGINT fingerprints."""
    return F.bit_count(a.bitwiseXOR(b))


def hex_to_bigint(c: Column) -> Column:
    """16 hex digits to the 64-bit pattern, without overflow under ANSI casts."""
    hi = F.conv(F.substring(c, 1, 8), 16, 10).cast("bigint")
    lo = F.conv(F.substring(c, 9, 8), 16, 10).cast("bigint")
    return F.shiftleft(hi, 32).bitwiseOR(lo)


def quality_score(c: Column, ocr_confidence: Column | None = None) -> Column:
    """C11."""
    t = normalize_text(c)
    score = F.lit(1.0) if ocr_confidence is None else F.coalesce(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), ocr_confidence)), F.lit(1.0)
    )
    return F.when(F.length(t) < 50, 0.0).when(t.rlike(r"(.)\1{8,}"), 0.2).otherwise(score)


def extract_year(c: Column) -> Column:
    """First standalone 19xx/20xx, null if none."""
    return F.nullif(F.regexp_extract(c, r"\b(19\d{2}|20\d{2})\b", 1), F.lit(""))


def _first_hit(haystack: Column, pairs: list[tuple[str, str]], default: Column) -> Column:
    out = None
    for needle, label in pairs:
        cond = F.contains(haystack, F.lit(needle))
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(default)


def disease_tag(c: Column) -> Column:
    """First keyword in list order."""
    return _first_hit(F.lower(c), [(k.lower(), k) for k in vocab.DISEASE_KEYWORDS], F.lit(None).cast("string"))


def paragraph_type(c: Column) -> Column:
    """C14: cue in the first 200 characters, priority order."""
    return _first_hit(F.substring(F.lower(c), 1, 200), vocab.PARAGRAPH_CUES, F.lit("paragraph"))


def nonprintable_ratio(c: Column) -> Column:
    """Neither printable ASCII, CJK nor newline/tab/return."""
    bad = F.length(F.regexp_replace(c, f"[\\x20-\\x7e{CJK}\n\r\t]", ""))
    return bad / F.greatest(F.lit(1), F.length(c))


TABLE_MARKER = r"(?i)<[ \t\n\r\f]*![ \t\n\r\f]*-[ \t\n\r\f]*-[ \t\n\r\f]*table[ \t\n\r\f]*:[ \t\n\r\f]*(\d+)[ \t\n\r\f]*-[ \t\n\r\f]*-[ \t\n\r\f]*>"


def table_marker_ids(c: Column) -> Column:
    """Ids inside table markers, tolerant of spaced punctuation."""
    return F.transform(F.regexp_extract_all(c, F.lit(TABLE_MARKER), F.lit(1)), lambda x: x.cast("int"))


def is_table_text(c: Column) -> Column:
    """C17 without metadata: a marker or at least eight pipes."""
    return c.rlike(TABLE_MARKER) | (F.length(c) - F.length(F.translate(c, "|", "")) >= 8)


def looks_like_markdown_table(c: Column) -> Column:
    """A table marker, or a pipe row together with a rule row."""
    rows = c.rlike(r"(?m)^\s*\|.+\|\s*$") & c.rlike(r"(?m)^\s*\|\s*---")
    return F.contains(c, F.lit("<!-- table:")) | rows


def strip_table_lines(c: Column) -> Column:
    """Drop marker lines and pipe rows, blank out whitespace-only lines."""
    lines = F.filter(
        F.split(c, "\n"),
        lambda l: ~(F.startswith(F.lower(strip(l)), F.lit("<!-- table:")) | F.startswith(strip(l), F.lit("|"))),
    )
    return F.array_join(F.transform(lines, lambda l: F.when(strip(l) == "", "").otherwise(l)), "\n")


def paragraphs(c: Column) -> Column:
    """Blank-line paragraphs of at least 30 characters."""
    return F.filter(F.transform(F.split(c, f"\n[{WS}]*\n"), strip), lambda p: F.length(p) >= 30)


def repair_wrapped_lines(seg: Column) -> Column:
    """C03 as one regex-driven fold over lines."""
    seg = F.regexp_replace(seg, f"([{WORD}])-\n([{WORD}])", "$1$2")
    lines = F.transform(F.split(seg, "\n"), strip)
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))

    def step(acc: Column, ln: Column) -> Column:
        out, buf = acc["out"], acc["buf"]
        has = buf != ""
        flushed = F.when(has, F.array_append(out, buf)).otherwise(out)
        ends = buf.rlike(r"[.!?\x{3002}\x{ff01}\x{ff1f}:;]$")
        return F.when(
            ln == "", F.struct(F.array_append(flushed, F.lit("")).alias("out"), F.lit("").alias("buf"))
        ).when(
            ~has, F.struct(out.alias("out"), ln.alias("buf"))
        ).when(
            ends, F.struct(flushed.alias("out"), ln.alias("buf"))
        ).otherwise(F.struct(out.alias("out"), F.concat(buf, F.lit(" "), ln).alias("buf")))

    def finish(acc: Column) -> Column:
        return F.array_join(
            F.when(acc["buf"] != "", F.array_append(acc["out"], acc["buf"])).otherwise(acc["out"]), "\n"
        )

    return F.aggregate(lines, start, step, finish)


MARKER_LINE = r"(?im)^[ \t]*<\s*!\s*-\s*-\s*table\s*:\s*\d+\s*-\s*-\s*>[ \t]*$"
_CUT = "\x1e"


def clean_noise(c: Column) -> Column:
    """C02. Marker lines are kept apart so that only prose segments are re-wrapped."""
    t = F.regexp_replace(F.translate(c, "\r", "\n"), "[ \t]+", " ")
    t = F.regexp_replace(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{fffd}\x{ad}]", "")
    t = F.regexp_replace(F.regexp_replace(t, "ﬁ", "fi"), "ﬂ", "fl")
    t = F.regexp_replace(t, MARKER_LINE, f"{_CUT}$0{_CUT}")
    parts = F.filter(F.split(t, _CUT), lambda p: p != "")
    parts = F.transform(parts, lambda p: F.when(p.rlike(MARKER_LINE) & ~p.contains("\n"), p).otherwise(repair_wrapped_lines(p)))
    lines = F.transform(F.split(F.array_join(parts, "\n"), "\n"), strip)
    t = F.array_join(F.filter(lines, lambda l: ~l.rlike(r"(?i)^table\s*\d+")), "\n")
    t = F.regexp_replace(t, "(?is)\n(references|\\x{53c2}\\x{8003}\\x{6587}\\x{732e})\n.*$", "")
    t = F.regexp_replace(t, f"\\[[0-9,\\-{WS}]+\\]", "")
    t = F.regexp_replace(t, r"\(([A-Z][A-Za-z]+ et al\.,?\s*\d{4}[a-z]?)\)", "")
    lines = F.transform(F.split(t, "\n"), strip)

    def mathy(l: Column) -> Column:
        return F.length(F.regexp_replace(l, r"[^=+*/^_{}\[\]<>]", "")) / F.greatest(F.lit(1), F.length(l)) > 0.12

    t = F.array_join(F.filter(lines, lambda l: ~mathy(l)), "\n")
    return strip(F.regexp_replace(t, "\n{3,}", "\n\n"))


def stable_id(prefix: str, *cs: Column, algo: str = "sha256", width: int = 16) -> Column:
    """Deterministic id from the joined parts."""
    joined = F.concat_ws("|", *[F.coalesce(x.cast("string"), F.lit("")) for x in cs])
    digest = F.sha1(joined) if algo == "sha1" else F.sha2(joined, 256)
    return F.concat(F.lit(prefix), F.substring(digest, 1, width))


def token_len_fallback(c: Column) -> Column:
    """Half the length, used where no tokenizer is available."""
    return F.floor(F.length(c) / 2)


def first_json_object(c: Column) -> Column:
    """Fenced block, else the outermost braces."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(c)
    return F.nullif(F.regexp_extract(body, r"(?s)\{.*\}", 0), F.lit(""))


def text_quality_bonus(c: Column) -> Column:
    """C34."""
    t = F.coalesce(c, F.lit(""))
    n = F.length(t)
    return (
        F.when(t == "", 0.0)
        .when(t.rlike(r"https?://|www\."), -0.6)
        .when(n < 8, -0.4)
        .when(n > 240, -0.2)
        .otherwise(0.2)
    )
