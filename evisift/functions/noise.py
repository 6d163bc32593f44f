"""Noise tests, section headings and document metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .text import bind, squash, strip

# Bibliographic patterns, written without dialect-specific syntax.
REF_HEADER = r"(?i)^\s*(references?|bibliography)\s*[:\x{ff1a}]?\s*$"
CITATION = r"\b[A-Z][A-Za-z\-']+\s+et al\.?,?\s*\(?\d{4}\)?"
DOI = r"(?i)\b10\.\d{4,9}/\S+"
JOURNAL_WORDS = r"(?i)\b(vol\.?|issue|pages?|doi|journal|proceedings|copyright)\b"
YEAR_PAREN = r"\(\d{4}\)"
METHOD_SENTENCE = (
    r"(?i)\b(rna\s+was\s+extracted|dna\s+was\s+extracted|rt-?pcr|real-?time\s+pcr|"
    r"according\s+to\s+the\s+manufacturer|using\s+the\s+\w+\s+kit|"
    r"incubated|centrifuged|buffer|aliquot|assay|protocol|"
    r"mice\s+were\s+infected|sample[s]?\s+were\s+collected)\b"
)
ABSTRACT_END = (
    r"(?i)\b(keywords?|introduction|background|methods?|materials?\s+and\s+methods?|results?|"
    r"funding|disclosure|author\s+contributions?|conflicts?\s+of\s+interest|competing\s+interests?|"
    r"data\s+availability|ethics\s+statement|acknowledg?ements?|references?|bibliography)\b"
)
SENTENCE_CLOSE = "[.!?\\x{3002}\\x{ff01}\\x{ff1f};\\x{ff1b})\\]\\x{ff09}\\x{300d}'\"]\\s*$"
STANDALONE_HEADING = r"^\s*(?:[\dIVXivx]+[.)]\s*)*([A-Za-z]+)(?:\s+(?:and\s+)?[A-Za-z]+)*\s*[:\x{ff1a}]?\s*$"
INLINE_HEADING = r"^\s*(?:[\dIVXivx]+[.)]\s*)*([A-Za-z]+)(?:\s+(?:and\s+)?[A-Za-z]+)*\s*[:\x{ff1a}.\n]"


def is_low_value_sentence(c: Column) -> Column:
    """C20: reference header, DOI, citation, journal words, many years, author list."""
    t = strip(c)
    commas = F.length(t) - F.length(F.translate(t, ",，", ""))
    return (
        (t == "")
        | t.rlike(REF_HEADER)
        | t.rlike(DOI)
        | t.rlike(CITATION)
        | t.rlike(JOURNAL_WORDS)
        | (F.regexp_count(t, F.lit(YEAR_PAREN)) >= 3)
        | ((commas >= 6) & (F.length(t) < 280))
    )


def is_sentence_noise(c: Column) -> Column:
    """The lighter test in front of triple extraction."""
    t = strip(c)
    return (t == "") | t.rlike(DOI) | t.rlike(CITATION) | (F.regexp_count(t, F.lit(YEAR_PAREN)) >= 3)


def is_low_value_paragraph(c: Column) -> Column:
    """C22."""
    p = strip(c)
    return (p == "") | p.rlike(REF_HEADER) | (F.length(p) < 40) | (F.regexp_count(p, F.lit(YEAR_PAREN)) >= 6)


def _section_of(keyword: Column) -> Column:
    pairs = [F.lit(x) for kv in vocab.SECTION_KEYWORDS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(keyword)), F.lit(""))


def heading_section(line: Column) -> Column:
    """Section named by a heading line, '' if the line is no heading."""
    s = strip(line)
    alone = F.when(F.length(s) <= 60, _section_of(F.regexp_extract(s, STANDALONE_HEADING, 1))).otherwise("")
    inline = _section_of(F.regexp_extract(s, INLINE_HEADING, 1))
    return F.when((s == "") | (F.length(s) > 200), "").when(alone != "", alone).otherwise(inline)


def split_sentences_seed(c: Column) -> Column:
    """C26 variant (b): needs whitespace after the stop, semicolons included."""
    return _seed_parts(squash(c))


def _seed_parts(t: Column) -> Column:
    parts = F.split(t, r"(?<=[.!?\x{3002}\x{ff01}\x{ff1f};\x{ff1b}])\s+")
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def abstract_window(c: Column) -> Column:
    """Text after the first 'abstract', cut before the next section marker."""
    # A marker counts only past 120 characters, and only if it is the first marker.
    def window(tail: Column) -> Column:
        cut = lambda first: F.when(first > 121, F.substring(tail, F.lit(1), first - 1)).otherwise(tail)
        return F.when(F.length(tail) < 40, "").otherwise(squash(bind(F.regexp_instr(tail, F.lit(ABSTRACT_END)), cut)))

    return bind(strip(F.regexp_extract(c, r"(?is)\babstract\b(.*)$", 1)), window)


def truncate_abstract_tail(c: Column) -> Column:
    """Drop a trailing section that starts past 120 characters."""
    return bind(squash(c), _without_tail)


def _without_tail(t: Column) -> Column:
    cut = lambda first: F.when(first > 121, strip(F.substring(t, F.lit(1), first - 1))).otherwise(t)
    return bind(F.regexp_instr(t, F.lit(ABSTRACT_END)), cut)


def _first(s: Column, good) -> Column:
    """The first element for which ``good`` holds; those after it are not tried."""
    return F.aggregate(s, F.lit(None).cast("string"), lambda got, x: F.when(got.isNotNull(), got).when(good(x), x))


def seed_sentence_abstract(c: Column) -> Column:
    """First complete, medium-length, non-method sentence; two fallbacks."""
    return bind(split_sentences_seed(c), _abstract_seed)


def _abstract_seed(s: Column) -> Column:
    good = _first(s, lambda x: F.length(x).between(45, 420) & x.rlike(SENTENCE_CLOSE) & ~x.rlike(METHOD_SENTENCE))
    complete = _first(s, lambda x: (F.length(x) >= 40) & x.rlike(SENTENCE_CLOSE))
    return F.coalesce(good, complete, strip(F.substring(F.get(s, 0), 1, 420)), F.lit(""))


def seed_sentence_generic(c: Column) -> Column:
    """C25 without an abstract: medium-length sentence of at least eight words."""
    return bind(split_sentences_seed(c), _generic_seed)


def _generic_seed(s: Column) -> Column:
    good = _first(
        s, lambda x: F.length(x).between(55, 420) & (F.size(F.split(x, r"\s+")) >= 8) & ~x.rlike(DOI) & ~x.rlike(METHOD_SENTENCE)
    )
    longish = _first(s, lambda x: F.length(x) >= 45)
    return F.coalesce(good, strip(F.substring(longish, 1, 420)), F.lit(""))


def seeds(c: Column) -> Column:
    """struct(window, seed, abstract_seed) of a text whose white space is collapsed and which is cut into sentences once."""

    def of(t: Column) -> Column:
        # A text that loses no tail has the same sentences.
        def both(b: Column) -> Column:
            last = F.when(b["cut"] == t, _abstract_seed(b["s"])).otherwise(bind(_seed_parts(b["cut"]), _abstract_seed))
            return F.struct(abstract_window(c).alias("window"), _generic_seed(b["s"]).alias("seed"), last.alias("abstract_seed"))

        return bind(F.struct(_seed_parts(t).alias("s"), _without_tail(t).alias("cut")), both)

    return bind(squash(c), of)


def doc_meta(c: Column, source_uri: Column, doc_id: Column) -> Column:
    """DOI, year within 4000 characters, first title-like line with fallbacks."""
    lines = F.transform(F.split(c, "\n"), strip)
    titles = F.filter(
        lines, lambda l: F.length(l).between(10, 300) & ~l.rlike(DOI) & ~l.rlike(vocab.TITLE_NOISE_LINE)
    )
    base = F.regexp_replace(F.element_at(F.split(source_uri, "/"), -1), r"(?i)\.pdf$", "")
    return F.struct(
        F.coalesce(F.get(titles, 0), F.nullif(strip(base), F.lit("")), strip(doc_id.cast("string"))).alias("title"),
        F.nullif(F.regexp_extract(c, vocab.DOI_CAPTURE, 1), F.lit("")).alias("doi"),
        F.nullif(F.regexp_extract(F.substring(c, 1, 4000), r"\b(19\d{2}|20\d{2})\b", 1), F.lit("")).cast("int").alias(
            "publication_year"
        ),
    )
