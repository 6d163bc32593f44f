"""As-of assignment of section headings to paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.noise import heading_section
from ..functions.rows import explode_rows
from ..functions.chars import WS
from ..functions.text import bind, strip

MARK = "array<struct<o:int,sec:string>>"


def section_markers(c: Column) -> Column:
    """Heading lines with their character offset; an inline 'abstract' only as a fallback."""
    zero = F.struct(F.lit(0).alias("off"), F.array().cast(MARK).alias("ms"))

    def step(acc: Column, line: Column) -> Column:
        sec = heading_section(line)
        ms = F.when(sec != "", F.array_append(acc["ms"], F.struct(acc["off"].alias("o"), sec.alias("sec")))).otherwise(acc["ms"])
        return F.struct((acc["off"] + F.length(line) + 1).alias("off"), ms.alias("ms"))

    ms = F.aggregate(F.split(c, "\n"), zero, step, lambda a: a["ms"])
    at = F.regexp_instr(c, F.lit(r"(?i)\babstract\b")) - 1
    need = ~F.exists(ms, lambda m: m["sec"] == "abstract") & (at >= 0)
    return F.array_sort(F.when(need, F.array_append(ms, F.struct(at.alias("o"), F.lit("abstract").alias("sec")))).otherwise(ms))


BLANK_LINE = f"\n[{WS}]*\n"


def paragraph_sections(df: DataFrame, key: str, text: str, initial: str = "") -> DataFrame:
    """One row per paragraph with the last heading at or before its start.

    The match runs inside the document row, block by block between blank lines, so it is linear in the text, needs no
    search for the paragraph and tells paragraphs of equal wording apart. A heading counts for its own block only as its first
    line; an inline 'abstract' stands in for a heading where no line is one, as in ``section_markers``.
    """
    c = F.col(text)
    headings = lambda b: F.filter(F.transform(F.split(b, "\n"), heading_section), lambda h: h != "")
    blocks = F.transform(F.split(c, BLANK_LINE), lambda b: F.struct(strip(b).alias("p"), headings(b).alias("hs")))
    at = F.regexp_instr(c, F.lit(r"(?i)\babstract\b"))
    inline = F.when(at > 0, F.size(F.split(F.substring(c, F.lit(1), at), BLANK_LINE)) - 1)

    def sections(bs: Column) -> Column:
        stands_in = F.when(~F.exists(bs, lambda b: F.array_contains(b["hs"], "abstract")), inline)

        def of(b: Column, i: Column) -> Column:
            here = F.coalesce(stands_in == i, F.lit(False))
            first = heading_section(F.get(F.split(b["p"], "\n"), 0))
            own = F.when(first != "", first).when(here & F.lower(b["p"]).rlike(r"^abstract\b"), "abstract").otherwise("")
            last = F.coalesce(F.try_element_at(b["hs"], F.lit(-1)), F.when(here, "abstract"))
            return F.struct(b["p"].alias("p"), own.alias("own"), last.alias("last"), i.alias("i"))

        return F.transform(bs, of)

    def run_lengths(rows: Column) -> Column:
        """Section in force before each block: every heading repeated up to the block of the next one."""
        marks = F.filter(rows, lambda r: r["last"].isNotNull())
        start = F.array_repeat(F.lit(initial), F.coalesce(F.get(marks, 0)["i"], F.size(rows)).cast("int") + 1)
        return bind(marks, lambda ms: F.concat(start, F.flatten(F.transform(ms, lambda m, k: F.array_repeat(m["last"], (F.coalesce(F.get(ms, k + 1)["i"], F.size(rows)) - m["i"]).cast("int"))))))

    def named(rows: Column) -> Column:
        force = run_lengths(rows)
        both = bind(force, lambda f: F.transform(rows, lambda r, i: F.struct(r["p"].alias("p"), F.when(r["own"] != "", r["own"]).otherwise(F.get(f, i)).alias("section"))))
        return F.filter(both, lambda r: F.length(r["p"]) >= 30)

    rows = explode_rows(df, [key], bind(bind(blocks, sections), named), "para_no", "r")
    return rows.select(key, "para_no", F.col("r.section").alias("section"), F.length("r.p").alias("n_chars"))
