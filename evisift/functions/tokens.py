"""Overlap tokens used by text search, relevance scoring and grounding (Q13)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import CJK, WORD
from .text import bind


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def overlap_tokens(c: Column) -> Column:
    """Distinct CJK bigrams, words of two letters or more, short ids and numbers.

    CJK characters are paired across intervening text, as the reference semantics ask:
    the bigrams run over the sequence of ideographs, not over the raw string.
    """
    none = F.array().cast("array<string>")

    def pair_up(cjk: Column) -> Column:
        n = F.size(cjk) - 1
        return F.when(n > 0, F.zip_with(F.slice(cjk, F.lit(1), n), F.slice(cjk, F.lit(2), n), lambda a, b: F.concat(a, b))).otherwise(none)

    bigrams = F.when(c.rlike(f"[{CJK}]"), bind(_all(c, f"[{CJK}]"), pair_up)).otherwise(none)
    low = F.lower(c)
    words = _all(low, "[a-z]{2,}")
    bound_l, bound_r = f"(?<![{WORD}])", f"(?![{WORD}])"
    ids = _all(low, f"{bound_l}[a-z]{{1,6}}[0-9]{{2,8}}{bound_r}")
    drug_ids = _all(low, f"{bound_l}db[0-9]+{bound_r}")
    numbers = _all(c, f"{bound_l}[0-9]{{2,8}}{bound_r}")
    # Most texts hold no digit at all: one cheap test saves three scans.
    numeric = F.when(c.rlike("[0-9]"), F.concat(ids, drug_ids, numbers)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(bigrams, words, numeric))
