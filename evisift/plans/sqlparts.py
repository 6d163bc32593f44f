"""Building blocks of the oracle SQL (DuckDB dialect)."""

from __future__ import annotations

from ..functions.chars import CJK, KANA, SQL_STRIP, WORD, WS, sql_str  # noqa: F401

CR, LF, TAB = "chr(13)", "chr(10)", "chr(9)"


def strip(e: str) -> str:
    return f"trim({e}, {SQL_STRIP})"


def squash(e: str) -> str:
    return strip(f"regexp_replace({e}, {sql_str(f'[{WS}]+')}, ' ', 'g')")


def normalize(e: str) -> str:
    e = f"replace({e}, chr(13), chr(10))"
    ctl = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{200b}\x{200c}\x{200d}\x{2060}\x{feff}\x{ad}]"
    e = f"regexp_replace({e}, '{ctl}', '', 'g')"
    e = f"replace(replace({e}, 'ﬁ', 'fi'), 'ﬂ', 'fl')"
    e = f"replace({e}, chr(65533), '')"
    e = rf"regexp_replace({e}, '([{WORD}])-\n([{WORD}])', '\1\2', 'g')"
    e = rf"regexp_replace({e}, '[ \t]+', ' ', 'g')"
    e = rf"regexp_replace({e}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(e)


def hash_tokens(e: str) -> str:
    return f"list_transform(regexp_extract_all({e}, '[A-Za-z0-9]+|[{CJK}]', 0), lambda x: lower(x))"


def overlap_tokens(e: str) -> str:
    """Distinct overlap tokens of a text without CJK (the given tables hold none)."""
    low = f"lower({e})"
    wordish = f"regexp_extract_all({low}, '[{WORD}]+', 0)"
    ids = f"list_filter({wordish}, lambda x: regexp_full_match(x, '[a-z]{{1,6}}[0-9]{{2,8}}|db[0-9]+|[0-9]{{2,8}}'))"
    return f"list_distinct(list_concat(regexp_extract_all({low}, '[a-z]{{2,}}', 0), {ids}))"


def words(e: str) -> str:
    return f"list_filter(string_split({squash(e)}, ' '), lambda x: x <> '')"


def has_run(chars: str, n: int) -> str:
    """RE2 has no backreference: a run of n equal characters is found by comparing neighbours."""
    same = " and ".join(f"{chars}[i + {k}] = {chars}[i]" for k in range(1, n))
    return (
        f"coalesce(list_bool_or(list_transform(range(1, greatest(len({chars}) - {n - 2}, 1)), lambda i: "
        f"{chars}[i] not in (chr(10), chr(13), chr(133), chr(8232), chr(8233)) and {same})), false)"
    )
