"""Character classes written once for both regex dialects (Java and RE2)."""

# Every character Python's str.strip() removes.
STRIP_CHARS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Inside a character class: Unicode whitespace and Unicode word characters.
WS = r"\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# The same for Java alone: two ranges turn most characters away before the whole class is tried.
WS_FAST = rf"\x00-\x20\x{{85}}-\x{{3000}}&&[{WS}]"
# White space that is not a single blank already.
LOOSE = f"[{WS_FAST}]{{2,}}|[{WS_FAST}&&[^ ]]"
WORD = r"\p{L}\p{N}_"
CJK = r"\x{4e00}-\x{9fff}"
KANA = r"\x{3040}-\x{30ff}\x{ff65}-\x{ff9f}"


def sql_str(s: str) -> str:
    """SQL literal for the oracle strings."""
    return "'" + s.replace("'", "''") + "'"


SQL_STRIP = sql_str(STRIP_CHARS)
