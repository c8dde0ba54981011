"""Column functions on words: which text is shown, and how it is compared."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from wordreel import fixed

SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
         "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(_col(c), F.lit(SPACE))


def first_text(*cols: str | Column) -> Column:
    """The first column that is neither missing nor empty; '' if none is."""
    return F.coalesce(*[F.nullif(_col(c), F.lit("")) for c in cols], F.lit(""))


def display_text() -> Column:
    """Written form of a word: romanized, else as spoken, else original script."""
    return first_text("hinglish", "text", "devanagari")


def clean_token(c: str | Column) -> Column:
    """Lower-case token without punctuation at its ends."""
    return F.lower(F.btrim(strip(c), F.lit(fixed.EDGE_PUNCTUATION)))


def norm_token(c: str | Column) -> Column:
    """Lower-case letters, digits and underscores only; combining marks go too."""
    return strip(F.regexp_replace(F.lower(_col(c)), r"[^\p{L}\p{N}_\s]", ""))


def ends_clause(c: str | Column) -> Column:
    return F.right(strip(c), F.lit(1)).isin(list(fixed.CLAUSE_PUNCTUATION))


def has_devanagari(c: str | Column) -> Column:
    return _col(c).rlike(r"[\u0900-\u097F]")


def xml_escape(c: str | Column) -> Column:
    out = _col(c)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def base_name(c: str | Column) -> Column:
    """Part of a path after its last slash."""
    return F.substring_index(_col(c), "/", -1)


def pad(number: Column, width: int) -> Column:
    """Zero-padded whole number, never cut when it is wider."""
    text = number.cast("bigint").cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def hundredths(ms: Column) -> Column:
    """Milliseconds as seconds with two decimals, half up, from whole numbers."""
    cs = F.floor((ms + 5) / 10).cast("bigint")
    return F.concat(F.floor(cs / 100).cast("string"), F.lit("."), pad(cs % 100, 2))


def tenths(ms: Column) -> Column:
    ds = F.floor((ms + 50) / 100).cast("bigint")
    return F.concat(F.floor(ds / 10).cast("string"), F.lit("."), (ds % 10).cast("string"))
