"""Column-expression helpers for text. All JVM-side (no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.isspace`` treats as whitespace,
# written as a Java regex class (\x{..} escapes also parse in RE2/DuckDB).
PY_WHITESPACE_CLASS = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)

# The same set without the newline (whitespace inside one line).
PY_LINE_WHITESPACE_CLASS = PY_WHITESPACE_CLASS.replace(r"\t\n", r"\t")

# Word tokens for lexical vectors: maximal runs of Unicode letters.
TOKEN_SPLIT = r"[^\p{L}]+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# The same set as a plain string of characters (for btrim).
PY_WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def py_strip(col) -> Column:
    """``str.strip()`` with Python's whitespace set. ``btrim`` with an explicit
    character set is a plain scan of both ends (no regex), and unlike the
    one-argument form it is not limited to spaces."""
    return F.btrim(_c(col), F.lit(PY_WHITESPACE_CHARS))


def is_blank(col) -> Column:
    return py_strip(col) == F.lit("")


def tokens(col) -> Column:
    """Lower-cased letter runs as an array; empty pieces dropped."""
    parts = F.split(F.lower(_c(col)), TOKEN_SPLIT)
    return F.array_remove(parts, "")


def preview(col, n: int = 500, suffix: str = "...") -> Column:
    """First ``n`` characters, plus ``suffix`` only when the text is longer."""
    c = _c(col)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(suffix))).otherwise(c)


def file_ext(name) -> Column:
    """Text after the last '.' of the lower-cased name; a name without a dot
    is its own extension."""
    return F.element_at(F.split(F.lower(_c(name)), r"\."), -1)


# The line boundaries of Python's ``str.splitlines``.
LINE_BOUNDARY = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"

# JavaScript's white space (``\s``, ``String.trim``) as a regex class
# and as characters.
JS_WHITESPACE_CLASS = (r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}"
                       r"\x{3000}\x{FEFF}]")
JS_WHITESPACE_CHARS = ("\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
                       "\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff")


def js_trim(col) -> Column:
    return F.btrim(_c(col), F.lit(JS_WHITESPACE_CHARS))


def readable(col) -> Column:
    """Readable spacing: lines are stripped and cut at double spaces; the
    stripped pieces that are left are joined with single spaces."""
    pieces = F.flatten(F.transform(F.split(_c(col), LINE_BOUNDARY), lambda line: F.split(py_strip(line), "  ")))
    return F.array_join(F.array_remove(F.transform(pieces, py_strip), ""), " ")
