"""Scalar text functions on columns. Lengths are in code points unless the name says bytes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The code points that count as white space, as horizontal space, as leading indentation, and as controls.
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
HSPACE = r"[ \t\u00a0\u2000-\u200b\u202f\u205f\u3000]"
INDENT = r"[ \t\u00a0\u2000\u200b\u202f\u205f\u3000-]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, f"\\A{WS}+|{WS}+\\z", "")


def squeeze(text: Column) -> Column:
    """Words joined by one space; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{WS}+", " "))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"{WS}+"), lambda w: w != ""))


def unix_newlines(text: Column) -> Column:
    """CRLF and CR as LF, as reading a file in text mode does."""
    return F.regexp_replace(text, "\r\n?", "\n")


def unicode_normalize(form: str = "NFKC"):
    """An Arrow UDF for a Unicode normal form, which Spark has no function for. ASCII texts pass through."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize(form, t))

    return run


def collapse_lines(text: Column) -> Column:
    """In every line, keep the indentation, make inner runs of horizontal space one space and drop white space at the end."""

    def line(x):
        indent = F.regexp_extract(x, f"\\A({INDENT}*)", 1)
        rest = F.substring(x, F.length(indent) + 1, F.length(x))
        return F.concat(indent, F.regexp_replace(F.regexp_replace(rest, f"{HSPACE}+", " "), f"{WS}+\\z", ""))

    return F.array_join(F.transform(F.split(text, "\n", -1), line), "\n")


def normalize(text: Column, unicode_form: str | None = "NFKC", collapse_whitespace: bool = True, strip_controls: bool = True, max_newlines: int = 2) -> Column:
    """A document in normal form. A cap below 0 leaves runs of line ends; else runs of three or more become max_newlines (1 at least)."""
    if unicode_form:
        text = unicode_normalize(unicode_form)(text)
    if strip_controls:
        text = F.regexp_replace(text, CONTROL, "")
    if collapse_whitespace:
        text = collapse_lines(text)
        if max_newlines >= 0:
            text = F.regexp_replace(text, "\n{3,}", "\n" * max(1, max_newlines))
        text = F.regexp_replace(text, "\\A\n+|\n+\\z", "")
    return text


def looks_like_code(text: Column) -> Column:
    return F.contains(text, F.lit("def ")) | F.contains(text, F.lit("import ")) | (F.contains(text, F.lit("(")) & F.contains(text, F.lit(")")))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 where whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(0.0)
