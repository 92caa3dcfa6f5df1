"""Masking of personal data and secrets: classes are masked one after another, each on the text that the ones before left."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The classes, in the order in which they are masked.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"(?<!\d)(?:\+?\d[\d .()-]{7,}\d)(?!\d)",
    "ipv4": r"(?<!\d)(?:\d{1,3}\.){3}\d{1,3}(?!\d)",
    "private_key": r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----",
    "aws_key": r"AKIA[0-9A-Z]{16}",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "api_assignment": r"(?i)(api[_-]?key|secret|password|passwd|pwd|bearer)\s*[:=]\s*['\"]?\S+['\"]?",
    "generic_secret": r"(?i)(token|credential)s?\s*[:=]\s*['\"]?\S{8,}['\"]?",
}

#: What a text has to contain, one of these at least, for a class to be found in it; classes that aren't here are looked for in every text.
NEEDED = {"email": ["@"], "ipv4": ["."], "private_key": ["-----BEGIN "], "aws_key": ["AKIA"], "github_token": ["gh"], "api_assignment": [":", "="], "generic_secret": [":", "="]}


def scrub(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the text masked, and hits_<class>: how often each class was masked."""
    for name, pattern in PATTERNS.items():
        text, unicode = F.col(text_col), f"(?U){pattern}"  # digits, white space and case are those of Unicode
        # both columns read the text that the class before left, so no class is masked twice over
        found, masked = F.regexp_count(text, F.lit(unicode)), F.regexp_replace(text, unicode, f"<|{name}|>")
        if name in NEEDED:
            without = reduce(Column.__and__, [~F.contains(text, F.lit(x)) for x in NEEDED[name]])
            found, masked = F.when(without, F.lit(0)).otherwise(found), F.when(without, text).otherwise(masked)
        docs = docs.withColumns({f"hits_{name}": found, text_col: masked})
    return docs


def hits_map() -> Column:
    """The classes that were hit, with their counts."""
    entries = F.array(*[F.struct(F.lit(n).alias("key"), F.col(f"hits_{n}").cast("long").alias("value")) for n in PATTERNS])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0))


def totals(scrubbed: DataFrame) -> DataFrame:
    """class, hits: over all documents, classes without a hit left out."""
    sums = scrubbed.agg(*[F.sum(f"hits_{n}").alias(n) for n in PATTERNS])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("class"), F.col(n).alias("hits")) for n in PATTERNS])).alias("e")).select("e.*").where("hits > 0")
