"""Content hashes and stable buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataloom.functions.text import squeeze


def sha256_text(text: Column) -> Column:
    return F.sha2(text, 256)


def pair_key(instruction: Column, output: Column) -> Column:
    """MD5 of both squeezed texts, a line end between."""
    return F.md5(F.concat(squeeze(instruction), F.lit("\n"), squeeze(output)))


def md5_bucket(text: Column, buckets: int = 1000) -> Column:
    """The MD5 as a 128-bit number, modulo buckets: its four 32-bit words are weighed by 2^96, 2^64, 2^32 and 1 modulo buckets."""
    digest = F.md5(text)
    words = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") * F.lit(pow(2, 96 - 32 * i, buckets)) for i in range(4)]
    return ((words[0] + words[1] + words[2] + words[3]) % buckets).cast("int")


def in_validation(text: Column, val_ratio: float) -> Column:
    if not 0 < val_ratio < 1:
        raise ValueError("val_ratio must lie between 0 and 1")
    return md5_bucket(text) < int(val_ratio * 1000)
