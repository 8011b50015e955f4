"""Keyed hashes: the only source of randomness in the library.

A seeded shuffle cannot be reproduced across tasks, a hash of (seed, key) can.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def hash60(*parts) -> Column:
    """First 60 bits of the md5 of the concatenated parts, as a non-negative long."""
    digest = F.md5(F.concat(*[_text(p) for p in parts]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def run_identity(*fields) -> Column:
    """First 24 hex digits of the SHA-256 of the '|'-joined fields."""
    return F.substring(F.sha2(F.concat_ws("|", *[_text(f) for f in fields]), 256), 1, 24)


def problem_identity(dataset, index, text) -> Column:
    """``dataset_00042_<first 12 hex of sha256(text)>``."""
    return F.concat(
        _text(dataset), F.lit("_"), F.lpad(_text(index), F.greatest(F.length(_text(index)), F.lit(5)), F.lit("0")), F.lit("_"),
        F.substring(F.sha2(_text(text), 256), 1, 12),
    )
