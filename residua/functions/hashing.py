"""Keyed, engine-independent pseudo-randomness.

The reference draws from an unseeded global generator.  Here every draw
is a pure function of (seed, key, ...): the first 8 hex digits of an MD5
digest read as an unsigned integer.  It is repeatable under any
partitioning or retry, and DuckDB computes the same number, which makes
the driver's oracle check possible.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 4294967296  # 16 ** 8


def _as_str(c) -> Column:
    if isinstance(c, Column):
        return c.cast("string")
    return F.lit(str(c))


def keyed_hash(*parts) -> Column:
    """Integer in [0, 2**32) from md5 of ``'|'.join(parts)``."""
    digest = F.md5(F.concat_ws("|", *[_as_str(p) for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def keyed_uniform(*parts) -> Column:
    """Double in [0, 1) derived from :func:`keyed_hash`."""
    return keyed_hash(*parts) / F.lit(float(HASH_RANGE))


def keyed_hash_sql(*parts: str) -> str:
    """DuckDB text of the same hash, for oracle SQL."""
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::UBIGINT"
