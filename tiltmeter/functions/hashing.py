"""Repeatable per-row choice: a hash of the row's own keys instead of a sequential random stream."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_DIGITS = 15
HASH_BITS = 4 * HASH_DIGITS


def portable_hash(*parts) -> Column:
    """First 60 bits of the md5 of the '|'-joined parts, as BIGINT in [0, 2**60)."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in columns]))
    return F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("bigint")


def pick(n: Column, *parts) -> Column:
    """Uniform choice of an index in [0, n), as BIGINT."""
    return F.pmod(portable_hash(*parts), n.cast("bigint"))


def pick_other(n: Column, avoid: Column, *parts) -> Column:
    """Uniform choice of an index in [0, n) other than ``avoid``; NULL if there is no other."""
    shift = 1 + F.pmod(portable_hash(*parts), (n - 1).cast("bigint"))
    return F.when(n > 1, F.pmod(avoid + shift, n.cast("bigint")))
