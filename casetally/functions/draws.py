"""Repeatable random draws from a hash of the row key.

A draw depends only on the seed and the key: a retried task, another
partitioning or another engine sees the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 4294967296.0


def digest(seed: int | str, *keys) -> Column:
    """Hex digest that orders rows as a seeded shuffle does."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_as_text(k) for k in keys]))


def uniform(seed: int | str, *keys) -> Column:
    """Double in [0, 1) with 32 random bits."""
    return F.conv(F.substring(digest(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(HASH_RANGE)


def digest_sql(seed: int | str, *keys: str) -> str:
    """Hex digest of seed and keys; ``keys`` are SQL expressions."""
    return "md5(concat_ws('|', " + ", ".join([f"'{seed}'", *[f"cast({k} AS string)" for k in keys]]) + "))"


def gaussian_of(hashed: str) -> str:
    """Standard normal draw by Box-Muller over the two halves of a digest."""
    u1, u2 = (f"(cast(conv(substring({hashed}, {at}, 8), 16, 10) AS double) + 0.5D) / {HASH_RANGE!r}D" for at in (1, 9))
    return f"sqrt(-2D * ln({u1})) * cos(2D * pi() * {u2})"


def gaussian_sql(seed: int | str, *keys: str) -> str:
    """Standard normal draw from seed and keys; ``keys`` are SQL expressions."""
    return gaussian_of(digest_sql(seed, *keys))


def pick_sql(n: int, seed: int | str, *keys: str) -> str:
    """Integer in 0..n-1; ``keys`` are SQL expressions."""
    parts = ", ".join([f"'{seed}'", *[f"cast({k} AS string)" for k in keys]])
    return f"(cast(conv(substring(md5(concat_ws('|', {parts})), 1, 8), 16, 10) AS bigint) % {n})"


def _as_text(key) -> Column:
    return (F.col(key) if isinstance(key, str) else key).cast("string")
