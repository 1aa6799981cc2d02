"""Reproducible pseudo-random order and numbers, independent of partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HASH_SPACE = 1 << 32


def row_hash(cols: list[str], seed: int = 42) -> Column:
    """Hash of the whole row in [0, 2**32); equal rows share a hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in cols]), F.lit(HASH_SPACE))


def key_hash(key: str | Column, seed: int = 42) -> Column:
    """Multiplicative hash of an integer key in [0, 2**32), easy to state in any SQL.

    The key is first reduced modulo 2**31 so that the product stays in a BIGINT
    for keys of any size.
    """
    col = F.col(key) if isinstance(key, str) else key
    reduced = F.pmod(col.cast("long"), F.lit(1 << 31))
    return F.pmod(reduced * F.lit(2654435761) + F.lit(seed), F.lit(HASH_SPACE))


def uniform(*parts: Column | int | str) -> Column:
    """Number in [0, 1) determined by ``parts`` (53 bits of a 64-bit hash)."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") * F.lit(2.0 ** -53)
