"""Seeded pseudo-randomness as plain SQL expressions over md5.

A draw depends only on its key, so results do not change with partitioning, retries or
engine. The same formulas can be written in any SQL dialect.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def hash32(*parts: Column | str) -> Column:
    """First 32 bits of the md5 of the parts joined by ``|``."""
    return hex32(F.md5(F.concat_ws("|", *parts)))


def hex32(digest: Column, start: int = 1) -> Column:
    """Eight hex digits of a digest as a number."""
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")


def hash_below(n: int, *parts: Column | str) -> Column:
    """A number 0 .. n-1 from 60 hash bits, for every n by the same rule.

    Never NULL, and declared so: a filter on it is then not repeated below as a NULL check.
    """
    digest = F.md5(F.concat_ws("|", *parts))
    return F.coalesce(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(0).cast("bigint")) % F.lit(n)


def bucket(key: Column, buckets: int) -> Column:
    """Hash bucket of a key, 0 .. buckets-1."""
    return hex32(F.md5(key)) % F.lit(buckets)


def md5_mod(text: Column, modulus: int) -> Column:
    """The whole 128-bit md5 value modulo a small number, folded in 32-bit chunks."""
    digest = F.md5(text)
    rest = F.lit(0).cast("bigint")
    for start in (1, 9, 17, 25):
        rest = (rest * F.lit(2**32 % modulus) + hex32(digest, start)) % F.lit(modulus)
    return rest
