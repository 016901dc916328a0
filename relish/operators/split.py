"""Repeatable train/test splits keyed by a hash of the row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from relish.functions.hashing import bucket
from relish.operators.order import hash_threshold


def is_test(key: Column, percent: int) -> Column:
    """Hash-bucket split: about ``percent`` of the rows are test rows. No shuffle, no state."""
    return bucket(key, 100) < F.lit(percent)


def tenths_test(key: Column, tenths: int = 2) -> Column:
    return bucket(key, 10) < F.lit(tenths)


def exact_ratio_test(df: DataFrame, key: str, ratio: float) -> Column:
    """Exactly floor(n * ratio) rows are test rows: those with the smallest md5 of their key.

    ``key`` must be unique. Only the threshold is searched for; the rows are not sorted.
    """
    digest = F.md5(F.col(key))
    cut = hash_threshold(df, digest, math.floor(df.count() * ratio))
    return F.lit(False) if cut is None else digest <= F.lit(cut)
