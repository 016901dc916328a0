"""The parities of two sets never say more tokens apart than there are."""

import numpy as np
from pyspark.sql import functions as F

from relish.llm import jaccard_join


def test_parities_bound_the_tokens_of_one_side(spark):
    rng = np.random.default_rng(5)
    rows = []
    for size, changed in [(1, 0), (1, 1), (30, 2), (146, 10), (146, 40), (2000, 0), (2000, 500)]:
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[changed:], rng.integers(0, 2**63, changed // 2, dtype=np.uint64)]))
        apart, common = len(np.setxor1d(a, b)), len(np.intersect1d(a, b))
        linked = 100 * common >= 80 * (len(a) + len(b) - common)
        rows.append((len(a), jaccard_join._parities(a).tolist(), len(b), jaccard_join._parities(b).tolist(), apart, linked))
    sides = spark.createDataFrame(rows, "na long, a array<long>, nb long, b array<long>, apart int, linked boolean")
    allowed = jaccard_join._parities_allow(F.col("na"), F.col("a"), F.col("nb"), F.col("b"), 80)
    found = sides.select("apart", "linked", allowed.alias("allowed"), F.expr("aggregate(zip_with(a, b, (x, y) -> bit_count(x ^ y)), 0, (s, v) -> s + v)").alias("seen")).collect()
    assert all(r["seen"] <= r["apart"] for r in found)
    assert all(r["allowed"] for r in found if r["linked"])
    assert not all(r["allowed"] for r in found)
