import math

from pyspark.sql import functions as F

from relish.operators import order, sampling, split


def test_dense_positions_do_not_depend_on_partitions(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"))
    for n in (1, 7):
        placed = order.dense_positions(rows.repartition(n), [F.col("v").desc()], "pos").collect()
        assert sorted((r["pos"], r["v"]) for r in placed) == [(i, 999 - i) for i in range(1000)]


def test_running_total(spark):
    rows = spark.range(500).select("id", (F.col("id") % 7).alias("n"))
    got = {r["id"]: r["cum"] for r in order.running_total(rows, [F.col("id").asc()], "n", "cum").collect()}
    total = 0
    for i in range(500):
        total += i % 7
        assert got[i] == total


def test_exact_ratio(spark):
    rows = spark.range(12_345).select(F.col("id").cast("string").alias("k"))
    for ratio in (0.0, 0.2, 0.65, 1.0):
        cut = split.exact_ratio_test(rows, "k", ratio)
        assert rows.where(cut).count() == math.floor(12_345 * ratio)


def test_threshold_narrows_until_the_bucket_is_small(spark):
    rows = spark.range(5000).select(F.md5(F.col("id").cast("string")).alias("h"))
    want = sorted(r["h"] for r in rows.collect())
    for take in (1, 777, 5000):
        assert order.hash_threshold(rows, F.col("h"), take, digits=1, small=3) == want[take - 1]


def test_shuffle_is_a_permutation(spark):
    for n in (1, 2, 97, 100):
        s = sampling.Shuffle(n, "x")
        rows = (spark.range(5).select(F.col("id").cast("string").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(s.p - 1))).alias("pos"))
                .withColumn("item", s.item(s.start(F.col("k")), s.stride(F.col("k")), F.col("pos"))).where(F.col("item") < n))
        per_key = rows.groupBy("k").agg(F.array_sort(F.collect_list("item")).alias("i")).collect()
        assert all(r["i"] == list(range(n)) for r in per_key)


def test_items_per_key(spark):
    keys = spark.range(300).select(F.col("id").cast("string").alias("k"))
    for k, n in ((9, 50), (9, 4), (1, 1)):
        got = sampling.sample_items_per_key(keys, "k", k, n, "s").groupBy("k").agg(
            F.count("*").alias("c"), F.countDistinct("item_idx").alias("d"), F.max("item_idx").alias("m")).collect()
        assert len(got) == 300 and all(r["c"] == r["d"] == min(k, n) and r["m"] < n for r in got)


def _unseen(seen, n, k):
    return {u: [i for i in range(n) if i not in s][:k] for u, s in seen.items()}


def test_first_unseen_with_a_hot_user(spark, monkeypatch):
    monkeypatch.setattr(sampling, "_CHUNK", 16)  # the hot user's span is cut many times
    n, k = 400, 5
    seen = {u: {(u * 31 + j * j) % n for j in range(u % 9 + 1)} for u in range(60)}
    seen[1000] = set(range(398))       # has seen nearly everything
    seen[1001] = set(range(n))         # has seen everything
    rows = spark.createDataFrame([(u, i) for u, s in seen.items() for i in s], "u bigint, i bigint")
    got = {}
    for r in sampling.first_unseen(rows, "u", "i", k, n).collect():
        got.setdefault(r["u"], {})[r["rank"]] = r["i"]
    want = {u: items for u, items in _unseen(seen, n, k).items() if items}
    assert {u: [v[i + 1] for i in range(len(v))] for u, v in got.items()} == want


def test_sampled_negatives_are_exact(spark):
    n, k = 101, 20
    seen = {u: {(u * 7 + j) % n for j in range(u)} for u in range(1, n + 1)}
    rows = spark.createDataFrame([(u, i) for u, s in seen.items() for i in s], "u bigint, i bigint")
    got = {}
    for r in sampling.first_unseen(rows, "u", "i", k, n, sampling.Shuffle(n, "t")).collect():
        got.setdefault(r["u"], []).append(r["i"])
    for u, s in seen.items():
        mine = got.get(u, [])
        assert len(mine) == len(set(mine)) == min(k, n - len(s)) and not set(mine) & s


def test_places_looked_at_do_not_grow_with_what_was_seen_late(spark, monkeypatch):
    seen = spark.createDataFrame([("a", i) for i in range(500, 900)] + [("a", 1), ("a", 402)] + [("b", i) for i in range(3)] + [(None, 0)], "u string, i bigint")
    looked, spots = [], sampling._spots

    def counted(*args, **kwargs):
        looked.append(spots(*args, **kwargs))
        return looked[-1]
    monkeypatch.setattr(sampling, "_spots", counted)
    got = {(r["u"], r["rank"], r["i"]) for r in sampling.first_unseen(seen, "u", "i", 3, 1000).collect()}
    assert got == {("a", 1, 0), ("a", 2, 2), ("a", 3, 3), ("b", 1, 3), ("b", 2, 4), ("b", 3, 5), (None, 1, 0), (None, 2, 1), (None, 3, 2)}
    assert looked[0].count() <= 3 * 3 + 5  # three places a key, and one for each early item
