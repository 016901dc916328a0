import json

import numpy as np
from pyspark.sql import functions as F

from relish.functions import wording
from relish.operators import blocks, forest, ncf, popularity, similarity
from relish.operators.features import feature_stages
from relish.plans import naive, requests as R, routing


def means(spark, n):
    return spark.createDataFrame([(f"t{i:03d}", 10.0 - i / 10) for i in range(n)], "game_title string, mean_rating double")


def test_variety_bands(spark):
    targets = spark.createDataFrame([("t000",), ("T000",), ("unknown",)], "target string")
    rows = popularity.variety_picks(targets, means(spark, 50), 5).collect()
    for target in ("t000", "T000", "unknown"):
        picks = [r["game_title"] for r in rows if r["target"] == target]
        order = [f"t{i:03d}" for i in range(50) if f"t{i:03d}" != target.lower()]
        assert len(set(picks)) == 5
        assert len(set(picks) & set(order[:10])) == 4 and len(set(picks) & set(order[10:30])) == 1


def test_variety_fills_from_the_ranking(spark):
    targets = spark.createDataFrame([("t000",)], "target string")
    def picked(n_items, n):
        return {r["game_title"] for r in popularity.variety_picks(targets, means(spark, n_items), n).collect()}
    assert picked(60, 40) == {f"t{i:03d}" for i in range(1, 41)}
    assert picked(4, 5) == {"t001", "t002", "t003"}


def test_naive_request_always_has_five_rows(spark):
    body = [(1, json.dumps({"games": ["t000"]})), (2, "{broken"), (3, json.dumps({"games": ["T001", "x"]}))]
    asked = R.parse(spark.createDataFrame(body, "event_id bigint, body string"))
    for n_items in (2, 4, 50):
        rows = R.answer_naive(asked, means(spark, n_items)).collect()
        for event in (1, 2, 3):
            mine = sorted((r["id"], r["title"]) for r in rows if r["event_id"] == event)
            assert [i for i, _ in mine] == [1, 2, 3, 4, 5]
        assert sorted(r["title"] for r in rows if r["event_id"] == 2) == sorted(t for t, _ in wording.NO_GAMES)
    short = [r["title"] for r in sorted(R.answer_naive(asked, means(spark, 2)).where("event_id = 1").collect(), key=lambda r: r["id"])]
    assert short == ["T001", wording.COMING_SOON[0], *[t for t, _ in wording.GENERIC[:3]]]


def test_parse_defaults(spark):
    body = [(1, "not json"), (2, json.dumps({"username": "a", "modelType": "naive", "games": ["x"], "gameRatings": {"x": 7}}))]
    rows = {r["event_id"]: r for r in R.parse(spark.createDataFrame(body, "event_id bigint, body string")).collect()}
    assert (rows[1]["username"], rows[1]["model_type"], rows[1]["games"], rows[1]["gameRatings"]) == ("anonymous", "Traditional", [], {})
    assert (rows[2]["username"], rows[2]["model_type"], rows[2]["gameRatings"]) == ("a", "Traditional", {"x": 7})


def test_best_cells_match_a_full_sort():
    rng = np.random.default_rng(0)
    scores = rng.integers(0, 6, (40, 30)).astype(float)  # many ties
    scores[3] = np.nan
    keep = rng.integers(1, 35, 40)
    rows, cols, found = blocks.best_cells(scores, keep)
    for r in range(40):
        want = [] if r == 3 else sorted(range(30), key=lambda c: (-scores[r, c], c))[:keep[r]]
        assert cols[rows == r].tolist() == want


def test_wide_blocks_take_their_limit_from_groups(monkeypatch):
    rng = np.random.default_rng(3)
    scores, keep = np.round(rng.normal(size=(50, 1000)), 2), rng.integers(0, 8, 50)
    scores[4], scores[5, 3:] = np.nan, np.nan
    before = scores.copy()
    asked, partition = [], np.partition
    monkeypatch.setattr(np, "partition", lambda a, *args, **kwargs: asked.append(a.shape[1]) or partition(a, *args, **kwargs))
    rows, cols, _ = blocks.best_cells(scores, keep)
    assert asked == [1000 // blocks.GROUP] and np.array_equal(scores, before, equal_nan=True)
    for r in range(50):
        want = sorted(np.flatnonzero(~np.isnan(scores[r])).tolist(), key=lambda c: (-scores[r, c], c))[:keep[r]]
        assert cols[rows == r].tolist() == want


def test_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(blocks, "LEFT_ROWS", 16)
    monkeypatch.setattr(blocks, "RIGHT_BYTES", 8 * 4 * 10)
    monkeypatch.setattr(blocks, "LEFT_PER_TASK", 2)
    monkeypatch.setattr(blocks, "CELLS", 100)
    rng = np.random.default_rng(1)
    left, right = rng.normal(size=(90, 4)), rng.normal(size=(47, 4))
    l = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(left)], "u bigint, vec array<double>")
    r = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(right)], "i bigint, vec array<double>")
    found = blocks.block_candidates(l, "u", "vec", r, "i", "vec", 4, lambda a, b: a @ b.T, F.lit(3))
    got = {(x["u"], x["rank"]): x["i"] for x in blocks.rank_candidates(found, "u", "i", 3).collect()}
    best = np.argsort(-(left @ right.T), axis=1)[:, :3]
    assert got == {(u, k + 1): int(best[u, k]) for u in range(90) for k in range(3)}


def test_blocks_with_an_empty_side(spark):
    some = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.5, 1.0])], "k string, vec array<double>")
    for left, right in ((some.limit(0), some), (some, some.limit(0))):
        found = blocks.block_candidates(left.withColumnRenamed("k", "u"), "u", "vec", right.withColumnRenamed("k", "i"), "i", "vec", 2, lambda a, b: a @ b.T, F.lit(1))
        assert found.columns == ["u", "i", "score"] and found.collect() == []


def test_blocks_that_cannot_win_are_passed_over():
    """The same lists with and without bounds, ties and empty lists included; blocks are skipped and rows leave blocks early."""
    rng = np.random.default_rng(5)
    dense = ncf.hash_dense(4, (6, 5))
    left = rng.normal(size=(40, 8))
    blocks_of = []
    for b in range(12):  # shorter and shorter vectors, every third block repeated, so that scores tie
        vectors = rng.normal(size=(25, 8)) * 4.0 / (b + 1) if b % 3 else (blocks_of[-1][1] if blocks_of else rng.normal(size=(25, 8)) * 4)
        blocks_of.append((np.arange(25) * 12 + b, vectors))
    keep, cells = rng.integers(0, 6, 40), {}
    for name, bound in (("all", None), ("bounded", dense.bounds)):
        cells[name] = 0

        def kernel(a, b):
            cells[name] += len(a) * len(b)
            return dense.all_pairs(a, b)
        found = blocks.search(left, keep, blocks_of, kernel, bound)
        got = sorted(zip(found.rows.tolist(), np.round(-found.scores, 9).tolist(), found.items.tolist()))
        numbers, vectors = (np.concatenate(x) for x in zip(*blocks_of))
        scores = dense.all_pairs(left, vectors)
        want = [(r, round(-scores[r, c], 9), int(numbers[c])) for r in range(40) for c in np.lexsort((numbers, -scores[r]))[: keep[r]]]
        assert got == sorted(want)
    assert cells["bounded"] < 0.7 * cells["all"]
    for _, vectors in blocks_of:
        assert (dense.bounds(left, vectors) + 1e-9 >= dense.all_pairs(left, vectors).max(axis=1)).all()
        salted = np.hstack([vectors, rng.integers(0, 1 << 24, (25, 1))])
        people = np.hstack([left, rng.integers(0, 1 << 24, (40, 1))])
        assert (similarity.cosine_bounds(people, salted) + 1e-9 >= similarity.jittered_cosine(people, salted).max(axis=1)).all()


def items(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 0.1]), ("d", [0.1, 1.0]), ("e", [0.5, 0.5]), ("z", [0.0, 0.0])]
    return spark.createDataFrame([(t, t.upper(), v, f"about {t}") for t, v in rows], "item string, title string, vec array<double>, description string")


def asked(spark, *bodies):
    return R.parse(spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "event_id bigint, body string"))


def test_profile_is_the_weighted_mean(spark):
    rows = asked(spark, {"games": ["A", "b", "nope"], "gameRatings": {"A": 10}}, {"games": ["a"], "gameRatings": {"a": 0}})
    got = similarity.profiles(similarity.owned_titles(rows, "event_id"), items(spark), "event_id", 2).collect()
    assert [(r["event_id"], r["n_known"]) for r in got] == [(0, 2)]
    assert np.allclose(got[0]["vec"], [10 / 15, 5 / 15])


def test_vector_answers(spark):
    rows = asked(spark, {"games": ["A", "b"], "gameRatings": {"A": 9}}, {"games": ["nope"]})
    got = R.answer_vector(rows, items(spark)).collect()
    first = {r["title"]: r["description"] for r in got if r["event_id"] == 0}
    assert set(first) == {"C", "D", "E"}  # owned ones and the one without length are out
    assert first["C"] == "Based on your 9/10 rating of A: about c" and first["D"] == "Based on your 5/10 rating of b: about d"
    assert first["E"].startswith("AI model recommendation (0.")
    assert [r["title"] for r in sorted((r for r in got if r["event_id"] == 1), key=lambda r: r["id"])] == [t for t, _ in wording.VECTOR_DEFAULTS]


def test_a_request_that_owns_everything_gets_three_rows(spark):
    everything = [r["title"] for r in items(spark).select("title").collect()]
    got = R.answer_vector(asked(spark, {"games": everything}), items(spark)).orderBy("id").collect()
    assert [r["title"] for r in got] == [t for t, _ in wording.VECTOR_DEFAULTS[:3]]


def test_empty_ratings_get_popular_titles(spark):
    known = spark.createDataFrame([("ann",)], "user_id string")
    rows = asked(spark, {"username": "ann"}, {"gameRatings": {}}, {"username": "bob"}, {"gameRatings": {"x": 3}})
    routed = routing.route(rows, known)
    assert {r["event_id"]: r["route"] for r in routed.collect()} == {0: "known", 1: "popular", 2: "none", 3: "new"}
    catalog = spark.createDataFrame([("a", 5), ("b", 9), ("c", None), ("d", 9)], "title string, user_ratings_count int")
    got = routing.popular(routed, catalog, 3).orderBy("rank").collect()
    assert [(r["event_id"], r["rank"], r["game_title"]) for r in got] == [(1, 1, "b"), (1, 2, "d"), (1, 3, "a")]


def test_more_genres_than_the_default_vocabulary_are_kept(spark):
    rows = spark.range(300).select(F.transform(F.sequence(F.col("id") * 900, F.col("id") * 900 + 899), lambda g: F.concat(F.lit("g"), g)).alias("genres"))
    assert len(feature_stages()[0].fit(rows).vocabulary) == 270_000


def test_forest_recommend_leaves_liked_titles_out(spark):
    scores = spark.createDataFrame([("Doom", 9.0), (" doom ", 8.5), ("Ico", 8.0), ("Rez", 7.0)], "title string, predicted_score double")
    rows = spark.createDataFrame([(1, ["DOOM"]), (2, ["doom", "ico", "rez"]), (3, []), (4, ["other"] * 9)], "event_id bigint, games array<string>")
    got = {}
    for r in forest.recommend(rows, scores, n=2).collect():
        got.setdefault(r["event_id"], {})[r["rank"]] = (r["title"], r["description"])
    assert got[1] == {1: ("Ico", "Predicted Score: 8.00"), 2: ("Rez", "Predicted Score: 7.00")}
    for event in (2, 3, 4):  # 2 likes everything, so the full set is used
        assert [got[event][i][0] for i in (1, 2)] == ["Doom", " doom "]


def test_search_draws_are_distinct():
    draws = forest.draw_params(forest.SEARCH_SPACE, 10)
    assert len({tuple(d.items()) for d in draws}) == 10 and draws == forest.draw_params(forest.SEARCH_SPACE, 10)


def test_naive_evaluation_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(f"u{rng.integers(12)}" if rng.random() > 0.33 else "hot", f"g{rng.integers(25):02d}", float(rng.integers(0, 11)), bool(rng.random() < 0.3))
            for _ in range(400)]
    table = spark.createDataFrame(rows, "user_id string, game_title string, rating double, is_test boolean")
    got = naive.evaluate(table, F.col("is_test"), 5).first()
    train, test = [r for r in rows if not r[3]], [r for r in rows if r[3]]
    overall = np.mean([r[2] for r in train])
    mean = {g: np.mean([r[2] for r in train if r[1] == g] or [overall]) for g in {r[1] for r in rows}}
    err = [(r[2] - mean[r[1]]) ** 2 for r in test]
    aps, ndcgs = [], []
    for user in {r[0] for r in train}:
        actual = [r[1] for r in test if r[0] == user]
        if not actual:
            continue
        seen = {r[1] for r in train if r[0] == user}
        top = sorted((g for g in mean if g not in seen), key=lambda g: (-mean[g], g))[:5]
        hit = [1 if g in actual else 0 for g in top]
        aps.append(sum(sum(hit[:i + 1]) / (i + 1) for i in range(len(hit)) if hit[i]) / min(len(actual), 5))
        dcg = [sum(x / np.log2(i + 2) for i, x in enumerate(h)) for h in (hit, sorted(hit, reverse=True))]
        ndcgs.append(dcg[0] / (dcg[1] or 1))
    assert np.isclose(got["mse"], np.mean(err)) and np.isclose(got["map_k"], np.mean(aps)) and np.isclose(got["ndcg_k"], np.mean(ndcgs))


def test_pruned_forests(spark):
    """No inner node under the minimum, everything else as it was, scores as walked by a plain loop."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import Vectors
    from relish.session import scratch_dir
    rows = spark.createDataFrame([(f"t{i}", Vectors.dense(i % 13, (i * 7) % 11, i % 2), float((i * 31) % 17)) for i in range(300)], ["title", "features", "user_score"])
    whole = forest.forest(numTrees=3, maxDepth=7).fit(rows)
    tables = {}
    for least in (2, 15, 60, 1000):
        model, path = forest.forest(numTrees=3, maxDepth=7, minRowsToSplit=least).fit(rows), scratch_dir(spark, "f")
        model.write().save(path)
        nodes = forest.nodes_of(spark, path).collect()
        tables[least] = {(n.treeID, n.id): n for n in nodes}
        assert all(n.rows >= least for n in nodes if n.left >= 0) and len(nodes) == model.totalNumNodes
        walked = {r.title: r.predicted_score for r in forest.scores_by_nodes(rows, forest.nodes_of(spark, path)).collect()}
        for r in model.transform(rows).select("title", vector_to_array("features").alias("f"), "predicted_score").collect():
            total = 0.0
            for tree in range(3):
                n = tables[least][tree, 0]
                while n.left >= 0:
                    n = tables[least][tree, n.left if r.f[n.feature] <= n.threshold else n.right]
                total += n.prediction / 3
            assert abs(total - r.predicted_score) < 1e-9 and abs(walked[r.title] - total) < 1e-9
    assert len(tables[2]) == whole.totalNumNodes > len(tables[15]) > len(tables[60]) > len(tables[1000]) == 3


def test_search_over_the_least_rows_of_a_split(spark):
    rows = spark.range(150).selectExpr("concat('t', id) as title", "array(concat('g', id % 3)) as genres", "concat('r', id % 2) as product_rating", "concat('p', id % 3) as publisher",
                                       "concat('d', id % 2) as developer", "cast(id % 5 as double) as user_score", "cast(2000 + id % 9 as int) as release_year",
                                       "cast(id as double) as log_ratings_count", "cast(25 - id % 9 as int) as game_age")
    model, errors = forest.random_search(rows, {"numTrees": [2], "maxDepth": [4], "minRowsToSplit": [2, 40, 200]}, draws=3, folds=2)
    assert len(errors) == 3 and forest.score(model, rows).count() == 150
    assert forest.SEARCH_SPACE["minRowsToSplit"] == [2, 5, 10]
