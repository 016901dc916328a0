"""What a plan does once, and what moves, whatever the size of its tables."""

import numpy as np
import pytest

from relish.operators import lookup, ncf
from relish.queries import QUERIES, load_all
from relish.sources import warehouse

PARTS = "p_partkey bigint, p_name string, p_type string, p_brand string, p_size int"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture()
def parts(spark, tmp_path):
    rows = [(i, f"p{i}", "t", "b", i % 50 + 1) for i in range(90)]
    spark.createDataFrame(rows, PARTS).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_platforms_are_parsed_once(spark, parts):
    load_all()
    df = QUERIES["platform_map"](spark, parts)
    assert plan_of(df).count("from_json") == 1
    got = {(r.title, r.platform): r.score for r in df.collect()}
    assert got["p1 1", "PC"] == 47 and got["p1 1", "Xbox"] == 32 and got["p5 5", "PC"] == 0
    assert not any(title in ("p37 37", "p41 41") for title, _ in got)
    assert warehouse.catalog(spark, parts).count() == 90


def test_a_rating_moves_once_for_each_side_and_nothing_is_broadcast(spark):
    rows = [("a", "u1", "g1", 5.0), ("a", "u1", "g1", 5.0), ("b", "u2", "g2", 1.0), ("c", None, "g1", 2.0), ("d", "u1", None, 2.0),
            ("e", "u1", "g2", None), (None, "u1", "g2", 3.0), ("f", "u9", "g2", 3.0), ("g", "u2", "g9", 3.0)]
    ratings = spark.createDataFrame(rows, "row_key string, user_id string, game_title string, rating double")
    users = spark.createDataFrame([("u1", 0), ("u2", 1)], "user_id string, user_idx bigint")
    items = spark.createDataFrame([("g1", 0), ("g2", 1), ("g3", 2)], "game_title string, game_idx bigint")
    uf, vf = ncf.hash_factors(users.select("user_idx"), "user_idx", "u", 2), ncf.hash_factors(items.select("game_idx"), "game_idx", "v", 2)
    dense, drawn = ncf.hash_dense(2, (3, 2)), [("a", 2), ("b", 0)]
    found = ncf.rated_factors(ratings, users, items, uf, vf)
    assert sorted(found.select("row_key", "user_idx", "game_idx", "rating").collect()) == sorted(lookup.interactions(ratings, users, items).collect())
    negs = spark.createDataFrame(drawn, "row_key string, neg_idx bigint")
    both = ncf.score_both(found.join(negs.hint("merge"), "row_key"), uf, vf, dense)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 3
    got = {(r.row_key, round(r.pos, 9), round(r.neg, 9)) for r in both.collect()}

    def vec(table, idx):
        r = table.collect()[idx]
        return [[r.gmf]], [[r.mlp]]

    def score(u, v):
        (ug, um), (vg, vm) = vec(uf, u), vec(vf, v)
        return round(float(dense.forward(*(np.array(x[0]) for x in (ug, vg, um, vm)))[0]), 9)
    assert got == {("a", score(0, 0), score(0, 2)), ("b", score(1, 1), score(1, 0))}
