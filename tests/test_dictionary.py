"""Dictionaries and sparse encodings of many values."""

from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from relish.operators import cleaning, dictionary, features, forest


def test_twenty_thousand_values(spark):
    rows = spark.range(20_000).select(F.format_string("t%05d", "id").alias("title"), F.array(F.format_string("v%05d", F.lit(19_999) - F.col("id")), F.lit("w"), F.lit("w")).alias("g"))
    codes = dictionary.build(rows, F.col("g"))
    assert codes.count() == 20_001
    assert codes.agg(F.min(F.struct("code", "value")), F.max(F.struct("code", "value"))).first() == ((0, "v00000"), (20_000, "w"))
    found = dictionary.encode(rows, "title", "g", codes)
    assert found.where(F.concat_ws(",", "codes") != F.concat_ws(",", F.lit(19_999) - F.substring("title", 2, 5).cast("long"), F.lit(20_000))).count() == 0
    encoder = dictionary.Encoder.fit(rows, [], {"g": F.col("g")})
    assert encoder.width == 20_001
    vector = encoder.transform(rows.where("title = 't00007'")).first()["features"]
    assert vector == SparseVector(20_001, {19_992: 1.0, 20_000: 1.0})


def test_unknown_null_and_missing_values(spark):
    train = spark.createDataFrame([("a", ["x", "y", None], "p", 1.0), ("b", [], None, 2.0), ("c", None, "q", 3.0)], "title string, g array<string>, m string, z double")
    encoder = dictionary.Encoder.fit(train, ["z"], {"g": F.col("g"), "m": F.array("m")})
    assert encoder.width == 5
    new = spark.createDataFrame([("a", ["y", "new", "y"], "q", 9.0), ("a", None, "new", 8.0)], train.schema)
    got = sorted((r["z"], r["features"]) for r in encoder.transform(new).collect())
    assert got == [(8.0, SparseVector(5, {0: 8.0})), (9.0, SparseVector(5, {0: 9.0, 2: 1.0, 4: 1.0}))]
    assert encoder.transform(new.limit(0)).count() == 0
    assert sorted(map(tuple, dictionary.encode(train, "title", "g", dictionary.build(train, F.col("g"))).collect())) == [("a", [0, 1]), ("b", []), ("c", [])]


def test_wide_columns_of_the_names_handed_over(spark):
    rows = spark.createDataFrame([("a", ["x", "y"]), ("b", []), ("c", None)], "title string, g array<string>")
    names = dictionary.listed(dictionary.build(rows, F.col("g")))
    wide = cleaning.widen_list(rows, "g", "g_", names)
    assert names == ["x", "y"] and sorted(map(str, wide.select("title", "g_x", "g_y").collect()))[0] == "Row(title='a', g_x=1, g_y=1)"


def test_a_forest_learns_from_sparse_features(spark):
    rows = spark.range(200).selectExpr("concat('t', id) as title", "array(concat('g', id % 7), concat('h', id % 3)) as genres", "concat('r', id % 2) as product_rating",
                                       "concat('p', id % 5) as publisher", "concat('d', id % 4) as developer", "cast(id % 7 as double) as user_score",
                                       "cast(2000 + id % 20 as int) as release_year", "cast(id as double) as log_ratings_count", "cast(25 - id % 20 as int) as game_age")
    encoder = features.sparse_encoder(rows)
    model = forest.forest(numTrees=5, maxDepth=6, featureSubsetStrategy="all").fit(encoder.transform(rows))
    scored = model.transform(encoder.transform(rows))
    assert encoder.width == 3 + 10 + 2 + 5 + 4
    assert scored.agg(F.max(F.abs(F.col("predicted_score") - F.col("user_score")))).first()[0] < 2.5
