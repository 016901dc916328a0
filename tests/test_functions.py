from pyspark.sql import functions as F

from relish.functions import hashing, text, vectors
from relish.operators import cleaning, order


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_md5_seed(spark):
    assert one(spark, hashing.md5_mod(F.lit("minecraft"), 10000)) == 6977


def test_platform_parse(spark):
    literal = """[{'Platform': 'PC', 'Platform Metascore': '88', 'x': None}, {'Platform': "Baldur's", 'Platform Metascore': 'tbd'}]"""
    parsed = text.parse_platforms(F.lit(literal))
    assert one(spark, text.platform_scores(parsed)) == {"PC": 88, "Baldur's": 0}
    quoted = "[{'Platform': 'says: None, ok', 'Platform Metascore': None}]"
    rows = one(spark, text.parse_platforms(F.lit(quoted)))
    assert [(r["platform"], r["metascore"]) for r in rows] == [("says: None, ok", None)]
    for bad in ("garbage[", "[]", "{'Platform': 'PC'}", ""):
        assert one(spark, text.parse_platforms(F.lit(bad))) == []
    assert one(spark, text.parse_platforms(F.lit(None).cast("string"))) == []


def test_platform_last_wins(spark):
    literal = "[{'Platform': 'PC', 'Platform Metascore': '50'}, {'Platform': 'PC', 'Platform Metascore': 61}]"
    assert one(spark, text.platform_scores(text.parse_platforms(F.lit(literal)))) == {"PC": 61}


def test_genres(spark):
    assert one(spark, text.clean_genres(F.lit("Action , RPG,action, ,Beat–’em"))) == ["action", "beat-'em", "rpg"]
    assert one(spark, text.clean_genres(F.lit(None).cast("string"))) == []
    assert one(spark, text.split_genres(F.lit("A,  b,a"))) == ["a", "b", "a"]


def test_titles(spark):
    assert one(spark, text.title_case(F.lit("mario's red-dead 2k22x"))) == "Mario'S Red-Dead 2K22X"
    assert one(spark, text.shorten_title(F.lit("The Elder Scrolls V (2011): Skyrim"))) == "Elder Scrolls V : Skyrim"
    assert one(spark, text.shorten_title(F.lit("The Sims"))) == "The Sims"
    assert one(spark, text.slug(F.lit("Among Us!"))) == "amongus"


def test_years(spark):
    rows = spark.createDataFrame([("2011-11-11",), ("9/15/2011",), ("Oct 3, 2017",), ("TBA",), (None,)], "d string")
    assert [r[0] for r in rows.select(text.parse_year(F.col("d"))).collect()] == [2011, 2011, 2017, None, None]


def test_cosine_without_length(spark):
    zero, some = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, vectors.cosine(zero, some)) is None
    assert one(spark, vectors.cosine(some, some)) == 1.0


def test_median(spark):
    def median(values):
        return order.exact_median(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()[0]
    assert median([1.0, 2.0, 4.0, 9.0]) == 3.0
    assert median([5.0, None, 1.0, 9.0]) == 5.0
    assert median([7.0] * 1000 + [1.0] * 400) == 7.0
    assert median([None]) is None


def test_bucket_other(spark):
    rows = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [("c",), (None,)], "p string")
    got = sorted(r[0] for r in cleaning.bucket_other(rows, "p", 2).collect())
    assert got == ["Other", "Other", "a", "a", "a", "b", "b"]
