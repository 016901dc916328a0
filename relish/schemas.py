"""Declared schemas of every source; nothing is inferred."""

from pyspark.sql import types as T

REVIEWS = T.StructType([
    T.StructField("Reviewer Name", T.StringType()),
    T.StructField("Game Title", T.StringType()),
    T.StructField("Rating Given By The Reviewer", T.DoubleType()),
    T.StructField("Review Text", T.StringType()),
])

RATINGS = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("game_title", T.StringType()),
    T.StructField("rating", T.DoubleType()),
])

CATALOG = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("release_date", T.StringType()),
    T.StructField("genres", T.StringType()),
    T.StructField("product_rating", T.StringType()),
    T.StructField("publisher", T.StringType()),
    T.StructField("developer", T.StringType()),
    T.StructField("user_score", T.StringType()),
    T.StructField("user_ratings_count", T.LongType()),
    T.StructField("platforms_info", T.StringType()),
])

PLATFORMS = T.ArrayType(T.StructType([
    T.StructField("Platform", T.StringType()),
    T.StructField("Platform Metascore", T.StringType()),
]))

REQUEST = T.StructType([
    T.StructField("action", T.StringType()),
    T.StructField("username", T.StringType()),
    T.StructField("modelType", T.StringType()),
    T.StructField("games", T.ArrayType(T.StringType())),
    T.StructField("gameRatings", T.MapType(T.StringType(), T.IntegerType())),
    T.StructField("count", T.IntegerType()),
    T.StructField("_retryCount", T.IntegerType()),
])

TITLE_LIST = T.StructType([T.StructField("gameTitles", T.ArrayType(T.StringType()))])

MAPPING = T.MapType(T.StringType(), T.LongType())
