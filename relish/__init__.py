"""Recommendation analytics on Spark: cleaning, ranking, models, evaluation and request streams."""
