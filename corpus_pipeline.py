"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from relish.llm import arrowtext, decontaminate, jaccard_join, line_dedup, packing, prefilter, rule_ensemble
from relish.session import materialize

#: whole texts, and shingle sets as large as they, that go to a worker at a time
TEXTS = 512


# All stages but the last return the rows they keep with their own columns, whatever their names; repeated rows and NULL
# ids are rows as any other; a text is read whole, however long; no rows, no result.


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject; NULL and empty texts are judged by statistics that are 0."""
    return rule_ensemble.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that stand on over a tenth of their source's documents; ``n_chars`` counts anew.

    A NULL text stays NULL, a text whose lines all go becomes empty, and a NULL source is one source.
    """
    inner, back = prefilter.aside(docs, ["n_lines", "n_dropped"])
    return back(line_dedup.drop_site_lines(inner).withColumn("n_chars", F.length("text").cast("long")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near copies; without words, or without an id, a row stays.

    Rows of a kept id all stay, repeated ones included.
    """
    return jaccard_join.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in benchmark passages; a NULL or empty text stays."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    inner, back = prefilter.aside(docs, ["n_words", "hits", "n_hit", "n_items", "items_sha256", "contaminated"])
    return back(decontaminate.judge(decontaminate.find_items(inner, items)).filter(~F.col("contaminated")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens; a NULL text is empty and has its end token alone."""
    import public_tokenizers

    return packing.pack(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("decontamination", benchmark), ("packing", pack)]

#: SQL cannot state the classifier and the tokenizer; tests compare the stages with plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with arrowtext.batches(spark, TEXTS):
        for name, stage in STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
