"""Quality classifier: a sparse ensemble of rules over text statistics.

Trees grown on the statistics give rules, each the conjunction of the thresholds on a path; a logistic model with a
lasso penalty weighs them, and the rules with a weight are compiled into Spark column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F, types as T

from relish.llm import arrowtext, prefilter, texthash
from relish.session import materialize

STATISTICS = ("n_bytes", "n_words", "mean_word", "upper_share", "digit_share", "symbol_share", "space_share", "mark_share", "ends_marked",
              "distinct_share", "repeated_share", "top_word_share", "shingle_share", "words_a_line", "line_share")
ADDED = {f"stat_{s}": T.DoubleType() for s in STATISTICS}
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[list(b".,;:'\"-()?")] = True
_ASCII = np.zeros(256, dtype=bool)
_ASCII[33:127] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_SYMBOL = _ASCII & ~_PUNCTUATION & ~_LETTER & ~_DIGIT


def statistics(data: memoryview | bytes) -> tuple[float, ...]:
    """The statistics of one text, in the order of ``STATISTICS``; all 0 for a text without words."""
    raw = np.frombuffer(data, dtype=np.uint8)
    text = texthash.lower(data)
    starts, ends = texthash.words(text, texthash.SPACED)
    n = len(starts)
    if not n:
        return (float(len(raw)), *[0.0] * (len(STATISTICS) - 1))
    counts = np.bincount(raw, minlength=256)
    letters, size = max(1, int(counts[_LETTER].sum())), len(raw)
    hashes = texthash.stretches(texthash.prefix_sums(text), starts, ends - starts)
    _, per_word = np.unique(hashes, return_counts=True)
    last = raw[ends - 1]
    shingles = texthash.shingles(hashes, min(3, n))
    lines = int(counts[10]) + 1
    # a title's capital is no shouting: capitals are counted beyond a word's first letter
    inner = int(counts[65:91].sum()) - int(((raw[starts] >= 65) & (raw[starts] < 91)).sum())
    return (float(size), float(n), float((ends - starts).mean()), inner / letters, counts[_DIGIT].sum() / size, counts[_SYMBOL].sum() / size,
            1 - (ends - starts).sum() / size, counts[_PUNCTUATION].sum() / size, float(_SYMBOL[last].mean()), len(per_word) / n,
            float((hashes[1:] == hashes[:-1]).mean()) if n > 1 else 0.0, per_word.max() / n, len(np.unique(shingles)) / len(shingles), n / lines, lines / n)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a ``stat_*`` column for each statistic; all other columns stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrowtext.free_kept()
        for batch in batches:
            found = np.array([statistics(t) for t in arrowtext.texts(batch, text)], dtype=np.float64).reshape(-1, len(STATISTICS))
            yield arrowtext.append(batch, {name: pa.array(found[:, i]) for i, name in enumerate(ADDED)})
    return docs.mapInArrow(run, arrowtext.extended(docs.schema, ADDED))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above, threshold) and its weight."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [F.col(n) > t if above else F.col(n) <= t for n, above, t in self.terms])


@dataclass(frozen=True)
class RuleModel:
    """``score`` of a row with the statistics: the logistic of the intercept and the weights of the rules that hold."""

    intercept: float
    rules: tuple[Rule, ...] = field(default=())

    def score(self) -> Column:
        total = reduce(lambda a, b: a + b, [F.when(r.column(), r.weight).otherwise(0.0) for r in self.rules], F.lit(self.intercept))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _paths(node, terms: tuple = ()) -> Iterator[tuple[tuple[str, bool, float], ...]]:
    """Every inner and outer node of a tree below the root, as the conditions that lead to it."""
    if terms:
        yield terms
    if node.subtreeDepth() > 0:
        name, threshold = list(ADDED)[node.split().featureIndex()], node.split().threshold()
        yield from _paths(node.leftChild(), (*terms, (name, False, threshold)))
        yield from _paths(node.rightChild(), (*terms, (name, True, threshold)))


def fit(rows: DataFrame, label: str = "label", trees: int = 12, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> RuleModel:
    """Learn from all rows with statistics and a 0/1 ``label``; other or NULL labels are left out.

    With one class or no rows the score is the share of label 1 (one half without rows).
    """
    known = rows.select(F.col(label).cast("double").alias("label"), *ADDED).filter("label in (0.0, 1.0)")
    held = materialize(VectorAssembler(inputCols=list(ADDED), outputCol="features").transform(known).select("label", "features", *ADDED), "labelled")
    n, ones = held.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if ones in (0, n):
        share = (ones + 0.5) / (n + 1)
        return RuleModel(float(np.log(share / (1 - share))))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.7, featureSubsetStrategy="onethird").fit(held)
    terms = list(dict.fromkeys(path for tree in forest.trees for path in _paths(tree._java_obj.rootNode())))
    inputs = [Rule(t).column().cast("double").alias(f"rule_{i}") for i, t in enumerate(terms)]
    names = [f"rule_{i}" for i in range(len(terms))]
    held_rules = VectorAssembler(inputCols=names, outputCol="features").transform(held.select("label", *inputs)).select("label", "features")
    model = LogisticRegression(regParam=penalty, elasticNetParam=1.0, maxIter=60, standardization=False).fit(materialize(held_rules, "rules"))
    return RuleModel(float(model.intercept), tuple(Rule(t, float(w)) for t, w in zip(terms, model.coefficients, strict=True) if w))


def learn(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", held_out: int | None = 0, **settings) -> RuleModel:
    """Learn from the labelled documents of the folds that are not held out (crc32 of the id as text, modulo 5).

    Only statistics are inputs.  Unlabelled documents, NULL ids and NULL labels teach nothing; a document labelled twice
    counts twice.
    """
    marks = labels.select(F.col(doc_id).alias("labelled_id"), F.col(label).alias("label"))
    if held_out is not None:
        marks = marks.filter(fold("labelled_id") != held_out)
    return fit(stats.select(F.col(doc_id).alias("stat_id"), *ADDED).join(marks, F.col("stat_id") == F.col("labelled_id")), **settings)


def fold(doc_id: str) -> Column:
    """Fold 0 .. 4 of a document; a NULL id is an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3, **settings) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each document; ``held_out`` ones (fold 0) are never learned from.

    NULL and empty texts have a score as any other, from statistics that are 0.  Repeated rows and NULL ids stay; other
    columns are ignored; no documents, no result.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    stats = materialize(with_statistics(slim).select("doc_id", *ADDED), "statistics")
    model = learn(stats, labels.withColumnRenamed(doc_id, "doc_id"), **settings)
    scored = stats.select("doc_id", (fold("doc_id") == 0).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3, **settings) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their own columns, whatever their names.

    Learns as ``score_quality`` does.  Statistics are worked out twice, to learn and to judge, as they are cheaper than a
    shuffle of the labelled texts; only numbers are joined with the labels.  NULL and empty
    texts are judged as any other, from statistics that are 0; very long texts are read whole; repeated rows and NULL ids
    stay or go each by its text; no documents, no rows; without labels the score is one half, so all rows stay.
    """
    inner, back = prefilter.aside(docs, ADDED)
    slim = inner.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    model = learn(with_statistics(slim).select("doc_id", *ADDED), labels.withColumnRenamed(doc_id, "doc_id"), **settings)
    return back(with_statistics(inner, text).filter(model.score() >= threshold))
