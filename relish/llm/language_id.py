"""Language of a text: sparse multinomial logistic regression on TF-IDF weighted character n-grams.

1. A text's letters in lower case, with one space for whatever stands between words, give n-grams of 1 to 4 characters, hashed
   to ``2 ** bits`` buckets.  A bucket weighs (1 + ln count) ln((1 + texts) / (1 + texts that hold it)), and a text's weights
   have length 1.  Texts are counted over the whole training corpus.
2. The weights of the classes are learned by the regularised leader (follow-the-regularized-leader, proximal) with an L1 and an
   L2 penalty on a sample of ``per_language`` different texts of each language or thereabouts.  Its shards are learned from
   at the same time and their states averaged after each pass; one shard is the plain sequential method.
3. A fifth of the sample is not learned from; a temperature that makes it likeliest divides all scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from relish.llm import arrowtext
from relish.session import materialize

LONGEST = 4
#: characters that are worked on at once; longer texts are added up
STRETCH = 1 << 19
#: bytes of text that one shard learns from, buckets of a piece of the state that travels
SHARD_BYTES, PIECE = 16 << 20, 1 << 12
#: inverse temperatures that are tried first, then as many between the neighbours of the best
TRIED = np.geomspace(1 / 16, 64, 41)

_MULTIPLIER, _FINISH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _buckets(codes: np.ndarray, bits: int, new: int) -> Iterator[np.ndarray]:
    """Buckets of the n-grams that end in the last ``new`` characters."""
    points = codes.astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(points) + 1, dtype=np.uint64)
    for n in range(1, LONGEST + 1):
        h = (h[:-1] + points[n - 1 :]) * _MULTIPLIER
        if not len(h):
            return
        own = h[max(0, len(h) - new) :] + np.uint64(n)
        yield (((own ^ (own >> np.uint64(29))) * _FINISH) >> np.uint64(64 - bits)).astype(np.uint32)


def grams(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's n-grams, ascending, and their counts; none for a text without a letter."""
    whole, tail = None, np.array([32], dtype=np.uint32)
    for at in range(0, len(text), STRETCH):
        codes = np.frombuffer(text[at : at + STRETCH].lower().encode("utf-32-le"), dtype=np.uint32)
        letter = _letters()[codes]
        seen = np.concatenate([[tail[-1] != 32], letter])
        kept = np.where(letter, codes, 32)[letter | seen[:-1]].astype(np.uint32)
        if not len(kept):
            continue
        found = np.concatenate(list(_buckets(np.concatenate([tail, kept]), bits, len(kept))))
        tail = np.concatenate([tail, kept])[-LONGEST + 1 :]
        if len(text) <= STRETCH:
            return np.unique(found, return_counts=True)
        whole = np.bincount(found, minlength=1 << bits) + (0 if whole is None else whole)
    if whole is None:
        return np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)
    return np.flatnonzero(whole).astype(np.uint32), whole[np.flatnonzero(whole)]


def weighted(text: str, bits: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and TF-IDF weights of length 1; none for a text without a letter."""
    at, counts = grams(text, bits)
    weight = (1 + np.log(counts)) * idf[at]
    size = np.sqrt((weight * weight).sum())
    return at, (weight / size if size else weight).astype(np.float32)


def _strings(column: pa.Array) -> Iterator[str]:
    for value in column:
        yield value.as_py() or ""


@dataclass(frozen=True)
class Settings:
    """Bounds and rates of learning."""

    bits: int = 18
    per_language: int = 2000
    passes: int = 4
    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 0.1
    l2: float = 0.001


def _document_counts(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """In how many texts of a task each bucket stands; bucket -1 counts the texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((1 << bits) + 1, dtype=np.int64)
        for batch in batches:
            for text in _strings(batch.column(0)):
                held[grams(text, bits)[0]] += 1
                held[-1] += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(at == 1 << bits, -1, at)), pa.array(held[at])], names=["bucket", "n"])
    return run


def _idf(texts: DataFrame, bits: int) -> np.ndarray:
    """ln((1 + texts) / (1 + texts that hold the bucket)); at most ``2 ** bits`` rows reach the driver."""
    found = texts.mapInArrow(_document_counts(bits), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    at, n = found.column("bucket").to_numpy(), found.column("n").to_numpy()
    held = np.zeros(1 << bits, dtype=np.int64)
    held[at[at >= 0]] = n[at >= 0]
    return np.log((1 + n[at < 0].sum()) / (1 + held)).astype(np.float32)


def _vectors(rows: pa.Table | pa.RecordBatch, bits: int, idf: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Label, buckets and weights of each text with a letter."""
    for label, text in zip(rows.column("label").to_pylist(), _strings(rows.column("text")), strict=True):
        at, weight = weighted(text, bits, idf)
        if len(at):
            yield label, at, weight


def _softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max())
    return p / p.sum()


def coefficients(z: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    """Weights of the leader: 0 where the L1 penalty outweighs the sum of gradients."""
    return -np.sign(z) * np.maximum(np.abs(z) - s.l1, 0) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)


def learn(vectors: Iterator[tuple[int, np.ndarray, np.ndarray]], z: np.ndarray, n: np.ndarray, s: Settings) -> None:
    """One pass over (label, buckets, weights) in their order; ``z`` and ``n`` (buckets x classes) are changed in place."""
    for label, at, x in vectors:
        z_at, n_at = z[at], n[at]
        w = coefficients(z_at, n_at, s)
        p = _softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        grown = n_at + g * g
        z[at] = z_at + g - (np.sqrt(grown) - np.sqrt(n_at)) / s.alpha * w
        n[at] = grown


def _shard(shared, s: Settings) -> Callable[[pa.Table], pa.Table]:
    """What a shard's pass makes of the state, in pieces, times the shard's rows."""
    def run(rows: pa.Table) -> pa.Table:
        idf, z, n = shared.value
        z, n = z.copy(), n.copy()
        learn(_vectors(rows.sort_by("key"), s.bits, idf), z, n, s)
        share, pieces = rows.num_rows, range(0, len(z), PIECE)
        state = [(np.stack([z[p : p + PIECE], n[p : p + PIECE]]) * share).astype(np.float32).tobytes() for p in pieces]
        return pa.table({"piece": pa.array(list(pieces), pa.int32()), "share": pa.array([share] * len(state), pa.int64()), "state": pa.array(state, pa.binary())})
    return run


def _added(rows: pa.Table) -> pa.Table:
    """Pieces of one place, added up."""
    total = sum(np.frombuffer(b, dtype=np.float32) for b in rows.column("state").to_pylist())
    return pa.table({"piece": rows.column("piece")[:1], "share": pa.array([sum(rows.column("share").to_pylist())], pa.int64()), "state": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def _losses(bits: int, shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Negative log-likelihood of a task's rows at each inverse temperature; targets keep a little for the other classes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, w, tried, spare = shared.value
        total = np.zeros(len(tried))
        for batch in batches:
            for label, at, x in _vectors(batch, bits, idf):
                logits = (x @ w[at])[None, :] * tried[:, None]
                logp = logits - logits.max(axis=1, keepdims=True)
                logp -= np.log(np.exp(logp).sum(axis=1, keepdims=True))
                total -= (1 - spare) * logp[:, label] + spare * logp.mean(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(tried))), pa.array(total)], names=["place", "loss"])
    return run


@dataclass(frozen=True)
class Model:
    """Languages, idf and the temperature-divided weights of the buckets that have any; the last row has none."""

    languages: tuple[str, ...]
    bits: int
    idf: np.ndarray
    place: np.ndarray
    weights: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        at, x = weighted(text or "", self.bits, self.idf)
        if not len(at) or not self.languages:
            return "und", 0.0
        p = _softmax(x @ self.weights[self.place[at]])
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _temperature(held: DataFrame, bits: int, idf: np.ndarray, w: np.ndarray) -> float:
    """The inverse temperature of the least loss on rows that were not learned from; 1 without such rows."""
    spark, rows = held.sparkSession, held.count()
    if not rows:
        return 1.0
    best, tried = 1.0, TRIED
    for _ in range(2):
        shared = spark.sparkContext.broadcast((idf, w, tried, 1 / (rows + 2)))
        sums = held.select("label", "text").mapInArrow(_losses(bits, shared), "place long, loss double").groupBy("place").agg(F.sum("loss").alias("loss"))
        loss = {r.place: r.loss for r in sums.collect()}
        at = min(loss, key=lambda i: (loss[i], i))
        best, tried = float(tried[at]), np.geomspace(tried[max(0, at - 1)], tried[min(len(tried) - 1, at + 1)], len(tried))
    return best


def fit(rows: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from ``lang`` and ``text``; rows without a language or a letter teach nothing.

    The sample takes a text by its hash, so equal texts are in it once and each language has ``per_language`` of them, as
    its hashes fall.  The state has ``2 ** bits`` buckets times the languages, whatever the corpus; one number of either
    kind for each travels to the driver after a pass.
    """
    spark, s = rows.sparkSession, settings
    known = rows.select("lang", "text").filter("lang is not null and text is not null").withColumn("key", F.xxhash64("lang", "text"))
    different = known.select("lang", "key").distinct().groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()
    languages = tuple(r.lang for r in different)
    idf = _idf(known.select("text"), s.bits)
    nothing = np.full(1 << s.bits, 0, dtype=np.int32)
    if not languages:
        return Model((), s.bits, idf, nothing, np.zeros((1, 0), dtype=np.float32))
    span = 1 << 30
    classes = spark.createDataFrame([(r.lang, i, s.per_language * span // r.n) for i, r in enumerate(different)], "of_lang string, label int, share long")
    drawn = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(span))
    sample = (known.join(F.broadcast(classes), F.col("lang") == F.col("of_lang")).filter(drawn < F.col("share"))
              .select("key", "label", (F.pmod(F.xxhash64("key", F.lit(2)), F.lit(5)) != 0).alias("fitted"), "text"))
    sample = materialize(sample.dropDuplicates(["key"]), "sample")
    fitted = sample.filter("fitted")
    shards = fitted.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // SHARD_BYTES + 1
    sharded = fitted.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(3)), F.lit(shards))).select("shard", "key", "label", "text")
    z, n = (np.zeros((1 << s.bits, len(languages)), dtype=np.float32) for _ in range(2))
    for _ in range(s.passes):
        shared = spark.sparkContext.broadcast((idf, z, n))
        states = sharded.groupBy("shard").applyInArrow(_shard(shared, s), "piece int, share long, state binary")
        z, n = z.copy(), n.copy()
        for piece, share, state in states.groupBy("piece").applyInArrow(_added, "piece int, share long, state binary").collect():
            mean = np.frombuffer(state, dtype=np.float32) / share
            z[piece : piece + PIECE], n[piece : piece + PIECE] = mean.reshape(2, -1, len(languages))
        shared.unpersist()
    w = coefficients(z, n, s).astype(np.float32)
    w *= np.float32(_temperature(sample.filter("not fitted"), s.bits, idf, w))
    used = np.flatnonzero(w.any(axis=1))
    place = nothing + len(used)
    place[used] = np.arange(len(used))
    return Model(languages, s.bits, idf, place, np.concatenate([w[used], np.zeros((1, len(languages)), dtype=np.float32)]))


def fold(doc_id: str) -> Column:
    """Fold 0 .. 2 of a document; a NULL id is an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t) for t in _strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", settings: Settings = Settings()) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of each document; ``held_out`` ones (fold 1) are not learned from.

    ``score`` is the calibrated probability of ``lang_pred``.  A NULL text and a text without a letter are ``und`` with score 0,
    as is every text if no language was learned; of equally likely languages the first by name is taken.  Repeated rows and
    NULL ids are documents of their own (though equal texts are learned from once); other columns are ignored; no rows, no
    result.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    model = fit(slim.filter(fold("doc_id") != 1), settings)
    return predict(slim, model).select("doc_id", (fold("doc_id") == 1).alias("held_out"), "lang_pred", "score")
