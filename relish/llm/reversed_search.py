"""Ranked lexical search the other way round: the items' terms are the index, and the documents stream through it.

1. Items are taken in blocks of bounded size.  A block's inverted index (term -> items that ask for it, and how often) is
   broadcast; every document is read once a block and leaves its length and the counts of the terms that the index has.
2. Counts of documents, terms and documents a term follow from what was left.
3. Each task scores its documents against the block's items and keeps, for each item, a heap of the best: bounded, as a
   document below an item's worst kept score is passed over.  The heaps of all tasks are merged.

Terms are taken for their 64-bit hashes.  Scores are 64-bit integers throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from relish.llm import arrowtext, texthash
from relish.operators.order import running_total
from relish.session import materialize

#: scores of a group of documents that are worked out at once
CELLS = 1 << 20


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of each item with their counts."""
    for batch in batches:
        counted = [np.unique(texthash.word_hashes(t, texthash.ALNUM), return_counts=True) for t in arrowtext.texts(batch, "text")]
        sizes = [len(terms) for terms, _ in counted]
        rows = np.repeat(np.arange(len(sizes)), sizes)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.concatenate([t for t, _ in counted] or [np.empty(0, np.uint64)]).view(np.int64)),
                                          pa.array(np.concatenate([n for _, n in counted] or [np.empty(0, np.int64)]), pa.int64())], names=["item_id", "term", "asked"])


def _blocks(items: DataFrame, block: int) -> DataFrame:
    """One row an item: its terms, and the block it belongs to; a block has ``block`` terms, or one larger item more."""
    kind = items.schema["item_id"].dataType.simpleString()
    terms = items.distinct().mapInArrow(_terms, f"item_id {kind}, term long, asked long")
    summed = terms.groupBy("item_id", "term").agg(F.sum("asked").alias("asked"))
    whole = summed.groupBy("item_id").agg(F.collect_list(F.struct("term", "asked")).alias("terms")).withColumn("n_terms", F.size("terms"))
    placed = running_total(whole, [F.col("item_id").asc()], "n_terms", "upto")
    return placed.select("item_id", F.col("terms.term").alias("term"), F.col("terms.asked").alias("asked"), F.expr(f"(upto - n_terms) div {block}").alias("block"))


class Index:
    """Sorted terms of a block; for term ``t`` the postings ``first[t]`` to ``first[t + 1]``: an item's place and how often it asks."""

    def __init__(self, block: pa.Table) -> None:
        self.ids = block.column("item_id").combine_chunks()
        lists = block.column("term").combine_chunks()
        item = np.repeat(np.arange(len(self.ids)), lists.value_lengths().to_numpy())
        self.terms, place = np.unique(lists.flatten().to_numpy().view(np.uint64), return_inverse=True)
        order = np.argsort(place, kind="stable")
        self.item, self.asked = item[order], block.column("asked").combine_chunks().flatten().to_numpy()[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(self.terms)))])


def _counted(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Length and indexed terms of each document that has a term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value.terms
        for batch in batches:
            rows, sizes, places, counts = [], [], [], []
            for i, data in enumerate(arrowtext.texts(batch, "text")):
                words = texthash.word_hashes(data, texthash.ALNUM)
                if not len(words):
                    continue
                at = np.minimum(np.searchsorted(terms, words), len(terms) - 1)
                place, count = np.unique(at[terms[at] == words], return_counts=True)
                rows.append(i)
                sizes.append(len(words))
                places.append(place.astype(np.int32).tobytes())
                counts.append(count.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), pa.array(places, pa.binary()), pa.array(counts, pa.binary())],
                                             names=["doc_id", "n", "places", "counts"])
    return run


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit numbers of all rows, and each row's count of them."""
    parts = [np.frombuffer(v.as_buffer(), dtype=np.int32) for v in column]
    return (np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)).astype(np.int64), np.array([len(p) for p in parts], dtype=np.int64)


def _holders(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How many documents of a task hold each term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, dtype=np.int64)
        for batch in batches:
            held += np.bincount(_numbers(batch.column(0))[0], minlength=size)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["place", "df"])
    return run


class Heaps:
    """The best (score, document) pairs of each item; equal scores by ascending id, NULL ids last."""

    def __init__(self, items: int, top: int, kind: pa.DataType) -> None:
        self.top, self.low, self.limit = top, np.ones(items, dtype=np.int64), max(2 * top * items, 1 << 15)
        self.kept, self.n = [pa.table({"item": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "doc_id": pa.array([], kind)})], 0

    def add(self, item: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        self.kept.append(pa.table({"item": pa.array(item), "score": pa.array(score), "doc_id": ids}))
        self.n += len(item)
        if self.n > self.limit:
            self.shrink()

    def shrink(self) -> pa.Table:
        """Only the best, in order; scores under an item's worst are not asked for any more."""
        rows = pa.concat_tables(self.kept).sort_by([("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")])
        item = rows.column("item").to_numpy()
        first = np.flatnonzero(np.diff(item, prepend=-1))
        place = np.arange(len(item)) - np.repeat(first, np.diff(first, append=len(item)))
        last = place == self.top - 1
        self.low[item[last]] = rows.column("score").to_numpy()[last]
        rows = rows.filter(pa.array(place < self.top))
        self.kept, self.n = [rows], 0
        return rows


def _scored(shared, top: int, n_docs: int, n_terms: int, kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's best documents of each item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weights = shared.value
        items = len(index.ids)
        heaps = Heaps(items, top, kind)
        at_once = max(1, CELLS // items)
        width = np.diff(index.first)
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                part = batch.slice(start, at_once)
                place, own = _numbers(part.column(2))
                count, _ = _numbers(part.column(3))
                # Python's whole numbers, as 25 * n * N may pass 64 bits
                length = np.array([75 + 25 * n * n_docs // n_terms for n in part.column(1).to_pylist()], dtype=np.int64)
                doc = np.repeat(np.arange(part.num_rows), own)
                gain = weights[place] * ((1_000_000_000 * count) // (1000 * count + 12 * length[doc]))
                each = width[place]
                posting = np.repeat(index.first[place] - np.cumsum(each) + each, each) + np.arange(each.sum())
                scores = np.zeros(part.num_rows * items, dtype=np.int64)
                np.add.at(scores, np.repeat(doc, each) * items + index.item[posting], np.repeat(gain, each) * index.asked[posting])
                good, item = np.nonzero(scores.reshape(-1, items) >= heaps.low)
                heaps.add(item, scores[good * items + item], part.column(0).take(pa.array(good)))
        best = heaps.shrink()
        yield from pa.table({"item_id": index.ids.take(pc.cast(best.column("item").combine_chunks(), pa.int64())), "doc_id": best.column("doc_id"), "score": best.column("score")}).to_batches()
    return run


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
           top: int = 20, block: int = 1 << 18) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``top`` documents of a score above 0.

    Terms are runs of a-z, 0-9 and characters beyond ASCII, A-Z in lower case.  Equal scores go by ascending ``doc_id``, NULL
    last.  Every row of ``docs`` is a document; a NULL text has no terms.  Items of one id, NULL included, are one item with
    the terms of all its different texts; repeated rows count once; an item without terms or matches has no rows.  Other
    columns are ignored; no documents or no items, no result.  ``block`` bounds the terms of one broadcast index.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    asked = materialize(_blocks(items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")), block), "items")
    id_type, item_type = slim.schema["doc_id"].dataType.simpleString(), asked.schema["item_id"].dataType.simpleString()
    best = spark.createDataFrame([], f"item_id {item_type}, doc_id {id_type}, score long")
    totals = None
    for b in sorted(r.block for r in asked.select("block").distinct().collect()):
        index = Index(asked.filter(F.col("block") == b).drop("block").toArrow())
        shared = spark.sparkContext.broadcast(index)
        found = materialize(slim.mapInArrow(_counted(shared), f"doc_id {id_type}, n long, places binary, counts binary"), "counted")
        totals = totals or found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not totals[0]:
            break
        held = found.select("places").mapInArrow(_holders(len(index.terms)), "place long, df long").groupBy("place").agg(F.sum("df").alias("df")).toArrow()
        df = np.zeros(len(index.terms), dtype=np.int64)
        df[held.column("place").to_numpy()] = held.column("df").to_numpy()
        weights = np.floor(1000 * np.log((2 * totals[0] + 2) / (2 * df + 1))).astype(np.int64)
        weighed = spark.sparkContext.broadcast((index, weights))
        kind = found.limit(0).toArrow().schema.field("doc_id").type
        scored = found.mapInArrow(_scored(weighed, top, *totals, kind), best.schema)
        best = best.unionByName(materialize(scored, "best"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
