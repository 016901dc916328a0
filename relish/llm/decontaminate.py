"""Benchmark decontamination: exact containment of item-sized windows, found by a prefix-filtered set join.

A window is 13 consecutive words of an item (all of a shorter item).  Its tokens are its shingles of up to three words,
ordered by how rarely they stand in the documents.  As a document must hold every token of a window, one token is a
sufficient prefix: the rarest.  Where a document has that token, the token's place in the window fixes the only place
the window can have; bounds on start and length, then the words themselves, decide.

Items are taken in blocks of bounded size; each block's index is sent to the tasks and all documents pass it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from relish.llm import arrowtext, texthash

WINDOW, SHINGLE = 13, 3
#: bytes of item texts in a block, about; an index takes up to 20 bytes for each
BLOCK_BYTES = 8 << 20
HITS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("item", T.StringType())]))
ADDED = {"n_words": T.LongType(), "hits": HITS}


@dataclass
class Index:
    """Distinct windows of a block of items and, for each prefix token, where it stands in which of them."""

    words: np.ndarray  # word hashes of all items, one after the other
    starts: np.ndarray  # of each window, in words
    lengths: np.ndarray
    items: list[list[str]]  # items that hold the window
    tokens: np.ndarray  # sorted prefix tokens, one entry a window
    owner: np.ndarray  # window of each entry
    offset: np.ndarray  # place of the token in the window
    shingle_lengths: list[int]


def _windows(bodies: list[np.ndarray], window: int) -> Iterator[tuple[int, int, int]]:
    """Item, start in the item and length of each window."""
    for i, words in enumerate(bodies):
        for start in range(max(1, len(words) - window + 1) if len(words) else 0):
            yield i, start, min(window, len(words))


def shingle_lengths(bodies: list[np.ndarray], shingle: int) -> list[int]:
    """Token lengths in use: shorter items have shorter shingles."""
    return sorted({min(shingle, len(b)) for b in bodies if len(b)})


def all_shingles(words: np.ndarray, lengths: list[int]) -> np.ndarray:
    return np.concatenate([texthash.shingles(words, g) for g in lengths]) if lengths else np.empty(0, dtype=np.uint64)


def build(ids: list[str], bodies: list[np.ndarray], tokens: np.ndarray, counts: np.ndarray, window: int, shingle: int) -> Index:
    """``tokens`` (sorted) and ``counts`` give each shingle's number of places in the documents."""
    base = np.cumsum([0, *map(len, bodies)])
    known: dict[bytes, int] = {}
    starts, lengths, items, prefix, offset = [], [], [], [], []
    ranked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for i, start, length in _windows(bodies, window):
        content = bodies[i][start: start + length].tobytes()
        at = known.setdefault(content, len(starts))
        if at < len(starts):
            if ids[i] not in items[at]:
                items[at].append(ids[i])
            continue
        if i not in ranked:
            own = texthash.shingles(bodies[i], min(shingle, len(bodies[i])))
            ranked[i] = own, counts[np.searchsorted(tokens, own)]
        own, often = (x[start: start + length - min(shingle, length) + 1] for x in ranked[i])
        best = int(np.lexsort((own, often))[0])
        starts.append(base[i] + start)
        lengths.append(length)
        items.append([ids[i]])
        prefix.append(own[best])
        offset.append(best)
    order = np.argsort(np.array(prefix, dtype=np.uint64), kind="stable")
    return Index(np.concatenate(bodies) if bodies else np.empty(0, dtype=np.uint64), np.array(starts, dtype=np.int64), np.array(lengths, dtype=np.int64), items,
                 np.array(prefix, dtype=np.uint64)[order], order.astype(np.int64), np.array(offset, dtype=np.int64)[order], shingle_lengths(bodies, shingle))


def find(words: np.ndarray, index: Index) -> list[tuple[int, int, int]]:
    """Start, length and number of each window that stands in a document."""
    out = []
    for g in index.shingle_lengths:
        own = texthash.shingles(words, g)
        left, right = np.searchsorted(index.tokens, own, side="left"), np.searchsorted(index.tokens, own, side="right")
        for at in np.flatnonzero(right > left):
            entries = np.arange(left[at], right[at])
            window, start = index.owner[entries], at - index.offset[entries]
            fits = (start >= 0) & (start + index.lengths[window] <= len(words))
            for w, s in zip(window[fits].tolist(), start[fits].tolist(), strict=True):
                n, first = int(index.lengths[w]), int(index.starts[w])
                if np.array_equal(words[s: s + n], index.words[first: first + n]):
                    out.append((s, n, w))
    return out


def _count(text: str, tokens, lengths: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokens.value
        total = np.zeros(len(known), dtype=np.int64)
        for batch in batches:
            for data in arrowtext.texts(batch, text):
                own = all_shingles(texthash.word_hashes(data, texthash.ALNUM), lengths)
                at = np.searchsorted(known, own)
                at = at[known[np.minimum(at, len(known) - 1)] == own]
                np.add.at(total, at, 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["token", "places"])
    return run


def _mark(text: str, block, last: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = block.value
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("item", pa.string())]))
        for batch in batches:
            n_words, hits = [], []
            earlier = batch.column(batch.schema.get_field_index("hits")).to_pylist() if last else [[]] * batch.num_rows
            for data, before in zip(arrowtext.texts(batch, text), earlier, strict=True):
                words = texthash.word_hashes(data, texthash.ALNUM)
                found = find(words, index) if len(words) and len(index.tokens) else []
                n_words.append(len(words))
                hits.append(before + [{"start": s, "length": n, "item": item} for s, n, w in found for item in index.items[w]])
            yield arrowtext.append(batch, {"n_words": pa.array(n_words, pa.int64()), "hits": pa.array(hits, kind)})
    return run


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list]:
    """Items in blocks of about ``block_bytes`` of text."""
    slim = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    total = slim.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    parts = total // block_bytes + 1
    for part in range(parts):
        yield slim.filter(F.pmod(F.xxhash64("id", "body"), F.lit(parts)) == part).collect()


def find_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
               window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words`` and ``hits``, the ``start, length, item`` of every window of an item that stands in the text.

    Words are runs of letters and digits, all characters beyond ASCII counted as letters, A-Z in lower case.  A NULL or
    empty text has no words and no hits; an item without words is never found; a NULL ``item_id`` is the id "".  Items
    that share a window are all named; repeated items count as one; repeated documents stay.  Columns named ``n_words``
    or ``hits`` are replaced, all others stay.
    """
    spark: SparkSession = docs.sparkSession
    out = docs
    for number, rows in enumerate(_blocks(benchmark, item_id, item_text, block_bytes)):
        ids = [r["id"] for r in rows]
        bodies = [texthash.word_hashes(r["body"].encode(), texthash.ALNUM) for r in rows]
        lengths = shingle_lengths(bodies, shingle)
        tokens = np.unique(np.concatenate([texthash.shingles(b, min(shingle, len(b))) for b in bodies if len(b)] or [np.empty(0, dtype=np.uint64)]))
        counts = np.zeros(len(tokens), dtype=np.int64)
        if len(tokens):
            sent = spark.sparkContext.broadcast(tokens)
            counted = docs.select(F.col(text).alias("text")).mapInArrow(_count("text", sent, lengths), "token long, places long")
            for r in counted.groupBy("token").agg(F.sum("places").alias("places")).collect():  # as many rows as the block has shingles, at most
                counts[r["token"]] = r["places"]
        index = spark.sparkContext.broadcast(build(ids, bodies, tokens, counts, window, shingle))
        out = out.mapInArrow(_mark(text, index, number), arrowtext.extended(out.schema, ADDED))
    return out


def spans(hits: list) -> list[tuple[int, int]]:
    """Maximal runs of hit words, as start and end."""
    out: list[list[int]] = []
    for start, length in sorted({(h["start"], h["length"]) for h in hits}):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], start + length)
        else:
            out.append([start, start + length])
    return [(a, b) for a, b in out]


def _digest(hits: pa.Array) -> tuple[list[int], list[int], list[str]]:
    n_hit, n_items, sha = [], [], []
    for row in hits.to_pylist():
        items = sorted({h["item"] for h in row}, key=lambda x: x.encode())
        n_hit.append(sum(b - a for a, b in spans(row)))
        n_items.append(len(items))
        sha.append(hashlib.sha256(",".join(items).encode()).hexdigest())
    return n_hit, n_items, sha


def judge(found: DataFrame, share: int = 20) -> DataFrame:
    """The result of ``find_items`` with ``n_hit, n_items, items_sha256`` and ``contaminated``: a ``share``-th of the words hit, or more."""
    added = {"n_hit": T.LongType(), "n_items": T.LongType(), "items_sha256": T.StringType()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit, n_items, sha = _digest(batch.column(batch.schema.get_field_index("hits")))
            yield arrowtext.append(batch, {"n_hit": pa.array(n_hit, pa.int64()), "n_items": pa.array(n_items, pa.int64()), "items_sha256": pa.array(sha, pa.string())})

    marked = found.mapInArrow(run, arrowtext.extended(found.schema, added))
    return marked.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))
