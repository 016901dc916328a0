"""Harmonic packing of tokenised documents into sequences of one capacity.

Class k of the harmonic partition holds pieces of floor(capacity / k) tokens and its bins take k of them each.  As
documents may be cut anywhere, every piece is cut to exactly the size of its class: only classes that leave at most
``slack`` tokens of a sequence open are used, and a document's rest goes on into the next smaller class.  Each task
numbers its own pieces of a class; a small table of counts per task and class turns that into places in bins, so tasks
fill bins without a word between them.  The pieces in the last open bin of each class - a number bounded by the
capacity alone - are put together by first fit.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from relish.llm import arrowtext
from relish.session import materialize

#: spellings a worker keeps the ids of, over all tasks it runs; beyond that it starts anew
KEPT_WORDS = 800_000
#: stands between words that are encoded together
MARK = "\x01"
PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, task int, place long"


def class_sizes(capacity: int, slack: int) -> list[int]:
    """Piece sizes, largest first; a bin of size s takes capacity // s pieces."""
    return [s for s in range(capacity, 0, -1) if capacity // (capacity // s) == s and capacity % s <= slack]


def cut(n: int, sizes: list[int]) -> list[int]:
    """Lengths of the pieces of a document of n tokens."""
    out = []
    for s in sizes:
        while n >= s:
            out.append(s)
            n -= s
    return out


def token_ids(texts: list[str], encode: Callable[[list[str]], list[bytes]], known: dict[str, bytes]) -> Iterator[bytes]:
    """Little-endian 32-bit ids of each text.

    The tokenizer never lets a token cross white space, so words between blanks are encoded once and looked up after.
    """
    for text in texts:
        parts = text.replace("\n", " ").split(" ")
        fresh = list(set(parts).difference(known))
        if fresh:
            if len(known) > KEPT_WORDS:
                known.clear()
                fresh = list(set(parts))
            known.update(zip(fresh, encode(fresh), strict=True))
        yield b"".join(map(known.__getitem__, parts))


def word_encoder(encode: Callable[[list[str]], list[list[int]]]) -> Callable[[list[str]], list[bytes]]:
    """Little-endian 32-bit ids of each of some words, which a blank parts for the tokenizer too.

    Words are encoded as one text with a mark between them, which costs less than a text for each. That needs a mark of one token
    that no word holds; where it cannot be told from the words they are encoded one by one.
    """
    alone = encode([MARK, f"a {MARK} a", f"! {MARK} !"])
    mark = alone[0][0] if len(alone[0]) == 1 and all(ids.count(alone[0][0]) == 1 for ids in alone) else None

    def run(words: list[str]) -> list[bytes]:
        joined = f" {MARK} ".join(words)
        if mark is not None and joined.count(MARK) == len(words) - 1:
            ids = np.array(encode([joined])[0], dtype="<u4")
            at = np.flatnonzero(ids == mark)
            if len(at) == len(words) - 1:
                data, ends = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
                return [data[start:end] for start, end in zip([0, *(4 * at + 4).tolist()], ends, strict=True)]
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in encode(words)]
    return run


_loaded: dict[str, tuple[Callable[[list[str]], list[bytes]], dict[str, bytes]]] = {}
arrowtext.KEPT.append(_loaded.clear)


def _encoder(path: str) -> tuple[Callable[[list[str]], list[bytes]], dict[str, bytes]]:
    """The tokenizer and the words known so far, once for each worker."""
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker per core
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        _loaded[path] = word_encoder(lambda words: [e.ids for e in model.encode_batch_fast(words, add_special_tokens=False)]), {}
    return _loaded[path]


def _pieces(tokenizer: str, end_id: int, sizes: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known = _encoder(tokenizer)
        end, task, placed = np.array([end_id], dtype="<u4").tobytes(), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            rows: list[tuple[int, int, int, int, int, int]] = []
            texts = (str(t.as_py() or "") for t in batch.column(1))
            for row, ids in enumerate(token_ids(texts, encode, known)):
                data, at = memoryview(ids + end), 0
                total = len(data) // 4
                for length in cut(total, sizes):
                    rows.append((row, at, length, zlib.crc32(data[4 * at: 4 * (at + length)]), total, placed[length]))
                    placed[length] += 1
                    at += length
            if rows:
                found = np.array(rows, dtype=np.int64).T
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(found[0])), *map(pa.array, found[1:5]), pa.array(np.full(len(rows), task, dtype=np.int32)), pa.array(found[5])],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "place"])
    return run


def _first_fit(capacity: int, first: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.drop(columns="rest").sort_values(["length", "place", "task"], ascending=[False, True, True])
        room: list[int] = []
        ids, offsets = [], []
        for n in pieces["length"]:
            at = next((i for i, r in enumerate(room) if r >= n), len(room))
            if at == len(room):
                room.append(capacity)
            ids.append(first + at)
            offsets.append(capacity - room[at])
            room[at] -= n
        return pieces.assign(sequence_id=ids, offset=offsets)
    return run


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 2,
         slack: int = 8) -> DataFrame:
    """Pieces of all documents with their places: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its ids and ``end_id``; NULL and empty texts are that id alone.  ``tokenizer`` is the path of a
    tokenizers file on every worker; its tokens must not cross blanks or line feeds.  ``ids_crc32`` is over the piece's
    little-endian 32-bit ids.  Sequences are numbered from 0 without gaps, offsets within one too; ties, repeated rows
    and NULL ids are documents of their own; other columns are ignored; no rows, no pieces.  Ids must be shorter than
    2^31 tokens a document.
    """
    sizes = class_sizes(capacity, slack)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = PIECES.format(id=slim.schema["doc_id"].dataType.simpleString())
    pieces = materialize(slim.mapInArrow(_pieces(tokenizer, end_id, sizes), schema), "pieces")

    counts = materialize(pieces.groupBy("length", "task").agg(F.count("*").alias("here")), "piece_counts")
    # at most one row for each class: a number that follows from the capacity
    totals = {r["length"]: r["all"] for r in counts.groupBy("length").agg(F.sum("here").alias("all")).collect()}
    first, starts = 0, {}
    for s in sizes:
        starts[s] = first
        first += totals.get(s, 0) // (capacity // s)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    based = counts.select(F.col("length").alias("of_length"), F.col("task").alias("of_task"), F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before"))
    number = F.col("before") + F.col("place")
    bins = F.lit(capacity) / F.col("length")
    start = F.create_map(*[F.lit(x).cast("long") for pair in starts.items() for x in pair])
    full = F.create_map(*[F.lit(x).cast("long") for s in sizes for x in (s, totals.get(s, 0) // (capacity // s))])
    placed = (pieces.join(based, (F.col("length") == F.col("of_length")) & (F.col("task") == F.col("of_task")))
              .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "place", number.alias("number"), F.floor(bins).alias("per_bin"))
              .withColumn("bin", F.floor(F.col("number") / F.col("per_bin"))))
    closed = F.col("bin") < full[F.col("length")]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    done = (placed.filter(closed).withColumn("sequence_id", start[F.col("length")] + F.col("bin"))
            .withColumn("offset", (F.col("number") % F.col("per_bin")) * F.col("length")))
    rest = placed.filter(~closed).select(F.lit(0).alias("rest"), "doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "place")
    packed = rest.groupBy("rest").applyInPandas(_first_fit(capacity, first), schema + ", sequence_id long, offset long")
    return done.select(*names).unionByName(packed.select(*names))
