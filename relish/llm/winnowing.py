"""Winnowing fingerprints, and how like neighbouring texts are by them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from relish.llm import texthash

U64 = np.uint64
GRAM, WINDOW = 25, 76
#: stretches of ids that are walked through in order; more rows make longer stretches
MOST_CHUNKS, ROWS_A_CHUNK = 4096, 256
LOW = U64(0xFFFFFFFF)


def window_minima(values: np.ndarray, window: int) -> np.ndarray:
    """The least value of every window, by doubling."""
    size = 1
    while size * 2 <= window:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = window - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def scales(n: int, gram: int, window: int) -> list[tuple[int, int]]:
    """Grams and windows for a text of ``n`` code points.

    A window holds a third of the text's grams at most.  Grams of a third of the length, and of a ninth, serve texts of less
    than four times the next longer gram; a gram that is not the shortest needs a text of twice its length.  So any two
    texts, the shorter at least half as long as the longer, have a gram length in common.
    """
    found, longer, shortest = [], 0, -(-gram // 9)
    for size in sorted({gram, -(-gram // 3), shortest}, reverse=True):
        if (not longer or n < 4 * longer) and (size == shortest or n >= min(2 * size, gram + window - 1)):
            own = min(size, n)
            found.append((own, max(1, min(window, (n - own + 1) // 3))))
        longer = size
    return found


def _select(points: np.ndarray, gram: int, window: int) -> np.ndarray:
    n = len(points)
    up, down = texthash.powers(n + 1)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum(texthash.mix((points + U64(1)) * U64(0x9E3779B97F4A7C15)) * up[:n], out=sums[1:])
    hashes = texthash.mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1] + U64(gram))
    place = np.arange(len(hashes), dtype=U64)
    least = window_minima((hashes & ~LOW) | (LOW - place), window)
    picked = least[np.flatnonzero(np.diff(least, prepend=least[0] ^ U64(1)))]
    return np.stack([picked >> U64(32), LOW - (picked & LOW)], axis=1).astype(">u4")


def winnow(points: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> np.ndarray:
    """Selected grams of a text's code points, as (32-bit hash, position) rows in order of position.

    Of every ``window`` consecutive grams the one with the least hash is selected, the rightmost of equal ones, so any
    two texts that share ``gram + window - 1`` characters in a row share a selected hash.  Short texts have smaller windows
    and shorter grams (``scales``); the promise holds, as the least of a window is the least of every smaller window that
    holds it.  A text that keeps its first three quarters shares a selected hash at every length.  An empty text has none.
    """
    if not len(points):
        return np.empty((0, 2), dtype=">u4")
    parts = [_select(points, *scale) for scale in scales(len(points), gram, window)]
    if len(parts) == 1:
        return parts[0]
    every = np.concatenate(parts)
    return every[np.argsort(every[:, 1], kind="stable")]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Dice coefficient of the distinct hashes; two empty fingerprints are alike."""
    x, y = np.unique(a[:, 0]), np.unique(b[:, 0])
    both = len(x) + len(y)
    return 2.0 * len(np.intersect1d(x, y, assume_unique=True)) / both if both else 1.0


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the beginning of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(U64)


def _walk(gram: int, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None  # the row whose follower comes next: id, text, fingerprint
        for batch in batches:
            out: list[list] = [[] for _ in names]
            ids, guests = batch.column(2), batch.column(1).to_pylist()
            for at, value in enumerate(batch.column(3)):
                text = value.as_py() or ""
                prints = winnow(_points(text), gram, window)
                if before is not None:
                    key, own, own_prints = before
                    new = edited(own, text)
                    new_prints = winnow(_points(new), gram, window)
                    row = (key, len(own), hashlib.sha256(new.encode()).hexdigest(), own_prints.tobytes().hex(), new_prints.tobytes().hex(),
                           likeness(own_prints, new_prints), likeness(own_prints, prints))
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                before = None if guests[at] else (ids[at].as_py(), text, prints)
            kinds = [ids.type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)
    return run


def fingerprint_neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses to that and to the next text.

    Result: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.  A fingerprint is
    a string of 16 hex digits for each selected gram, hash then position.  The next document follows in order of
    ``doc_id``, after the last comes the first; NULL ids come first, equal ids stand in order of text.  NULL texts are
    empty; repeated rows stay; other columns are ignored; no rows, no result.  Ids are whole numbers.

    Ids are cut into at most 4096 stretches; every stretch is sorted and walked through once, and ends with a guest, the
    first document of the next one.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = slim.select("doc_id").count()
    chunks = max(1, min(MOST_CHUNKS, n // ROWS_A_CHUNK))
    shares = F.array(*[F.lit(i / chunks) for i in range(1, chunks)] or [F.lit(0.0)])
    bounds = np.unique(np.array(slim.agg(F.percentile_approx("doc_id", shares, F.lit(100_000))).first()[0] or [0], dtype=np.int64))

    @F.pandas_udf("int")
    def stretch(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(dtype=np.int64), side="right").astype(np.int32))

    def chunk_of(name: str) -> Column:
        return F.when(F.col(name).isNull(), -1).otherwise(stretch(F.coalesce(F.col(name), F.lit(0).cast("long"))))

    heads = slim.select("doc_id", chunk_of("doc_id").alias("chunk")).groupBy("chunk").agg(F.min("doc_id").alias("least")).collect()  # 4097 rows at most
    order = sorted(r["chunk"] for r in heads)
    ids = [r["least"] for r in heads if r["least"] is not None]
    first = slim.filter(F.col("doc_id").isin(ids) | (F.col("doc_id").isNull() if order[:1] == [-1] else F.lit(False)))
    goes_to = F.create_map(*[F.lit(x) for i, c in enumerate(order) for x in (c, order[i - 1])]) if order else F.create_map().cast("map<int,int>")
    guests = (first.withColumn("chunk", chunk_of("doc_id")).groupBy("chunk").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))
              .select(goes_to[F.col("chunk")].alias("chunk"), F.lit(True).alias("guest"), "doc_id", "text"))
    rows = slim.select(chunk_of("doc_id").alias("chunk"), F.lit(False).alias("guest"), "doc_id", "text").unionByName(guests)
    walked = rows.repartition("chunk").sortWithinPartitions("chunk", "guest", F.asc_nulls_first("doc_id"), "text")
    return walked.mapInArrow(_walk(gram, window), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                             "edited_fingerprint string, near_edited double, near_next double")
