"""Repeated stretches of bytes, found by a depth-limited radix sort of suffixes.

Suffixes are told apart by their first ``length`` bytes only, in passes from the most significant digit on; a suffix that
is alone in its group after a pass leaves, and the groups left after the last pass are exactly the repeated windows.

* First digit: the anchor, the ``gram``-byte string with the least hash in the window (the rightmost of equal ones).
  Equal windows have equal anchors, and neighbouring windows share theirs, so the pass moves one row for each run of
  windows with one anchor - about one in ``length / 3`` positions - and not one for each suffix.
* Second digit: the whole run, from its first window's start to its last one's end.  Suffixes of equal runs are equal
  window by window; all but the earliest run of a group are repeated.
* Last digit: the window itself, for the earliest runs of groups that share an anchor but differ as a whole.

Digits are compared as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from relish.llm import arrowtext, texthash
from relish.session import materialize

U64 = np.uint64
LOW = U64(0xFFFFFFFF)
#: window starts taken at once, so that a long text needs no more memory than this
STRETCH = 1 << 19
#: a place is twin << 48 | start << 8 | windows: the order of places is the order of starts
START_BITS, TWIN_BITS = 8, 48
NO_ID = -(1 << 63)


def runs(text: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchor hash, hash of the whole run, first start and number of windows of each run."""
    from relish.llm.winnowing import window_minima

    for base in range(0, max(0, len(text) - length + 1), STRETCH):
        part = text[base: base + STRETCH + length - 1]
        sums = texthash.prefix_sums(part)
        grams = texthash.stretches(sums, np.arange(len(part) - gram + 1), gram)
        least = window_minima((grams & ~LOW) | (LOW - np.arange(len(grams), dtype=U64)), length - gram + 1)
        first = np.flatnonzero(np.diff(least, prepend=least[0] ^ U64(1)))
        count = np.diff(first, append=len(least))
        yield grams[(LOW - (least[first] & LOW)).astype(np.int64)], texthash.stretches(sums, first, count + length - 1), first + base, count


def windows(text: np.ndarray, starts: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every window of the given runs."""
    at = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    hashes = np.empty(len(at), dtype=U64)
    for base in range(0, len(text), STRETCH):
        inside = np.flatnonzero((at >= base) & (at < base + STRETCH))
        if len(inside):
            hashes[inside] = texthash.stretches(texthash.prefix_sums(text[base: base + STRETCH + length - 1]), at[inside] - base, length)
    return hashes, at


def _signed(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64))


def _batch(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Rows of the first pass.  Of equal runs at hand only the earliest has to be compared with others; the rest are
    ``known`` to repeat it and get an anchor of their own, so that no anchor gathers the rows of a hot text."""
    anchor, whole, doc, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((place, doc, whole, anchor))
    same = (anchor[order][1:] == anchor[order][:-1]) & (whole[order][1:] == whole[order][:-1])
    known = np.zeros(len(anchor), dtype=bool)
    known[order[1:][same]] = True
    spread = texthash.mix(doc.astype(U64) * U64(0x9E3779B97F4A7C15) ^ place.astype(U64))
    return pa.RecordBatch.from_arrays([_signed(np.where(known, spread, anchor)), _signed(whole), pa.array(doc), pa.array(place), pa.array(known)],
                                      names=["anchor", "whole", "doc", "place", "known"])


def _first_digits(length: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0
        for batch in batches:
            ids, twins = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, data in enumerate(arrowtext.texts(batch, "text")):
                for anchor, whole, start, count in runs(np.frombuffer(data, dtype=np.uint8), length, gram):
                    parts.append((anchor, whole, np.full(len(start), ids[row]), (twins[row] << TWIN_BITS) | (start << START_BITS) | count))
                    held += len(start)
                if held > 500_000:
                    yield _batch(parts)
                    parts, held = [], 0
        if parts:
            yield _batch(parts)
    return run


def _places(places: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """Sorted starts and numbers of windows."""
    found = np.sort(np.asarray(places.values.to_numpy(zero_copy_only=False), dtype=np.int64)) if places.is_valid else np.empty(0, dtype=np.int64)
    return (found & ((1 << TWIN_BITS) - 1)) >> START_BITS, found & ((1 << START_BITS) - 1)


def _last_digit(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, twins, places = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for row, data in enumerate(arrowtext.texts(batch, "text")):
                hashes, at = windows(np.frombuffer(data, dtype=np.uint8), *_places(places[row]), length)
                yield pa.RecordBatch.from_arrays([_signed(hashes), pa.array(np.full(len(at), ids[row])), pa.array((twins[row] << TWIN_BITS) | (at << START_BITS) | 1)],
                                                 names=["digit", "doc", "place"])
    return run


def _cut(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, sizes, spans, kept = batch.column(3), [], [], []
            for row, data in enumerate(arrowtext.texts(batch, "text")):
                starts, counts = _places(places[row])
                ends = np.maximum.accumulate(starts + counts + length - 1) if len(starts) else starts
                fresh = np.flatnonzero(np.r_[True, starts[1:] > ends[:-1]]) if len(starts) else starts
                begin, stop = starts[fresh], ends[np.r_[fresh[1:] - 1, len(ends) - 1]] if len(starts) else ends
                edges = [0, *np.stack([begin, stop], axis=1).ravel().tolist(), len(data)]
                sizes.append(len(data))
                spans.append([{"start": a, "end": b} for a, b in zip(begin.tolist(), stop.tolist(), strict=True)])
                kept.append(b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]))
            yield pa.RecordBatch.from_arrays([batch.column(4), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())],
                                             names=["doc_id", "n_bytes", "spans", "kept"])
    return run


def _keyed(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``doc, twin, text, doc_id`` of every row, and ``doc, twin, text`` of every document once: twin numbers the different
    texts of one id (0 as a rule), in order of a hash."""
    slim = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(doc_id).alias("doc_id"))
    often = materialize(slim.groupBy("doc").count().filter("count > 1").select(F.col("doc").alias("often")), "repeated_ids")
    if often.isEmpty():
        keyed = slim.select("doc", F.lit(0).cast("long").alias("twin"), "text", "doc_id")
        return keyed, keyed.select("doc", "twin", "text")
    hashed = slim.withColumn("hashed", F.xxhash64("text"))
    twins = (hashed.join(often, F.col("doc") == F.col("often"), "left_semi").select("doc", "hashed").distinct()
             .select(F.col("doc").alias("twin_doc"), F.col("hashed").alias("twin_hash"),
                     (F.row_number().over(Window.partitionBy("doc").orderBy("hashed")) - 1).cast("long").alias("twin")))
    joined = hashed.join(materialize(twins, "twins"), (F.col("doc") == F.col("twin_doc")) & (F.col("hashed") == F.col("twin_hash")), "left")
    keyed = joined.select("doc", F.coalesce("twin", F.lit(0).cast("long")).alias("twin"), "text", "doc_id")
    # only texts of repeated ids have to meet to become distinct; the others stay where they are
    repeats = joined.filter("twin is not null").select("doc", "twin", "text").distinct()
    return keyed, joined.filter("twin is null").select("doc", F.lit(0).cast("long").alias("twin"), "text").unionByName(repeats)


def _listed(places: DataFrame) -> DataFrame:
    """The places of each text; their number is bounded by the text's length."""
    twin = F.shiftright("place", TWIN_BITS)
    return places.groupBy(F.col("doc").alias("of_doc"), twin.alias("of_twin")).agg(F.collect_list("place").alias("places"))


def _with_places(keyed: DataFrame, places: DataFrame, how: str) -> DataFrame:
    match: Column = (F.col("doc") == F.col("of_doc")) & (F.col("twin") == F.col("of_twin"))
    return keyed.join(_listed(places), match, how).select("doc", "twin", "text", "places", *keyed.columns[3:])


def repeated(once: DataFrame, length: int, gram: int) -> DataFrame:
    """``doc, place`` of every run or window of which all bytes stand in an earlier text or place too; no document twice."""
    first = once.mapInArrow(_first_digits(length, gram), "anchor long, whole long, doc long, place long, known boolean")
    group, order = Window.partitionBy("anchor"), Window.partitionBy("anchor").orderBy("whole", "doc", "place")
    again = F.col("known") | F.coalesce(F.lag("whole").over(order) == F.col("whole"), F.lit(False))
    ranked = first.select("doc", "place", again.alias("again"), (F.min("whole").over(group) != F.max("whole").over(group)).alias("mixed"))
    left = materialize(ranked.select("doc", "place", "again", "mixed").filter("again or mixed"), "runs")
    heads = left.filter("not again").select("doc", "place")
    last = _with_places(once, heads, "inner").mapInArrow(_last_digit(length), "digit long, doc long, place long")
    within = Window.partitionBy("digit").orderBy("doc", "place")
    later = last.select("doc", "place", F.lag("digit").over(within).alias("before")).filter("before is not null").select("doc", "place")
    return left.filter("again").select("doc", "place").unionByName(materialize(later, "windows"))


def cut_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 100, gram: int = 32) -> DataFrame:
    """Every text without the bytes that a ``length``-byte string covers which also starts earlier.

    Result: ``doc_id, n_bytes, spans, kept``; ``spans`` are the maximal removed runs (start, end; bytes from 0, end open),
    ``kept`` the remaining bytes.  Earlier is a smaller ``doc_id``, or an earlier start in the same text; strings may
    overlap, never cross texts, and are judged on the input.  NULL texts are empty; NULL ids come first.  Rows of one id
    and one text are one document and share its result, so they are no copies of each other; different texts of one id
    stand in the order of a hash.  Other columns are ignored; no rows, no result.  Ids are whole numbers, texts shorter
    than 2^40 bytes, texts of one id fewer than 2^15; ``gram`` is at most ``length``, and ``length`` at most 255.
    """
    keyed, once = _keyed(docs, doc_id, text)
    marked = _with_places(keyed, repeated(once, length, gram), "left")
    kind = docs.schema[doc_id].dataType.simpleString()
    return marked.mapInArrow(_cut(length), f"doc_id {kind}, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")
