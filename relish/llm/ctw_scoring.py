"""Language-model scores by context-tree weighting, learned from and applied to a whole corpus.

Texts are bytes with A-Z in lower case and an end mark (byte 255, which UTF-8 never has), preceded by end marks.  What a
model needs is the count of every gram (a byte after its context) in training texts, and the same for every word of the
unigram base.  Neither fits into one place, so the work goes by blocks of texts and buckets of keys:

1. A block of about ``block_bytes`` of text asks: its distinct grams and words, with training counts, are packed into one
   row for each bucket.  Only these rows move, never single positions.
2. A bucket holds all grams of some three-byte contexts, or words by hash.  It adds up what blocks ask, row by row, and
   works out the part of the context trees that lies below its contexts.
3. The contexts of up to three bytes are combined with grouped sums upwards and joins downwards.
4. Each bucket turns its grams into log probabilities and answers the blocks; blocks add up their texts.

A task holds one block, or the distinct keys of one bucket: ``buckets`` has to grow with those.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from relish.llm import contexttree as ct
from relish.llm import texthash
from relish.session import materialize

#: bytes of context above which trees are combined across buckets
TOP = 3
END = 0xFF
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
PACKED = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("numbers", pa.binary())])
PACKED_SQL = "kind int, bucket int, block long, keys binary, numbers binary"
GRAMS, WORDS = 0, 1
NODE_SQL = "i int, key long, n0 double, n1 double, weighted double"
PATH_SQL = "i int, key long, mixed double, left double, last double"


def grams(text: np.ndarray, depth: int) -> np.ndarray:
    """One gram for each byte of the text and one for its end."""
    n = len(text) + 1
    padded = np.full(depth + n, END, dtype=np.int64)
    padded[depth: depth + n - 1] = text
    out = padded[depth:].copy()
    for j in range(1, depth + 1):
        out |= padded[depth - j: depth - j + n] << (8 * (depth - j) + 8)
    return out


def bucket_of_contexts(contexts: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of three-byte contexts."""
    return (texthash.mix(contexts.astype(np.uint64) + np.uint64(1)) % np.uint64(buckets)).astype(np.int32)


def pack_numbers(values: np.ndarray) -> bytes:
    """An array as compressed planes of bytes."""
    return zlib.compress(values.dtype.str.encode() + b"|" + values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes(), 1)


def unpack_numbers(data: bytes) -> np.ndarray:
    kind, _, planes = zlib.decompress(data).partition(b"|")
    dtype = np.dtype(kind.decode())
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(dtype.itemsize, -1).T).reshape(-1).view(dtype)


def pack_grams(keys: np.ndarray) -> bytes:
    return pack_numbers(np.diff(keys, prepend=0))


def unpack_grams(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_numbers(data))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their counts; the parts are sorted, so a stable sort only merges them."""
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    if not len(first):
        return keys, counts
    return keys[first], np.add.reduceat(counts[order], first).astype(np.int64)


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), PACKED, strict=True)], schema=PACKED) if rows else PACKED.empty_table()


def _bodies(table: pa.Table) -> Iterator[np.ndarray]:
    for value in table.column("text"):
        yield texthash.lower(value.as_buffer()) if value.is_valid else np.empty(0, dtype=np.uint8)


def ask(depth: int, buckets: int) -> Callable[[pa.Table], pa.Table]:
    """Distinct keys of a block with their training counts (0 where only other texts have them)."""
    def run(table: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if not table.num_rows:
            return _rows(rows)
        block, train = table.column("block")[0].as_py(), table.column("train").to_pylist()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        fresh: dict[bool, list[np.ndarray]] = {True: [], False: []}
        held = 0
        words: Counter[bytes] = Counter()

        def settle() -> None:
            nonlocal held
            for learned, parts in fresh.items():
                if parts:
                    own, counts = np.unique(np.concatenate(parts), return_counts=True)
                    found.append((own, counts if learned else np.zeros(len(own), dtype=np.int64)))
                    parts.clear()
            if len(found) > 8:
                found[:] = [_merged(found)]
            held = 0

        for learned, body in zip(train, _bodies(table), strict=True):
            fresh[learned].append(grams(body, depth))
            held += len(body)
            if held > 1 << 22:
                settle()
            spelled = [*WORD.findall(body.tobytes()), b""]  # the end is the word without letters
            if learned:
                words.update(spelled)
            else:
                for w in set(spelled):
                    words.setdefault(w, 0)
        settle()
        keys, counts = _merged(found)
        bucket = bucket_of_contexts(keys >> (8 * (depth - TOP) + 8), buckets)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in range(buckets):
            own = order[bounds[b]: bounds[b + 1]]
            if len(own):
                rows.append((GRAMS, b, block, pack_grams(keys[own]), pack_numbers(counts[own])))
        dealt: list[list[bytes]] = [[] for _ in range(buckets)]
        for w in words:
            dealt[zlib.crc32(w) % buckets].append(w)
        for b, own_words in enumerate(dealt):
            if own_words:
                own_words.sort()
                rows.append((WORDS, b, block, zlib.compress(b"\n".join(own_words), 1), pack_numbers(np.array([words[w] for w in own_words], dtype=np.int64))))
        return _rows(rows)
    return run


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True)


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each kind and bucket with the sums over blocks; rows come sorted by both."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    words: dict[bytes, int] = {}
    current: tuple[int, int] | None = None

    def total() -> pa.RecordBatch:
        kind, bucket = current
        if kind == GRAMS:
            keys, counts = _merged(parts)
            row = (kind, bucket, -1, pack_grams(keys), pack_numbers(counts))
        else:
            row = (kind, bucket, -1, zlib.compress(b"\n".join(words), 1), pack_numbers(np.array(list(words.values()), dtype=np.int64)))
        parts.clear()
        words.clear()
        return _rows([row]).to_batches()[0]

    for kind, bucket, _, keys, numbers in _stream(batches):
        if current is not None and current != (kind, bucket):
            yield total()
        current = (kind, bucket)
        if kind == GRAMS:
            parts.append((unpack_grams(keys), unpack_numbers(numbers)))
            if len(parts) > 16:
                parts[:] = [_merged(parts)]
        else:
            for w, n in zip(zlib.decompress(keys).split(b"\n"), unpack_numbers(numbers).tolist(), strict=True):
                words[w] = words.get(w, 0) + n
    if current is not None:
        yield total()


def _nodes(depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Tree nodes of the three-byte contexts of each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, keys, numbers in _stream(batches):
            own, counts = unpack_grams(keys), unpack_numbers(numbers)
            for i in range(8):
                level = ct.subtree(own, counts, depth, TOP, i)[-1]
                yield _level(i, level)
    return run


def _level(i: int | np.ndarray, level: ct.Level) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(i, len(level.key)).astype(np.int32)), *map(pa.array, (level.key, level.n0, level.n1, level.weighted))],
                                      names=["i", "key", "n0", "n1", "weighted"])


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy() for c in batch.columns]


def _mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes with their children's sums (``weighted`` is the children's product) to nodes with their own weighted probability."""
    for batch in batches:
        i, key, n0, n1, product = _columns(batch)
        estimate = ct.kt(n0, n1)
        yield _level(i, ct.Level(key, n0, n1, estimate, ct.HALF + np.logaddexp(estimate, product)))


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes joined with their parents' paths to their own paths."""
    for batch in batches:
        i, key, n0, n1, weighted, mixed, left, last = _columns(batch)
        seen, one = (n0 + n1) > 0, (n1 + 0.5) / (n0 + n1 + 1.0)
        own = np.where(seen, one, last)
        weight = np.where(seen, np.exp(np.minimum(0.0, ct.HALF + ct.kt(n0, n1) - weighted)), 1.0)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(key), *map(pa.array, (mixed + left * weight * own, left * (1 - weight), own))], names=["i", "key", "mixed", "left", "last"])


def _parent(key: Column, i: Column) -> Column:
    """Key of the node with a context shorter by its oldest byte, as ``contexttree.parent_key``."""
    scale = F.pow(F.lit(2), i).cast("long")
    return F.floor(key / (scale * 256)).cast("long") * scale + key % scale


def paths(nodes: DataFrame) -> DataFrame:
    """Paths of the three-byte nodes through all shorter contexts."""
    levels = [materialize(nodes, "nodes")]
    for _ in range(TOP):
        below = levels[-1].select("i", _parent(F.col("key"), F.col("i")).alias("key"), "n0", "n1", "weighted")
        sums = below.groupBy("i", "key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("weighted"))
        levels.append(materialize(sums.mapInArrow(_mix, NODE_SQL), "nodes"))
    above = levels[-1].select("i", "key", F.lit(0.0).alias("mixed"), F.lit(1.0).alias("left"), F.lit(0.5).alias("last"))
    for depth, level in enumerate(reversed(levels)):
        parent = F.col("key") if depth == 0 else _parent(F.col("key"), F.col("i"))
        up = above.select(F.col("i").alias("up_i"), F.col("key").alias("up_key"), "mixed", "left", "last")
        joined = level.withColumn("parent", parent).join(up, (F.col("i") == F.col("up_i")) & (F.col("parent") == F.col("up_key")))
        above = joined.select("i", "key", "n0", "n1", "weighted", "mixed", "left", "last").mapInArrow(_descend, PATH_SQL)
    return materialize(above, "paths")


def _probabilities(depth: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A bucket's grams with the log10 of their byte's probability."""
    def run(counted: pa.Table, top: pa.Table) -> pa.Table:
        if not counted.num_rows:
            return PACKED.empty_table()
        bucket = counted.column("bucket")[0].as_py()
        keys, counts = unpack_grams(counted.column("keys")[0].as_py()), unpack_numbers(counted.column("numbers")[0].as_py())
        at_i, at_key, mixed, left, last = (top.column(c).to_numpy() for c in ("i", "key", "mixed", "left", "last"))
        total = np.zeros(len(keys))
        for i in range(8):
            own = np.flatnonzero(at_i == i)
            own = own[np.argsort(at_key[own])]
            path = ct.Path(at_key[own], mixed[own], left[own], last[own])
            levels = ct.subtree(keys, counts, depth, TOP, i)[::-1]
            for d, level in enumerate(levels[1:], 1):
                path = ct.descend(level, path, i, d == len(levels) - 1)
            one = path.mixed[np.searchsorted(path.key, keys >> (8 - i))]
            total += np.log10(np.where((keys >> (7 - i)) & 1 == 1, one, 1 - one))
        return _rows([(GRAMS, bucket, -1, pack_grams(keys), pack_numbers(total.astype(np.float32)))])
    return run


def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replies to what blocks ask; of each kind and bucket the model's row (block -1) comes first."""
    keys, numbers, words = np.empty(0, dtype=np.int64), np.empty(0), {}
    for kind, bucket, block, asked, held in _stream(batches):
        if block < 0 and kind == GRAMS:
            keys, numbers = unpack_grams(asked), unpack_numbers(held)
        elif block < 0:
            words = dict(zip(zlib.decompress(asked).split(b"\n"), unpack_numbers(held).tolist(), strict=True))
        else:
            values = (numbers[np.searchsorted(keys, unpack_grams(asked))] if kind == GRAMS
                      else np.array([words[w] for w in zlib.decompress(asked).split(b"\n")], dtype=np.int64))
            yield _rows([(kind, bucket, block, asked, pack_numbers(values))]).to_batches()[0]


def _score(depth: int, total: int, distinct: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"]

    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        keys, values, base, known = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.float32)], {}, set()
        for kind, _, _, asked, held in zip(*[replies.column(i).to_pylist() for i in range(5)], strict=True):
            if kind == GRAMS:
                keys.append(unpack_grams(asked))
                values.append(unpack_numbers(held))
            else:
                counts = unpack_numbers(held)
                logs = np.log10((counts + 0.5) / (total + 0.5 * (distinct + 1)))
                own = zlib.decompress(asked).split(b"\n")
                base.update(zip(own, logs.tolist(), strict=True))
                known.update(w for w, n in zip(own, counts.tolist(), strict=True) if n)
        every, logp = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(every, kind="stable")  # sorted stretches, one a bucket
        every, logp = every[order], logp[order].astype(np.float64)
        out: list[tuple] = []
        for train, body in zip(texts.column("train").to_pylist(), _bodies(texts), strict=True):
            words = WORD.findall(body.tobytes())
            words.append(b"")
            score = float(logp[np.searchsorted(every, np.sort(grams(body, depth)))].sum())  # in order, neighbours are looked up together
            out.append((not train, len(words), sum(map(known.__contains__, words)), total, sum(map(base.__getitem__, words)), score, len(body)))
        kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
        columns = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
        return pa.Table.from_arrays([texts.column("doc_id").combine_chunks(), *columns], names=names)
    return run


def held_out(doc_id: str, fold: int = 1) -> Column:
    """Documents that are not learned from; a NULL id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == fold


def score_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = 5, block_bytes: int = 24 << 20, buckets: int = 256) -> DataFrame:
    """Scores of all texts by a model of those that are not held out.

    Result: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes``.  ``score`` is the log10
    probability that the context trees of ``depth`` bytes (3 to 6) give to the bytes, A-Z in lower case, and the end;
    -score / ((n_bytes + 1) * log10(2)) is the code length per byte in bits.  ``base_score`` is that of single words and the
    end by their training counts.  NULL texts are empty; repeated rows and NULL ids are documents of their own; other
    columns are ignored; without training texts every decision has probability one half; no rows, no result.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), (~held_out(doc_id)).alias("train"))
    size = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = size // block_bytes + 1
    blocked = slim.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    asked = materialize(blocked.select("block", "train", "text").groupBy("block").applyInArrow(ask(depth, buckets), PACKED_SQL), "asked")
    by_bucket = asked.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket")
    counted = materialize(by_bucket.mapInArrow(add_up, PACKED_SQL), "counted")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, _, numbers in _stream(batches):
            counts = unpack_numbers(numbers)
            yield pa.RecordBatch.from_arrays([pa.array([int(counts.sum())]), pa.array([int((counts > 0).sum())])], names=["total", "known"])

    words, grams_of = counted.filter(F.col("kind") == WORDS), counted.filter(F.col("kind") == GRAMS)
    total, known = words.mapInArrow(totals, "total long, known long").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    top = paths(grams_of.mapInArrow(_nodes(depth), NODE_SQL))

    @F.pandas_udf("int")
    def bucket_of_nodes(context: pd.Series) -> pd.Series:
        return pd.Series(bucket_of_contexts(context.to_numpy(dtype=np.int64), buckets))

    placed = top.withColumn("bucket", bucket_of_nodes(F.floor(F.col("key") / F.pow(F.lit(2), F.col("i"))).cast("long")))
    model = grams_of.groupBy("bucket").cogroup(placed.groupBy("bucket")).applyInArrow(_probabilities(depth), PACKED_SQL)
    both = asked.unionByName(materialize(model, "model")).unionByName(words)
    replies = both.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "block").mapInArrow(answer, PACKED_SQL)
    kind = docs.schema[doc_id].dataType.simpleString()
    return (blocked.groupBy("block").cogroup(replies.groupBy("block"))
            .applyInArrow(_score(depth, total, known), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"))
