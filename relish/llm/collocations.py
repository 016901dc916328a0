"""Phrases whose words stand together more often than apart, mined with broadcast tries.

1. Texts are encoded once, in stretches of some hundred kilobytes: the distinct words of a stretch and, for each position,
   the place of its word among them (0 where a piece ends).  A word's hash holds its language.
2. Word counts are exact sums.  For 2, 3, ... words, a phrase whose two parts of one word less may be frequent adds to a hashed
   bucket; buckets that reach the least count say which phrases may be frequent.  So much is known of what may be
   frequent as a bitmap of fixed size holds: with more entries it says yes more often, and never no wrongly.
3. Phrases that all bitmaps allow are the candidates, whatever a collision lets in.  Blocks of them become double-array tries
   (``doublearray``) of bounded size.  Each task lets all positions of a stretch walk the broadcast trie together, a level
   at a time, and counts the states they reach; sums over the tasks are the exact counts.

Words and phrases are taken for their 64-bit hashes while they are counted.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from relish.llm import arrowtext, doublearray, texthash
from relish.session import materialize

#: bytes of text that are encoded together; a longer text is cut between two words
STRETCH = 1 << 18
#: 64-bit words of a bitmap, 8 MB whatever the input
MAP_WORDS = 1 << 20
#: phrases a task gathers before it adds them up and passes them on
GATHERED = 1 << 20
#: rows of a batch that a task passes on
SENT = 1 << 16
#: texts, and encoded stretches of some hundred kilobytes, that go to a worker at a time
TEXTS, STRETCHES = 512, 8

_U = np.uint64
_STEP = _U(0xC2B2AE3D27D4EB4F)
_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False
_GAP = re.compile(rb"[ \t.,;:!?\n-\r]")
ENCODED = "lang string, own int, hashes binary, counts binary, words binary, codes binary"


def _overlap(longest: int) -> re.Pattern:
    return re.compile(rb"(?:[ \t]*[^ \t.,;:!?\n-\r]+){0,%d}" % (longest - 1))


def _cut(data: bytes, longest: int) -> Iterator[tuple[bytes, int]]:
    """Stretches of a text, each with the words behind it that a phrase begun in it may need, and its own length."""
    at, behind = 0, _overlap(longest)
    while len(data) - at > STRETCH:
        gaps = np.flatnonzero(~_WORD[np.frombuffer(data, dtype=np.uint8, count=STRETCH, offset=at)])
        if len(gaps) and gaps[-1]:
            cut = at + int(gaps[-1])
        else:
            gap = _GAP.search(data, at + STRETCH)
            cut = gap.start() if gap else len(data)
        yield data[at : behind.match(data, cut).end()], cut - at
        at = cut
    yield data[at:], len(data) - at


def _encode(lang: str, data: bytes, own: int) -> pa.RecordBatch | None:
    """One stretch as a row of ``ENCODED``; None without words of its own."""
    text = texthash.lower(data)
    starts, ends = texthash.words(text, _WORD)
    n_own = int(np.searchsorted(starts, own))
    if not n_own:
        return None
    seed = texthash.mix(np.array([hash_of(lang)], dtype=_U))
    hashes = texthash.mix(texthash.stretches(texthash.prefix_sums(text), starts, ends - starts) ^ seed)
    distinct, at, place = np.unique(hashes, return_index=True, return_inverse=True)
    counts = np.bincount(place[:n_own], minlength=len(distinct))
    pieces = np.cumsum(_BREAK[text])[starts]
    position = np.arange(len(starts)) + np.cumsum(np.diff(pieces, prepend=pieces[0]) > 0)
    codes = np.zeros(int(position[-1]) + 1, dtype=np.int32)
    codes[position] = place + 1
    lengths = (ends - starts)[at] + 1  # and a line break, which no word holds
    offsets = np.cumsum(lengths) - lengths
    source = np.repeat(starts[at] - offsets, lengths) + np.arange(lengths.sum())
    spelled = text[np.minimum(source, len(text) - 1)]
    spelled[offsets + lengths - 1] = 0x0A
    parts = [distinct, counts.astype(np.int32), spelled, codes]
    columns = [pa.array([lang]), pa.array([int(position[n_own - 1]) + 1], pa.int32()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "own", "hashes", "counts", "words", "codes"])


def hash_of(name: str) -> int:
    """A number for a language."""
    data = name.encode()
    return int(texthash.stretches(texthash.prefix_sums(np.frombuffer(data, dtype=np.uint8)), np.array([0]), np.array([len(data)]))[0]) if data else 1


def _encoder(longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def encoded(lang: str, data: bytes, own: int) -> Iterator[pa.RecordBatch]:
            row = _encode(lang, data, own)
            if row is not None:
                yield row

        for batch in batches:
            for lang, data in zip(batch.column(0).to_pylist(), arrowtext.texts(batch, "text"), strict=True):
                if len(data) > STRETCH:
                    for part, own in _cut(bytes(data), longest):
                        yield from encoded(lang, part, own)
                    continue
                held.setdefault(lang, []).append(bytes(data))
                sizes[lang] = sizes.get(lang, 0) + len(data)
                if sizes[lang] > STRETCH:
                    joined = b"\n".join(held.pop(lang))
                    sizes[lang] = 0
                    yield from encoded(lang, joined, len(joined))
        for lang, parts in held.items():
            joined = b"\n".join(parts)
            yield from encoded(lang, joined, len(joined))
    return run


def _small_batches(spark: SparkSession):
    """While encoded texts are read, whose rows are hundreds of kilobytes each, few of them are decoded and go to a worker at a time."""
    return arrowtext.batches(spark, STRETCHES, STRETCHES)


def _collected(rows: DataFrame) -> pa.Table:
    """Rows of some numbers on the driver, in batches of their own size and not in those of large rows."""
    with arrowtext.batches(rows.sparkSession, SENT, 4096):
        return rows.toArrow()


def bitmap(keys: DataFrame, key: str) -> np.ndarray:
    """Bits of the long ``key``s (low bits name the place), gathered as at most ``MAP_WORDS`` rows."""
    place = F.col(key).bitwiseAND(F.lit(64 * MAP_WORDS - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(key).bitwiseAND(F.lit(63)).cast("int"))
    found = _collected(keys.groupBy(F.shiftright(place, 6).cast("int").alias("word")).agg(F.bit_or(one).alias("bits")))
    out = np.zeros(MAP_WORDS, dtype=_U)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(_U)
    return out


def _in(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return (bits[((keys & _U(64 * MAP_WORDS - 1)) >> _U(6)).astype(np.int64)] >> (keys & _U(63))) & _U(1) == 1


def _numbers(value: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), dtype=kind)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Own positions, word hashes and codes of each stretch."""
    for batch in batches:
        for own, hashes, codes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            yield own, _numbers(hashes, _U), _numbers(codes, np.int32)


def _allowed(hashes: np.ndarray, codes: np.ndarray, maps: list[np.ndarray], upto: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For k = 1, 2, ... ``upto``: starts of k-word phrases that the bitmaps allow, and the phrases' hashes.

    Both parts of k - 1 words must have been allowed; the last k has no bitmap of its own if there are only k - 1.
    """
    known = np.concatenate([[False], _in(maps[0], hashes)])
    word = np.concatenate([np.zeros(1, dtype=_U), hashes])[codes]
    allowed = known[codes]
    at = np.flatnonzero(allowed)
    keys = word[at]
    yield 1, at, keys
    for k in range(2, upto + 1):
        allowed = np.append(allowed, False)
        both = allowed[at + 1]
        at, keys = at[both], keys[both]
        keys = texthash.mix(keys * _STEP + word[at + k - 1])
        if k <= len(maps):
            frequent = _in(maps[k - 1], keys)
            at, keys = at[frequent], keys[frequent]
        allowed = np.zeros(len(codes), dtype=bool)
        allowed[at] = True
        yield k, at, keys


def _summed(held: list[tuple[np.ndarray, np.ndarray]], *names: str, lang: str | None = None) -> Iterator[pa.RecordBatch]:
    """Counts of equal keys added up, in small batches."""
    keys = np.concatenate([k for k, _ in held])
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.add.reduceat(np.concatenate([n for _, n in held])[order].astype(np.int64), first)
    columns = [pa.array(keys[first].view(np.int64)), pa.array(counts)]
    whole = pa.RecordBatch.from_arrays(columns if lang is None else [pa.array([lang] * len(first), pa.string()), *columns], names=list(names))
    for at in range(0, len(first), SENT):
        yield whole.slice(at, SENT)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts of its words."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, hashes, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            held.setdefault(lang, []).append((_numbers(hashes, _U), _numbers(counts, np.int32)))
            sizes[lang] = sizes.get(lang, 0) + len(held[lang][-1][0])
            if sizes[lang] > GATHERED:
                sizes[lang] = 0
                yield from _summed(held.pop(lang), "lang", "hash", "n", lang=lang)
    for lang, rows in held.items():
        yield from _summed(rows, "lang", "hash", "n", lang=lang)


def _spelled(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Words that may be frequent; a task tells each once for every ``GATHERED`` of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, bytes] = {}

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary()).cast(pa.string())], names=["hash", "word"])

        for batch in batches:
            for hashes, words in zip(batch.column(0), batch.column(1), strict=True):
                keys, spelled = _numbers(hashes, _U), words.as_py()
                ends = np.flatnonzero(np.frombuffer(spelled, dtype=np.uint8) == 0x0A)
                starts = np.concatenate([[0], ends[:-1] + 1])
                likely = np.flatnonzero(_in(shared.value[0], keys))
                for key, start, end in zip(keys[likely].view(np.int64).tolist(), starts[likely].tolist(), ends[likely].tolist(), strict=True):
                    if key not in found:
                        found[key] = spelled[start:end]
                if len(found) > GATHERED // 8:
                    yield told()
                    found.clear()
        if found:
            yield told()
    return run


def _buckets(k: int, maps) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hashes of the k-word phrases that may be frequent, with a task's sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for own, hashes, codes in _rows(batches):
            *_, (_, at, keys) = _allowed(hashes, codes, maps.value, k)
            found, counts = np.unique(keys[at < own], return_counts=True)
            held.append((found, counts.astype(np.int32)))
            n += len(found)
            if n > GATHERED:
                yield from _summed(held, "bucket", "n")
                held, n = [], 0
        if n:
            yield from _summed(held, "bucket", "n")
    return run


def _candidates(longest: int, maps, wanted, share: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hashes and words of the phrases that the bitmaps allow and ``wanted`` holds: those whose turn it is in this task.

    Of ``share`` tasks that meet a phrase one tells it, by a hash of both, once for every ``GATHERED`` of them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = texthash.mix(np.array([TaskContext.get().partitionId() + 1], dtype=_U))
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        n = 0

        def told() -> Iterator[pa.RecordBatch]:
            for k, rows in held.items():
                keys, first = np.unique(np.concatenate([keys for keys, _ in rows]), return_index=True)
                phrases = np.concatenate([paths for _, paths in rows])[first].view(np.int64).reshape(-1)
                paths = pa.ListArray.from_arrays(pa.array(np.arange(0, len(phrases) + 1, k), pa.int32()), pa.array(phrases))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), paths], names=["key", "path"])

        for own, hashes, codes in _rows(batches):
            word = np.concatenate([np.zeros(1, dtype=_U), hashes])
            for k, at, keys in _allowed(hashes, codes, maps.value, longest):
                if k == 1:
                    continue
                mine = np.flatnonzero((at < own) & (texthash.mix(keys ^ turn) % _U(share) == 0) & _in(wanted.value, keys))
                distinct, first = np.unique(keys[mine], return_index=True)
                held.setdefault(k, []).append((distinct, word[codes[at[mine[first]][:, None] + np.arange(k)]]))
                n += len(distinct) * k
            if n > GATHERED:
                yield from told()
                held, n = {}, 0
        yield from told()
    return run


def _walk(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """How often each state of the trie is reached from the positions of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, trie, longest = shared.value
        reached, held, n = np.zeros(trie.size, dtype=np.int64), [], 0
        for own, hashes, codes in _rows(batches):
            place = np.minimum(np.searchsorted(symbols, hashes), len(symbols) - 1)
            symbol = np.concatenate([[0], np.where(symbols[place] == hashes, place + 1, 0)])[codes]
            at = np.flatnonzero(symbol[:own])
            states = np.zeros(len(at), dtype=np.int64)
            for depth in range(longest):
                inside = at + depth < len(symbol)
                at, states = at[inside], states[inside]
                on, states = trie.step(states, symbol[at + depth])
                at = at[on]
                if depth:
                    held.append(states)
                    n += len(states)
            if n > GATHERED:
                reached += np.bincount(np.concatenate(held), minlength=trie.size)
                held, n = [], 0
        if held:
            reached += np.bincount(np.concatenate(held), minlength=trie.size)
        states = np.flatnonzero(reached)
        yield pa.RecordBatch.from_arrays([pa.array(states), pa.array(reached[states])], names=["state", "n"])
    return run


def _counted(slots: DataFrame, candidates: DataFrame, longest: int, least: int, block: int) -> DataFrame:
    """``path, a``: candidates with exact counts of ``least`` or more, one pass over the encoded texts for each block of them."""
    spark = slots.sparkSession
    blocks = candidates.count() // block + 1
    named = candidates.withColumn("block", F.pmod(F.xxhash64("path"), F.lit(blocks)))
    out = spark.createDataFrame([], "path array<long>, a long")
    for b in range(blocks):
        paths = _collected(named.filter(F.col("block") == b).select("path")).column("path").combine_chunks()
        if not len(paths):
            continue
        flat, lengths = paths.flatten().to_numpy().view(_U), paths.value_lengths().to_numpy()
        symbols, code = np.unique(flat, return_inverse=True)
        table = np.zeros((len(lengths), longest), dtype=np.int64)
        table[np.arange(longest) < lengths[:, None]] = code + 1
        trie, ends = doublearray.build(table, len(symbols))
        shared = spark.sparkContext.broadcast((symbols, trie, longest))
        reached = slots.mapInArrow(_walk(shared), "state long, n long").groupBy("state").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        sums = _collected(materialize(reached, "reached"))
        counts = np.zeros(trie.size, dtype=np.int64)
        counts[sums.column("state").to_numpy()] = sums.column("n").to_numpy()
        shared.destroy()
        frequent = np.flatnonzero(counts[ends])
        if len(frequent):
            found = pa.table({"path": paths.take(pa.array(frequent)), "a": pa.array(counts[ends[frequent]])})
            out = out.unionByName(materialize(spark.createDataFrame(found), "counted"))
    return out


def count_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 4, least: int = 30, block: int = 1 << 18) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exact counts: of all words of a language (``lang, n``), and of what stands there ``least`` times or more, words (``lang, word,
    n``) and phrases (``lang, words, a``) of 2 to ``longest`` words.

    ``block`` bounds the candidates of one broadcast trie; each block costs one more pass over the encoded texts.
    """
    spark: SparkSession = docs.sparkSession
    slim = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    with arrowtext.batches(spark, TEXTS):
        encoded = materialize(slim.mapInArrow(_encoder(longest), ENCODED), "encoded")
    with _small_batches(spark):
        return _count(encoded, longest, least, block)


def _count(encoded: DataFrame, longest: int, least: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``count_phrases`` over the encoded texts; everything that reads them is done when it returns."""
    spark = encoded.sparkSession
    # tasks of several files add up more before they pass on sums
    encoded = encoded.coalesce(max(2 * spark.sparkContext.defaultParallelism, encoded.rdd.getNumPartitions() // 4))
    words = encoded.select("lang", "hashes", "counts").mapInArrow(_word_counts, "lang string, hash long, n long")
    words = materialize(words.groupBy("lang", "hash").agg(F.sum("n").alias("n")), "words")
    maps = [bitmap(words.filter(F.col("n") >= least), "hash")]
    shared = spark.sparkContext.broadcast(maps)
    spelled = encoded.select("hashes", "words").mapInArrow(_spelled(shared), "hash long, word string").dropDuplicates(["hash"])
    frequent = materialize(words.filter(F.col("n") >= least).join(spelled, "hash").select("lang", "hash", "word", "n"), "frequent")
    shared.destroy()
    slots, keys = encoded.select("own", "hashes", "codes"), []
    for k in range(2, longest + 1):
        shared = spark.sparkContext.broadcast(maps)
        sums = slots.mapInArrow(_buckets(k, shared), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
        keys.append(materialize(sums.filter(F.col("n") >= least).select(F.col("bucket").alias("key")), "buckets"))
        maps = [*maps, bitmap(keys[-1], "key")]
        shared.destroy()
    shared, left = spark.sparkContext.broadcast(maps), reduce(DataFrame.unionByName, keys)
    # some two tasks tell a phrase, then some eight one which none has told, then all that meet one still untold
    told, tasks = [], slots.rdd.getNumPartitions()
    for share in dict.fromkeys((max(1, tasks // 2), max(1, tasks // 8), 1)):
        wanted = spark.sparkContext.broadcast(bitmap(left, "key"))
        found = slots.mapInArrow(_candidates(longest, shared, wanted, share), "key long, path array<long>")
        told.append(materialize(found.join(left, "key", "left_semi").groupBy("key").agg(F.first("path").alias("path")), "candidates"))
        wanted.destroy()
        left = left.join(told[-1].select("key"), "key", "left_anti")
    shared.destroy()
    candidates = reduce(DataFrame.unionByName, told).select("path")
    phrases = materialize(_counted(slots, candidates, longest, least, block), "phrases")
    placed = phrases.withColumn("id", F.monotonically_increasing_id()).select("id", "a", F.posexplode("path").alias("place", "hash"))
    named = placed.join(frequent.select("hash", "lang", "word"), "hash").groupBy("id", "lang", "a").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("words"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return totals, frequent.select("lang", "word", "n"), materialize(named.select("lang", F.col("words.word").alias("words"), "a"), "phrases")


def _joined(words: Column | str) -> Column:
    return F.array_join(words, " ")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 4, least: int = 30, cover: int = 80, top: int = 2000, block: int = 1 << 18) -> DataFrame:
    """Each language's ``top`` phrases by score: ``lang, rank, phrase, a, l, r, n, score``.

    Pieces end at ``.,;:!?`` and line breaks, words at spaces and tabs, A-Z in lower case.  ``a`` is a phrase's count, ``l`` and
    ``r`` those of its parts at the cut of the lowest score floor(2000000 a / (l + r)), the first of equal ones; ``n`` is the
    language's number of words.  A phrase goes if a longer one that holds it has ``cover`` percent of its count or more.
    Equal scores go by count, then by the phrase's bytes.  A NULL text is empty, a NULL language is ``und``; repeated
    rows count each time; other columns are ignored; no frequent phrase, no result.
    """
    totals, words, phrases = count_phrases(docs, text, lang, longest, least, block)
    counts = materialize(words.select("lang", F.col("word").alias("part"), F.col("n").alias("f"))
                         .unionByName(phrases.select("lang", _joined("words").alias("part"), F.col("a").alias("f"))), "parts")
    named = phrases.select("lang", "words", _joined("words").alias("phrase"), "a")
    inner = F.filter(F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda k: F.transform(
        F.sequence(F.lit(1), F.size("words") - k + 1), lambda i: F.array_join(F.slice("words", i, k), " ")))), lambda part: part != F.col("phrase"))
    longer = named.filter(F.size("words") > 2).select("lang", F.explode(inner).alias("inner"), "a").groupBy("lang", "inner").agg(F.max("a").alias("of_longer"))
    kept = (named.join(longer.withColumnRenamed("lang", "longer_lang"), (F.col("lang") == F.col("longer_lang")) & (F.col("phrase") == F.col("inner")), "left")
            .filter(F.col("inner").isNull() | (F.lit(100) * F.col("of_longer") < F.lit(cover) * F.col("a"))).select("lang", "words", "phrase", "a"))
    cuts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", _joined(F.slice("words", F.lit(1), F.col("cut"))).alias("left"),
                       _joined(F.slice("words", F.col("cut") + 1, F.size("words"))).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("part").alias(side), F.col("f").alias(name)), ["lang", side])
    exact = F.expr("(cast(2000000 as decimal(20, 0)) * cast(a as decimal(18, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    scored = cuts.withColumn("score", exact).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    ranked = scored.selectExpr("lang", "phrase", "a", "low.l", "low.r", "low.score").selectExpr(
        "*", "row_number() over (partition by lang order by score desc, a desc, phrase) as rank").filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
