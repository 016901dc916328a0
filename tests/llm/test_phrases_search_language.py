"""Phrases, reversed search and language identification against plain versions."""

import math
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import plain
from relish.llm import collocations, doublearray, language_id, reversed_search

SCHEMA = "doc_id long, text string, lang string, n long, score double, item_id string, rank int"


def frame(spark, rows):
    """(doc_id, text, lang) with further columns whose names clash with those of results and steps."""
    return spark.createDataFrame([(*r, 1, 0.5, "x", 7) for r in rows], SCHEMA)


# --- phrases ---------------------------------------------------------------------------------------------------------

def plain_phrases(rows, least, cover, top, longest=4):
    counts, totals = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", plain.lower(text)):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            for k in range(1, longest + 1):
                counts.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    phrases = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    covered = {(p[0], *p[i:j]) for p, a in phrases.items() for i in range(1, len(p)) for j in range(i + 2, len(p) + 1)
               if j - i < len(p) - 1 and 100 * a >= cover * phrases[(p[0], *p[i:j])]}
    out = {}
    for p, a in phrases.items():
        if p not in covered:
            cuts = [(counts[p[:k]], counts[(p[0], *p[k:])]) for k in range(2, len(p))]
            score, _, (l, r) = min((2_000_000 * a // (l + r), i, (l, r)) for i, (l, r) in enumerate(cuts))
            out.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top]))


def phrase_rows(words):
    r, rows = random.Random(4), []
    few = words[:12]
    for i in range(120):
        w = [r.choice(few) for _ in range(30)]
        if i % 3 == 0:
            w[5:9] = ["New", "york", "City", "ñandú"]
        if i % 4 == 0:
            w[12:15] = ["ha", "ha", "ha"]
        rows.append((i, " ".join(x + r.choice(["", "", "", ",", ".", "\n", "\t"]) for x in w), r.choice(["en", "en", "de", None])))
    return rows + [(200, None, "en"), (201, "", "en"), (None, " \t\n.", "de"), (202, "!?" * 50, None), (0, rows[0][1], rows[0][2]), (0, rows[0][1], rows[0][2]),
                   (203, "ha " * 5000, "en"), (204, "\x00a b\x0bc d\r" * 20, "")]


@pytest.mark.parametrize(("least", "top", "block"), [(4, 2000, 1 << 18), (3, 5, 40)])
def test_phrases(spark, words, least, top, block):
    rows = phrase_rows(words)
    got = sorted(tuple(r) for r in collocations.mine(frame(spark, rows), least=least, top=top, block=block).collect())
    assert got == plain_phrases(rows, least, 80, top)


def test_phrases_of_nothing(spark):
    got = collocations.mine(frame(spark, []))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and not got.count()
    assert not collocations.mine(frame(spark, [(1, None, None), (2, "one two", "en")])).count()


def test_long_texts_are_cut_between_words(words, monkeypatch):
    monkeypatch.setattr(collocations, "STRETCH", 200)
    r = random.Random(1)
    texts = [" ".join(r.choice(words[:5]) + r.choice(["", "", ", "]) for _ in range(3000)), "x" * 1000 + " " + "y" * 700 + " z " * 400, None, "ab cd"]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 4), pa.array(texts)], names=["lang", "text"])
    rows = list(collocations._encoder(4)(iter([batch])))
    assert len(rows) > 50
    monkeypatch.setattr(collocations.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 3))
    everything = SimpleNamespace(value=[np.full(collocations.MAP_WORDS, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)] * 4)
    counted, named = Counter(), {}
    for row in rows:
        spelled = row.column("words")[0].as_py().decode().split("\n")[:-1]
        counted.update(dict(zip(spelled, np.frombuffer(row.column("counts")[0].as_py(), dtype=np.int32).tolist(), strict=True)))
        named.update(zip(np.frombuffer(row.column("hashes")[0].as_py(), dtype=np.int64).tolist(), spelled, strict=True))
    rows = [row.select(["own", "hashes", "codes"]) for row in rows]
    assert +counted == Counter(w for t in all_words(texts) for w in t)
    found = {tuple(named[h] for h in path) for b in collocations._candidates(4, everything, SimpleNamespace(value=everything.value[0]), 1)(iter(rows)) for path in b.column("path").to_pylist()}
    want = Counter(tuple(p[i : i + k]) for t in texts for p in (re.findall("[^ \t]+", x) for x in (t or "").split(",")) for k in (2, 3, 4) for i in range(len(p) - k + 1))
    assert found == set(want)
    paths = sorted(found)
    symbols = np.sort(np.array(list(named), dtype=np.int64).view(np.uint64))
    code = {w: int(np.searchsorted(symbols, np.int64(h).view(np.uint64))) + 1 for h, w in named.items()}
    table = np.array([[code[w] for w in p] + [0] * (4 - len(p)) for p in paths])
    trie, ends = doublearray.build(table, len(symbols))
    out = next(iter(collocations._walk(SimpleNamespace(value=(symbols, trie, 4)))(iter(rows))))
    reached = dict(zip(out.column("state").to_pylist(), out.column("n").to_pylist(), strict=True))
    assert {p: reached[e] for p, e in zip(paths, ends.tolist(), strict=True)} == want


def all_words(texts):
    return [re.findall("[^ \t,]+", t or "") for t in texts]


def test_double_array():
    r = random.Random(3)
    paths = list({tuple(min(r.randrange(1, 300), r.randrange(1, 300)) for _ in range(r.randrange(1, 5))) for _ in range(5000)})
    table = np.array([[*p, *[0] * (4 - len(p))] for p in paths])
    trie, ends = doublearray.build(table, 300)
    assert len(set(ends.tolist())) == len(paths)  # each path has a state of its own
    walks = paths + [tuple(r.randrange(301) for _ in range(4)) for _ in range(2000)]
    known = {p[:k]: None for p in paths for k in range(1, len(p) + 1)}
    at, states = np.arange(len(walks)), np.zeros(len(walks), dtype=np.int64)
    for depth in range(4):
        symbols = np.array([walks[i][depth] if depth < len(walks[i]) else 0 for i in at])
        on, states = trie.step(states, symbols)
        at = at[on]
        assert at.tolist() == [i for i, w in enumerate(walks) if len(w) > depth and w[: depth + 1] in known]
        assert all(s == e for s, i in zip(states, at, strict=True) if len(walks[i]) == depth + 1 and i < len(paths) for e in [ends[i]])


# --- reversed search -------------------------------------------------------------------------------------------------

def plain_search(docs, items, top):
    terms = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    counted = [(key, Counter(terms.findall(plain.lower(text)))) for key, text, _ in docs]
    counted = [(key, c) for key, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for item, text in set(items):
        asked.setdefault(item, Counter()).update(terms.findall(plain.lower(text)))
    out = []
    for item, query in asked.items():
        best = []
        for key, c in counted:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in query.items() if c[t])
            if score > 0:
                best.append((-score, key is None, key or 0))
        out += [(item, i + 1, None if none else key, -s) for i, (s, none, key) in enumerate(sorted(best)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("top", "block"), [(20, 1 << 18), (3, 30)])
def test_search(spark, words, top, block):
    r = random.Random(8)
    docs = [(i, " ".join(r.choice(words[: r.choice([20, 1000])]) for _ in range(r.randrange(1, 80))), None) for i in range(150)]
    docs += [(200 + i, docs[0][1], "en") for i in range(30)] + [(5, docs[7][1], None)] * 2 + [(None, docs[3][1], "x"), (300, None, None), (301, "", None), (302, " .,@[`{~", None),
             (303, " ".join(r.choice(words) for _ in range(30_000)), None), (304, "Ünï-ñandú ÜNÏ 12ab", None)]
    items = [(f"q{i}", " ".join(r.choice(words[:60]) for _ in range(12)) + "!") for i in range(9)]
    items += [("q0", items[0][1]), ("two", words[1]), ("two", words[2] + " " + words[1]), (None, docs[0][1]), ("none", "nowhere-to-be-found"), ("empty", None), ("blank", " "), ("long", docs[9][1] * 50), ("ü", "ünï ñandú Ünï")]
    table = spark.createDataFrame([(i, t, 1, "x", 0.5) for i, t in items], "item_id string, text string, doc_id long, term string, score double")
    got = reversed_search.search(frame(spark, docs), table, top=top, block=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(x) for x in got.collect()), key=str) == plain_search(docs, items, top)


def test_search_of_nothing(spark):
    items = spark.createDataFrame([("a", "one")], "item_id string, text string")
    assert not reversed_search.search(frame(spark, []), items).count()
    assert not reversed_search.search(frame(spark, [(1, None, None)]), items).count()
    assert not reversed_search.search(frame(spark, [(1, "one", None)]), items.limit(0)).count()


def test_heaps_keep_the_best_whatever_the_order():
    r = random.Random(2)
    rows = [(r.randrange(3), r.randrange(1, 40), i) for i in range(3000)]
    heaps = reversed_search.Heaps(3, 4, pa.int64())
    heaps.limit = 50
    for start in range(0, 3000, 17):
        part = [x for x in rows[start : start + 17] if x[1] >= heaps.low[x[0]]]
        heaps.add(np.array([x[0] for x in part], dtype=np.int64), np.array([x[1] for x in part], dtype=np.int64), pa.array([x[2] for x in part], pa.int64()))
    got = [tuple(x.values()) for x in heaps.shrink().to_pylist()]
    assert got == [x for item in range(3) for x in sorted((x for x in rows if x[0] == item), key=lambda x: (-x[1], x[2]))[:4]]


# --- language --------------------------------------------------------------------------------------------------------

ALPHABETS = {"aa": "abcdefghij ", "bb": "fghijklmno ", "ññ": "ñáéíóúabc ", "рр": "абвгдежз "}


def language_rows():
    r = random.Random(6)
    rows = [(i, "".join(r.choice(ALPHABETS[g]) for _ in range(r.randrange(20, 200))), g) for i, g in ((i, r.choice(list(ALPHABETS))) for i in range(400))]
    return rows + [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !? 四²", None), (1003, "12 -- ²", "aa"), (None, rows[0][1], rows[0][2]), (1004, rows[1][1], None), (1005, "abcab " * 60_000, None)] + [rows[2]] * 3


def test_languages_of_held_out_texts(spark):
    rows = language_rows()
    got = language_id.identify(frame(spark, rows), settings=language_id.Settings(bits=14))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    found = got.collect()
    assert len(found) == len(rows) and all(0 <= x.score <= 1 for x in found)
    assert {x.doc_id: (x.lang_pred, x.score) for x in found if x.doc_id in (1000, 1001, 1003)} == {i: ("und", 0.0) for i in (1000, 1001, 1003)}
    truth = {i: g for i, _, g in rows if i is not None and i < 1000}
    held = [x for x in found if x.held_out and x.doc_id in truth]
    assert len(held) > 80 and sum(x.lang_pred == truth[x.doc_id] for x in held) >= 0.97 * len(held)
    assert len({(x.lang_pred, x.score) for x in found if x.doc_id == 2}) == 1


def test_held_out_texts_and_other_columns_teach_nothing(spark):
    rows = [r for r in language_rows() if r[0] is not None and r[0] < 1000]
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    other = [(i, t, "zz" if i in held else g) for i, t, g in rows]
    s = language_id.Settings(bits=12, passes=2)
    one, two = (sorted((x.doc_id, x.lang_pred, round(x.score, 9)) for x in language_id.identify(frame(spark, d).withColumn("score", F.lit(float(n))), settings=s).collect()) for n, d in enumerate((rows, other)))
    assert one == two


def test_languages_of_nothing(spark):
    assert not language_id.identify(frame(spark, [])).count()
    got = [(x.lang_pred, x.score) for x in language_id.identify(frame(spark, [(1, "abc", None), (2, None, "en")])).collect()]
    assert got == [("und", 0.0)] * 2
    alone = [(x.lang_pred, x.score) for x in language_id.identify(frame(spark, [(i, "abc def", "en") for i in range(9)])).collect()]
    assert alone == [("en", 1.0)] * 9


def test_grams_across_stretches(monkeypatch):
    r = random.Random(5)
    text = "".join(r.choice("ab Ñ1.é") for _ in range(5000))
    whole = language_id.grams(text, 10)
    monkeypatch.setattr(language_id, "STRETCH", 7)
    parts = language_id.grams(text, 10)
    assert [x.tolist() for x in whole] == [x.tolist() for x in parts]
    letters = " " + re.sub(r"[^abñé]+", " ", text.lower()).lstrip(" ")
    assert whole[1].sum() == sum(len(letters) - n + 1 - (n == 1) for n in range(1, 5))
    assert not len(language_id.grams("1234 -- ²", 10)[0])


def test_learning_is_the_plain_method():
    """A pass over a shard equals the per-coordinate updates written out."""
    r = np.random.default_rng(3)
    s = language_id.Settings(bits=5, alpha=0.7, beta=0.9, l1=0.05, l2=0.2)
    rows = [(int(k), int(r.integers(3)), np.sort(r.choice(32, 6, replace=False)).astype(np.uint32), r.random(6).astype(np.float32)) for k in r.permutation(60)]
    z, n = np.zeros((32, 3)), np.zeros((32, 3))
    language_id.learn(((y, at, x) for _, y, at, x in sorted(rows, key=lambda row: row[0])), z, n, s)
    zp, np_ = [[0.0] * 3 for _ in range(32)], [[0.0] * 3 for _ in range(32)]
    for _, y, at, x in sorted(rows, key=lambda row: row[0]):
        w = {(i, c): 0.0 if abs(zp[i][c]) <= s.l1 else -(zp[i][c] - math.copysign(s.l1, zp[i][c])) / ((s.beta + math.sqrt(np_[i][c])) / s.alpha + s.l2) for i in at for c in range(3)}
        logits = [sum(float(v) * w[i, c] for i, v in zip(at, x, strict=True)) for c in range(3)]
        p = [math.exp(v) / sum(map(math.exp, logits)) for v in logits]
        for i, v in zip(at, x, strict=True):
            for c in range(3):
                g = (p[c] - (c == y)) * float(v)
                zp[i][c] += g - (math.sqrt(np_[i][c] + g * g) - math.sqrt(np_[i][c])) / s.alpha * w[i, c]
                np_[i][c] += g * g
    assert np.allclose(z, zp) and np.allclose(n, np_)
    assert (language_id.coefficients(z, n, s) == 0).any()


def test_encoded_texts_are_read_a_few_rows_at_a_time(spark):
    """Neither the reader nor a worker holds more than some dozen rows of hundreds of kilobytes; other reads are left alone."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(n) for n in names]
    with collocations._small_batches(spark):
        assert all(int(spark.conf.get(n)) <= 32 for n in names)
    assert [spark.conf.get(n) for n in names] == before


def test_small_rows_come_to_the_driver_in_large_batches(spark):
    """Numbers that are collected while encoded texts are read are not cut into batches of a few rows."""
    with collocations._small_batches(spark):
        found = collocations._collected(spark.range(0, 1000, 1, 1))
    assert found.num_rows == 1000 and found.column("id").num_chunks == 1


def test_texts_are_encoded_some_hundred_at_a_time(spark, monkeypatch):
    """Whole texts go to a worker in batches far below Spark's 10,000 rows."""
    sizes, materialize = [], collocations.materialize

    def watched(df, label):
        sizes.append((label, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))))
        return materialize(df, label)
    monkeypatch.setattr(collocations, "materialize", watched)
    docs = spark.range(40).selectExpr("id as doc_id", "'one two three' as text", "'en' as lang")
    assert collocations.mine(docs, least=30).count() > 0
    assert dict(sizes)["encoded"] <= 1000
