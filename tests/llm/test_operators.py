"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against plain versions."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

import plain
from relish.llm import (components, contexttree, ctw_scoring, decontaminate, jaccard_join, line_dedup, packing, preferences, prefilter, revisits, rule_ensemble,
                        suffix_dedup, winnowing)

SCHEMA = "doc_id long, text string, source string, n_chars long, score double, kept string"


def text_of(words, n, seed):
    return " ".join(random.Random(seed).choices(words, k=n))


@pytest.fixture(scope="module")
def corpus(words):
    """doc_id -> text: unique, copied, nearly copied, sharing a passage, periodic, short, empty, NULL, long."""
    base, passage = text_of(words, 120, 1), text_of(words, 30, 2)
    docs = {i: text_of(words, 60 + i, 100 + i) for i in range(12)}
    docs |= {20 + i: base.replace(base.split()[7 + 11 * i], "changed") for i in range(6)} | {30: base, 31: base.upper()}
    docs |= {40 + i: text_of(words, 20, 50 + i) + "\n" + passage + "\n" + text_of(words, 200, 70 + i) for i in range(4)}
    docs |= {50: "", 51: None, 52: "one two", 53: "One  two", 54: " \n\t ", 55: "ha ha " * 200, 56: "Ünï cödé ñandú " * 40, 57: text_of(words, 20_000, 9)}
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(k, t, "s", 1, 0.5, "x") for k, t in docs.items()], SCHEMA)


def test_near_groups_and_keep_one(spark, corpus):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_groups(frame(spark, corpus)).collect()}
    assert got == plain.near_groups(corpus)
    kept = jaccard_join.keep_one(frame(spark, corpus))
    assert kept.columns == frame(spark, {}).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, (_, c) in got.items() if c == k)


def test_near_groups_of_a_large_family(spark, words):
    base = text_of(words, 60, 5).split()
    docs = {}
    for i in range(150):  # more than the number up to which a token is rare, so combinations are indexed
        r = random.Random(i)
        own = list(base)
        own[r.randrange(len(own))] = f"w{i}"
        docs[i] = " ".join(own)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_groups(frame(spark, docs), frequent=8).collect()}
    assert got == plain.near_groups(docs)


def test_pairs_that_leaders_leave_are_all_met(spark, words, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LEADER_ROUNDS", 0)  # every pair comes from the last join
    passage, docs = text_of(words, 40, 9).split(), {}
    for i in range(90):  # families around own texts, with one passage that all share
        r = random.Random(i)
        own = text_of(words, 70, 100 + i % 6).split() + passage
        for _ in range(r.randrange(4)):
            own[r.randrange(len(own))] = f"w{r.randrange(50)}"
        docs[i] = " ".join(own)
    want = plain.near_groups(docs)
    assert 6 < len({c for _, c in want.values()}) < 90
    for frequent in (2, 8, 64):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_groups(frame(spark, docs), frequent=frequent).collect()}
        assert got == want


def test_prefilter_keeps_every_partner_and_all_columns(spark):
    rows = spark.createDataFrame([(k, k, str(k)) for k in (None, *range(3000))], "id long, at_word long, Word_Bits string")
    ids = spark.createDataFrame([(k,) for k in (None, *range(0, 3000, 7), 10**12)], "id long")
    found = prefilter.probable(rows, "id", ids)
    kept = [r.id for r in found.collect()]
    assert found.columns == rows.columns and set(kept) >= set(range(0, 3000, 7)) and None not in kept and len(kept) < 600
    assert prefilter.probable(rows, "id", ids.limit(0)).count() == 0


def test_keep_one_with_clashing_columns(spark, words):
    text = text_of(words, 40, 3)
    rows = spark.createDataFrame([(1, text, 0, "a"), (2, text, 1, "b"), (3, "", 2, None), (None, text, 3, "d")], "doc_id long, text string, gone_id int, maybe_gone string")
    kept = jaccard_join.keep_one(rows)
    assert kept.columns == rows.columns and sorted(r.gone_id for r in kept.collect()) == [0, 2, 3]


def test_near_groups_without_ids_and_rows(spark, words):
    text = text_of(words, 40, 3)
    rows = spark.createDataFrame([(None, text), (None, text), (3, text), (3, text), (2, text), (7, "other words are here now"), (7, text)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard_join.near_groups(rows).collect()), key=str)
    assert got == sorted([(None, None), (None, None), (3, 2), (3, 2), (2, 2), (7, 2), (7, 2)], key=str)
    assert jaccard_join.near_groups(rows.limit(0)).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 60), (60, 50), (None, 1), (4, 4)], "a long, b long")
    got = {r.node: r.label for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(31)} | {50: 50, 60: 50}


def test_cut_repeats(spark, corpus):
    docs = {k: t for k, t in corpus.items() if k != 57} | {58: corpus[57][:3000], 59: "x" * 450, 60: "x" * 99}
    rows = suffix_dedup.cut_repeats(frame(spark, docs)).collect()
    got = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows}
    assert got == plain.cut_repeats(docs)
    assert suffix_dedup.cut_repeats(frame(spark, {})).count() == 0


def test_cut_repeats_with_equal_ids(spark, words):
    text = text_of(words, 60, 4)
    rows = spark.createDataFrame([(1, text), (1, text), (None, text), (1, "x" + text)], "doc_id long, text string")
    got = sorted((str(r.doc_id), len(r.kept)) for r in suffix_dedup.cut_repeats(rows).collect())
    assert got[3][0] == "None" and got[3][1] == len(text)  # a missing id comes first and keeps its text
    assert [n for _, n in got[:3]] in ([0, 0, 1], [0, 0, 0]) or sorted(n for _, n in got[:3])[0] == 0


def test_cut_repeats_with_repeated_rows(spark, words):
    docs = {1: text_of(words, 60, 4), 2: text_of(words, 60, 5), 4: text_of(words, 30, 6) + text_of(words, 40, 4), 5: "x" * 450, 6: None}
    docs[3] = docs[2] + "y"
    want = plain.cut_repeats(docs)
    assert want[1][1] == want[2][1] == 0 < want[3][1]
    # ids 1, 3 and 5 twice or three times: their own copies are no earlier ones
    rows = spark.createDataFrame([(k, docs[k]) for k in (1, 1, 2, 3, 3, 3, 4, 5, 5, 6, 6)], "doc_id long, text string")
    found = suffix_dedup.cut_repeats(rows).collect()
    got = [(r.doc_id, (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest())) for r in found]
    assert sorted(got) == sorted((k, want[k]) for k in (1, 1, 2, 3, 3, 3, 4, 5, 5, 6, 6))


def test_runs_across_stretches(monkeypatch, words):
    data = np.frombuffer((text_of(words, 80, 1) * 3).encode(), dtype=np.uint8)
    whole = sum(int(c.sum()) for *_, c in suffix_dedup.runs(data, 100, 32))
    monkeypatch.setattr(suffix_dedup, "STRETCH", 64)
    assert sum(int(c.sum()) for *_, c in suffix_dedup.runs(data, 100, 32)) == whole == len(data) - 99


def test_decontaminate(spark, corpus, words):
    long_item = text_of(words, 30, 2)
    items = [(1, long_item), (2, "one two"), (3, None), (4, " . "), (None, long_item), (10, corpus[57][:400]), (1, long_item)]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, hits string")
    docs = [*corpus.items(), (52, corpus[52]), (None, corpus[40])]
    rows = spark.createDataFrame([(k, t, 1, "x") for k, t in docs], "doc_id long, text string, n_words int, kept string")
    want = sorted(plain.hits(docs, items), key=str)
    for block in (decontaminate.BLOCK_BYTES, 150):  # all items at once, and in several blocks
        found = decontaminate.judge(decontaminate.find_items(rows, bench, block_bytes=block))
        got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()]
        assert sorted(got, key=str) == want
    assert decontaminate.find_items(rows.limit(0), bench).count() == 0
    assert decontaminate.judge(decontaminate.find_items(rows, bench.limit(0))).filter("contaminated").count() == 0


def test_winnowing(spark, corpus):
    rows = {r.doc_id: r for r in winnowing.fingerprint_neighbours(frame(spark, corpus)).collect()}
    keys = sorted(corpus)
    for k, following in zip(keys, keys[1:] + keys[:1], strict=True):
        new = winnowing.edited(corpus[k] or "", corpus[following] or "")
        assert (rows[k].n_chars, rows[k].edited_sha256) == (len(corpus[k] or ""), hashlib.sha256(new.encode()).hexdigest())
    assert rows[50].fingerprint == rows[51].fingerprint == "" and rows[50].near_next == 1.0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows.values())
    assert winnowing.fingerprint_neighbours(frame(spark, {})).count() == 0
    assert winnowing.fingerprint_neighbours(spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id long, text string")).count() == 3


def test_winnow_selects_rightmost_minimum_and_keeps_its_promise(words):
    shared = text_of(words, 40, 3)[:100]
    a, b = (np.array([ord(c) for c in x + shared + y], dtype=np.uint64) for x, y in ((text_of(words, 50, 1), text_of(words, 9, 2)), ("", text_of(words, 70, 4))))
    assert set(winnowing.winnow(a)[:, 0]) & set(winnowing.winnow(b)[:, 0])
    same = np.full(300, 120, dtype=np.uint64)
    assert winnowing.winnow(same)[0, 1] == winnowing.WINDOW - 1  # the rightmost of equal hashes


def test_winnowing_of_short_texts(spark, words):
    long = text_of(words, 90, 6)
    docs = {n: text_of(words, 60, 1000 + n)[:n] for n in range(4, 151)}
    rows = {r.doc_id: r.near_edited for r in winnowing.fingerprint_neighbours(frame(spark, docs)).collect()}
    assert all(rows[n] > 0 for n in docs)  # three quarters are kept, by a following text of one character more
    for low, high in ((4, 20), (20, 50), (50, 100), (100, 151)):
        assert 0.5 < sum(rows[n] for n in range(low, high)) / (high - low) < 1
    points = [np.array([ord(c) for c in t], dtype=np.uint64) for t in (long, docs[150])]
    grams = [set(winnowing.winnow(p)[:, 0]) for p in points]
    assert not grams[0] & grams[1]
    for n in range(4, 300):  # a shorter near copy beyond a step of the scales, and 100 characters of a long text in a short one
        assert winnowing.likeness(winnowing.winnow(points[0][:n]), winnowing.winnow(points[0][: n - n // 4])) > 0
        assert n < 100 or set(winnowing.winnow(points[0][200: 200 + n])[:, 0]) & grams[0]


def test_packing(spark, corpus):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = str(public.path("word_bpe_49k.json"))
    model = Tokenizer.from_file(path)
    odd = corpus | {70: "a\tb c <|endoftext|> x", 71: "Été İstanbul ΣΑΣ", 72: None}
    docs = spark.createDataFrame([(k, t, 1) for k, t in odd.items()] + [(None, "tie", 1), (None, "tie", 1)], "doc_id long, text string, sequence_id int")
    rows = packing.pack(docs, path).collect()
    seen, sequences = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.doc_id is not None:
            ids = np.array([*model.encode(odd[r.doc_id] or "", add_special_tokens=False).ids, 2], dtype="<u4")
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start: r.start + r.length].tobytes())
            seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
    assert all(seen[k] == len(model.encode(t or "", add_special_tokens=False).ids) + 1 for k, t in odd.items())
    assert sorted(sequences) == list(range(len(sequences)))
    for pieces in sequences.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1].tolist()] and ends[-1] <= 4096
    assert packing.pack(docs.limit(0), path).count() == 0


def test_class_sizes():
    sizes = packing.class_sizes(4096, 8)
    assert sizes[:3] == [4096, 2048, 1365] and sizes[-1] == 1
    assert all(4096 - 4096 // s * s <= 8 for s in sizes)
    assert sum(packing.cut(9999, sizes)) == 9999 and packing.cut(0, sizes) == []


def test_scores(spark, corpus):
    rows = ctw_scoring.score_corpus(frame(spark, corpus), block_bytes=20_000, buckets=7).collect()
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in corpus}
    counts = plain.word_counts(t for k, t in corpus.items() if not held[k])
    total, distinct = sum(counts.values()), len(counts)
    assert len(rows) == len(corpus)
    for r in rows:
        own = [*plain.SPACED.findall(plain.lower(corpus[r.doc_id])), None]
        base = sum(math.log10((counts.get(w, 0) + 0.5) / (total + 0.5 * (distinct + 1))) for w in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(w in counts for w in own), total)
        assert r.base_score == pytest.approx(base) and r.score < 0
    # blocks and buckets do not change the model
    other = {r.doc_id: r.score for r in ctw_scoring.score_corpus(frame(spark, corpus)).collect()}
    assert all(r.score == pytest.approx(other[r.doc_id], rel=1e-5) for r in rows)
    assert ctw_scoring.score_corpus(frame(spark, {})).count() == 0
    assert ctw_scoring.score_corpus(spark.createDataFrame([(None, "a"), (None, None)], "doc_id long, text string")).count() == 2


def test_tree_mixes_all_depths():
    """Against the recursion written out for one decision, and probabilities of a context's bytes add up to one."""
    texts = [b"abracadabra", b"abra", b"cadabra"]
    every = np.concatenate([ctw_scoring.grams(np.frombuffer(t, dtype=np.uint8), 3) for t in texts])
    grams, counts = np.unique(every, return_counts=True)
    levels = contexttree.subtree(grams, counts, 3, 0, 0)

    def weighted(depth, context):
        own = [g for g in every if g >> 8 >> 8 * (3 - depth) == context]
        ones = sum((int(g) >> 7) & 1 for g in own)
        block = math.prod((j + 0.5) for j in range(ones)) * math.prod((j + 0.5) for j in range(len(own) - ones)) / math.factorial(len(own))
        if depth == 3:
            return block
        return 0.5 * block + 0.5 * math.prod(weighted(depth + 1, c) for c in {int(g >> 8 >> 8 * (2 - depth)) for g in own})
    assert math.exp(levels[-1].weighted[0]) == pytest.approx(weighted(0, 0))
    full = (np.int64(97) << 16 | np.int64(0xFFFF)) * 256 + np.arange(256)  # all bytes after one context
    keys = np.unique(np.concatenate([grams, full]))
    n = np.zeros(len(keys), dtype=np.int64)
    n[np.searchsorted(keys, grams)] = counts
    total = np.zeros(len(keys))
    for i in range(8):
        path = None
        for d, level in enumerate(contexttree.subtree(keys, n, 3, 0, i)[::-1]):
            path = contexttree.descend(level, path, i, d == 3)
        one = path.mixed[np.searchsorted(path.key, keys >> (8 - i))]
        total += np.log(np.where((keys >> (7 - i)) & 1 == 1, one, 1 - one))
    assert np.exp(total[np.searchsorted(keys, full)]).sum() == pytest.approx(1.0)


def test_rule_ensemble(spark, words):
    rows = [(i, text_of(words, 30 + i % 50, i) if i % 3 else text_of(words, 20, i).upper().replace(" ", "!! "), i) for i in range(300)]
    docs = spark.createDataFrame([*rows, (900, None, 1), (901, "", 1), (None, "no id", 1), (1, rows[1][1], 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(None, 1), (5, None), (950, 0)], "doc_id long, quality int")
    scored = rule_ensemble.score_quality(docs, labels).collect()
    assert len(scored) == 304 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in scored)
    held = [r for r in scored if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert held and all(r.predicted == int(r.doc_id % 3 > 0) for r in held)
    kept = rule_ensemble.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {i for i in range(300) if i % 3}
    assert rule_ensemble.score_quality(docs, labels.limit(0)).filter("score = 0.5").count() == 304
    assert rule_ensemble.score_quality(docs.limit(0), labels).count() == 0


def test_line_dedup(spark):
    rows = [("a", f"Menu\nown {i}\n\nMenu") for i in range(9)] + [("a", "alone"), ("b", "Menu\nx"), (None, None), (None, ""), ("c", "Menu"), ("c", "Menu")]
    pages = spark.createDataFrame([(s, t, 1) for s, t in rows], "source string, text string, n_lines int")
    got = line_dedup.drop_site_lines(pages).collect()
    assert sorted((r.source, r.text, r.n_lines, r.n_dropped) for r in got if r.source == "a")[0] == ("a", "alone", 1, 0)
    assert all(r.text.startswith("own") and (r.n_lines, r.n_dropped) == (4, 2) for r in got if r.source == "a" and r.text != "alone")
    assert sorted((r.text or "~", r.n_lines) for r in got if r.source is None) == [("", 1), ("~", 0)] or len([r for r in got if r.source is None]) == 2
    assert [r.text for r in got if r.source == "b"] == ["Menu\nx"] and [r.text for r in got if r.source == "c"] == ["Menu", "Menu"]
    assert line_dedup.drop_site_lines(pages.limit(0)).count() == 0


def test_preferences(spark):
    chosen = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "a"), (2, 0, "user", "a"), (None, None, None, None), (3, 200, "assistant", "late")]
    rejected = [(1, 0, "user", "hi"), (1, 1, "assistant", "no!"), (2, 0, "user", "a"), (4, 0, "user", "only")]
    schema = "pair_id long, turn long, role string, text string"
    got = {(r.pair_id, r.part): r for r in preferences.format_preferences(spark.createDataFrame(chosen, schema), spark.createDataFrame(rejected, schema)).collect()}
    one = got[1, 0]
    assert (one.prompt, one.chosen, one.rejected) == ("<|user|>\nhi\n", "<|assistant|>\nyes\n", "<|assistant|>\nno!\n")
    assert [one.chosen[s["from"]: s["to"]] for s in one.chosen_trained] == ["yes\n"] and [one.rejected[s["from"]: s["to"]] for s in one.rejected_trained] == ["no!\n"]
    assert (got[2, 0].prompt, got[2, 0].chosen, got[2, 0].rejected) == ("<|user|>\na\n", "", "")
    assert got[4, 0].rejected == "<|user|>\nonly\n" and got[4, 0].prompt == "" and (3, 3) in got and (None, -1) in got
    empty = spark.createDataFrame([], schema)
    assert preferences.format_preferences(empty, empty).count() == 0


def test_revisits(spark):
    schema = "record_id long, url string, ts long, etag string, last_modified string, payload_digest string, headers map<string,string>, extra string"
    full = [(1, "http://www.A.org/x/?b=2&a=1&utm_source=q#f", 10, '"e1"', "m", "d1", {"content-type": "t", "etag": '"e1"'}, "x"),
            (2, "https://a.org:443/x?a=1&b=2", 20, '"e2"', "m", "d2", {"content-type": "t", "date": "old"}, "x"),
            (3, "https://a.org/x?a=1&b=2", 20, None, "m2", "d3", None, "x"), (4, None, 1, None, None, None, None, "x")]
    again = [(10, "https://a.org/x?a=1&b=2", 15, 'W/"e1"', None, None, {"date": "new", "content-length": "0"}, "x"),
             (11, "https://a.org/x?a=1&b=2", 20, '"zz"', None, None, None, "x"), (12, "https://a.org/x?a=1&b=2", 90_000_000, None, "m2", None, {"etag": "n"}, "x"),
             (13, "https://a.org/x?a=1&b=2", 5, None, None, "d1", None, "x"), (14, None, 50, None, None, None, None, "x"), (15, "https://a.org/x?b=2&a=1", 30, None, None, None, None, "x")]
    got = {r.record_id: (r.refers_to, r.status, r.headers) for r in revisits.resolve_revisits(spark.createDataFrame(full, schema), spark.createDataFrame(again + again[:1], schema)).collect()}
    assert got == {10: (1, "resolved", {"content-type": "t", "etag": '"e1"', "date": "new"}), 11: (None, "mismatch", None), 12: (3, "resolved", {"etag": "n"}),
                   13: (None, "no_response", None), 14: (None, "no_response", None), 15: (None, "no_validator", None)}
    empty = spark.createDataFrame([], schema)
    assert revisits.resolve_revisits(empty, empty).count() == 0


def test_pairs_grow_with_a_family_not_with_its_square(spark, words, monkeypatch):
    """Copies of one text with up to eight changed words: twice the copies need about twice the verified pairs."""
    verified, real = [], jaccard_join._verified

    def counting(pairs, sets, percent):
        verified.append(pairs.count())
        return real(pairs, sets, percent)
    monkeypatch.setattr(jaccard_join, "_verified", counting)
    base, made = text_of(words, 120, 6).split(), {}
    for size in (150, 300, 600):
        docs = {}
        for i in range(size):
            r, own = random.Random(i), list(base)
            for _ in range(r.randrange(9)):
                own[r.randrange(len(own))] = f"w{r.randrange(10**6)}"
            docs[i] = " ".join(own)
        verified.clear()
        got = {r.doc_id: r.component_id for r in jaccard_join.near_groups(frame(spark, docs), frequent=16).collect()}
        made[size] = sum(verified)
        if size == 150:
            assert got == {k: c for k, (_, c) in plain.near_groups(docs).items()}
    assert made[300] <= 3 * made[150] and made[600] <= 3 * made[300]


def test_packing_encodes_fresh_words_together():
    """One text for all words with a mark between them; words that hold the mark, or a mark of no single token, go one by one."""
    import struct

    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    asked = []

    def plain(words):
        asked.append(len(words))
        return [e.ids for e in model.encode_batch_fast(words, add_special_tokens=False)]

    words = ["", "Straße.", "don't", "́x", "a\tb", "12,5", "\u0000", "é", "'s", "\U0001f600!", "x" * 300]
    wanted = [struct.pack(f"<{len(ids)}I", *ids) for ids in plain(words)]
    encode = packing.word_encoder(plain)
    asked.clear()
    assert encode(words) == wanted and asked == [1]
    assert encode(words[:1]) == wanted[:1]
    marked = [*words, f"a{packing.MARK}b", packing.MARK]
    assert encode(marked) == [struct.pack(f"<{len(ids)}I", *ids) for ids in plain(marked)]
    assert packing.word_encoder(lambda texts: [[ord(c) for c in t] + [1] for t in texts])(["ab", ""]) == [struct.pack("<3I", 97, 98, 1), struct.pack("<I", 1)]
