"""Similarity join on word shingles with token-combination prefixes.

Two sets with Jaccard similarity of ``percent`` or more share ``ceil(percent * n / 100)`` tokens of the larger set at least.
So in any one order of all tokens, their first ``n - ceil(percent * n / 100) + k`` tokens share k.  The join uses this thrice:

1. Order by hash, prefixes extended by half: a set of which too few prefix tokens stand in any other prefix has no partner
   and leaves.  Most documents leave here, and only their prefixes were moved.
2. The others are ordered by rarity, which is counted over all of their tokens.  A token of up to ``frequent`` sets is
   rare and indexed alone, if it is in the plain prefix.
3. Sets whose plain prefix runs into frequent tokens can have a partner without a common rare token.  Their prefix is
   extended so far that among the shared tokens there are more gaps than tokens of one side alone; some two shared
   tokens then stand side by side in both sets, and these 2-token combinations are indexed.

Sets under one key are candidates.  As links make groups, each round verifies candidates against one leader of a key only
and joins groups, as far as two steps from node to node show them.  The first leader is the key's most central set, whose
tokens are the most frequent: in a family of copies the one that was changed least, which most of the others are similar
to.  Leaders from outside and from inside the largest group follow by turns.  Pairs of different groups that are left are
all verified, save that no two members of a key's largest group are paired.  Before that, each set's parities bound a pair from below: of 512 classes of tokens, those of which the two sets
hold an odd and an even number have a token of one side alone.  Verifying counts the common tokens of the whole sets.  Sets
and tokens are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from relish.llm import arrowtext, prefilter, texthash
from relish.llm.components import components
from relish.session import materialize

#: rounds of leaders before the remaining pairs are verified one and all
LEADER_ROUNDS = 4
#: 64-bit words of a set's parities
PARITY_WORDS = 8


def needed(n, percent: int):
    """Tokens a partner of no larger size shares at least; numbers, arrays or columns."""
    return (n * percent + 99) // 100 if not isinstance(n, Column) else F.floor((n * percent + 99) / 100)


def plain_prefix(n, percent: int):
    return n - needed(n, percent) + 1


def _set_id(tokens: np.ndarray) -> int:
    """A hash of the whole set."""
    at = np.arange(1, len(tokens) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return int(texthash.mix(np.array([texthash.mix(tokens ^ at).sum() + np.uint64(len(tokens))], dtype=np.uint64))[0].view(np.int64))


def _parities(tokens: np.ndarray) -> np.ndarray:
    """For each class of tokens, whether the set holds an odd number of it; as ``PARITY_WORDS`` longs."""
    odd = np.bincount((tokens & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(shingle: int, percent: int, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Set id, size, parities and tokens: all of them, or the extended prefix in order of hash, once for each set and task.

    Parities come with whole sets only.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrowtext.free_kept()
        seen: set[int] = set()
        for batch in batches:
            ids, sizes, tokens, odd = [], [], [], []
            if len(seen) > 1 << 18:
                seen.clear()
            for data in arrowtext.texts(batch, "text"):
                found = texthash.shingle_set(data, shingle)
                n, own = len(found), _set_id(found)
                ids.append(own)
                sizes.append(n)
                p = plain_prefix(n, percent)
                tokens.append((found if whole else found[: p + p // 2]).view(np.int64) if n and own not in seen else found[:0].view(np.int64))
                if whole:
                    odd.append(_parities(found))
                seen.add(own)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, tokens)]), pa.int32()), pa.array(np.concatenate(tokens) if tokens else np.empty(0, dtype=np.int64)))
            columns = {"doc_id": batch.column(0), "set_id": pa.array(ids, pa.int64()), "n": pa.array(sizes, pa.int64()), "tokens": lists}
            if whole:
                columns["odd"] = pa.array(odd, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    return run


def _prefixed(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_sets(shingle, percent, False), f"doc_id {kind}, set_id long, n long, tokens array<long>")


def _survivors(prefixed: DataFrame, percent: int) -> DataFrame:
    """Sets that may have a partner, with a document of each."""
    same = Window.partitionBy("token")
    entries = prefixed.select("set_id", F.explode("tokens").alias("token"))
    shared = entries.withColumn("common", F.min("set_id").over(same) != F.max("set_id").over(same)).filter("common")
    counted = shared.groupBy("set_id").agg(F.count("*").alias("common")).withColumnRenamed("set_id", "of_set")
    sets = prefixed.filter("n > 0 and doc_id is not null").groupBy("set_id").agg(F.first("n").alias("n"), F.min("doc_id").alias("doc_id"))
    # the smallest partner has the shortest extension, and so shares the fewest
    least = F.floor(plain_prefix(needed(F.col("n"), percent), percent) / 2) + 1
    return sets.join(counted, F.col("set_id") == F.col("of_set")).filter(F.col("common") >= least).select("set_id", "n", "doc_id")


def _ranked(sets: DataFrame) -> DataFrame:
    """Each set's tokens that another set has too, in order of rarity: ``set_id, n, shared``."""
    entries = sets.select("set_id", F.explode("tokens").alias("token"))
    df = entries.withColumn("df", F.count("*").over(Window.partitionBy("token"))).filter("df > 1")
    ranked = df.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared"))
    return ranked.join(sets.select("set_id", "n"), "set_id")


def _index(ranked: DataFrame, percent: int, frequent: int) -> DataFrame:
    """Keys of each set: ``kind`` 1 rare tokens, 2 combinations of neighbouring frequent ones; ``place`` in the order.

    The first ``alone`` places of a set are tokens that no other set has; ``before`` is the set's previous key of the kind.
    ``central`` is the mean number of sets that hold a token of the set: in a family of copies it is highest for those that
    were changed least.
    """
    n = F.col("n")
    alone = (n - F.size("shared")).cast("long")
    rare = F.size(F.filter("shared", lambda s: s["df"] <= frequent))
    plain = plain_prefix(n, percent)
    placed = F.transform("shared", lambda s, i: F.struct(s["token"].alias("token"), (i + F.col("alone")).alias("place")))
    central = (F.aggregate("shared", F.lit(0).cast("long"), lambda total, s: total + s["df"]) + alone) / n
    base = (ranked.withColumn("alone", alone).withColumn("central", central).withColumn("rare", rare.cast("long")).withColumn("plain", plain)
            .withColumn("far", F.least(n, F.lit(2) * plain - 1 + plain_prefix(F.floor(n * 100 / percent), percent))).withColumn("placed", placed))
    singles = base.select("set_id", "n", "alone", "central", F.lit(1).alias("kind"), (F.slice("placed", F.lit(1), F.greatest(F.lit(0), F.least(F.col("rare"), F.col("plain") - F.col("alone"))).cast("int"))).alias("keys"))
    chained = base.filter(F.col("alone") + F.col("rare") < F.col("plain")).withColumn(
        "run", F.slice("placed", (F.col("rare") + 1).cast("int"), F.greatest(F.lit(0), F.col("far") - F.col("alone") - F.col("rare")).cast("int")))
    pairs = F.zip_with(F.slice("run", F.lit(1), F.greatest(F.lit(0), F.size("run") - 1)), F.slice("run", F.lit(2), F.greatest(F.lit(0), F.size("run") - 1)),
                       lambda x, y: F.struct(F.xxhash64(x["token"], y["token"]).alias("token"), x["place"].alias("place")))
    chains = chained.select("set_id", "n", "alone", "central", F.lit(2).alias("kind"), pairs.alias("keys"))
    ordered = F.transform("keys", lambda key, i: F.struct(key["token"].alias("gram"), key["place"].alias("place"), F.get("keys", i - 1)["token"].alias("before")))
    return singles.unionByName(chains).select("set_id", "n", "alone", "central", "kind", F.size("keys").alias("n_keys"), F.inline(ordered))


def _without_twins(index: DataFrame) -> DataFrame:
    """The index with one key of those that hold the same sets: the first in order, which no common token precedes.

    Keys of one set go.  A small group of near copies shares hundreds of tokens, and is then met under one key.
    """
    keys = index.groupBy("kind", "gram").agg(F.count("*").alias("m"), F.sum(F.xxhash64("set_id").cast("decimal(20,0)")).alias("who"), F.min("place").alias("place"))
    kept = keys.filter("m > 1").groupBy("kind", "m", "who").agg(F.min(F.struct("place", "gram")).alias("first")).select("kind", F.col("first.gram").alias("gram"))
    return index.join(kept, ["kind", "gram"], "left_semi")


def _may_link(a: str, b: str, percent: int) -> Column:
    """Bounds on size and on the common tokens before the key and from it on; a rare key is the pair's first common token."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    size = F.least(na, nb) * 100 >= F.greatest(na, nb) * percent
    before = F.when(F.col("kind") == 1, F.lit(0)).otherwise(F.least(F.col(f"{a}.place") - F.col(f"{a}.alone"), F.col(f"{b}.place") - F.col(f"{b}.alone")))
    most = before + F.least(na - F.col(f"{a}.place"), nb - F.col(f"{b}.place"))
    return size & (most * (100 + percent) >= (na + nb) * percent)


def _parities_allow(na: Column, a: Column, nb: Column, b: Column, percent: int) -> Column:
    """Whether the tokens that one side alone must hold, by the parities, leave enough common ones."""
    apart = sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(PARITY_WORDS)), F.lit(0))
    return (na + nb - apart) * (100 + percent) >= (na + nb) * 2 * percent


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) that their parities allow, with whether their whole sets are similar enough."""
    def side(rows: DataFrame, name: str, *columns: str) -> DataFrame:
        return rows.select(F.col("set_id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])

    bounded = pairs.join(side(sets, "a", "n", "odd"), "a").join(side(sets, "b", "n", "odd"), "b").filter(
        _parities_allow(F.col("a_n"), F.col("a_odd"), F.col("b_n"), F.col("b_odd"), percent)).select("a", "b", "a_n", "b_n")
    both = F.size(F.array_intersect("a_tokens", "b_tokens"))
    bounded = materialize(bounded, "bounded")
    named = prefilter.probable(sets, "set_id", bounded.select(F.explode(F.array("a", "b"))))
    joined = bounded.join(side(named, "a", "tokens"), "a").join(side(named, "b", "tokens"), "b")
    return joined.select("a", "b", (both * (100 + percent) >= (F.col("a_n") + F.col("b_n")) * percent).alias("linked"))


def _links(index: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join the same groups as all links do."""
    spark = index.sparkSession
    tested = spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(True).alias("linked"))
    labels = index.select(F.col("set_id").alias("node"), F.col("set_id").alias("label")).limit(0)
    key = ["kind", "gram"]

    def labelled(entries: DataFrame) -> DataFrame:
        return entries.join(labels, F.col("set_id") == F.col("node"), "left").withColumn("label", F.coalesce("label", "set_id")).drop("node")

    def grouped(entries: DataFrame, best: Column) -> DataFrame:
        """Size and best entry of each group under a key."""
        entry = F.struct("set_id", "n", "alone", "place", "label")
        return entries.groupBy(*key, "label").agg(F.count("*").alias("m"), F.max(F.struct(best.alias("by"), entry.alias("entry"))).alias("best"))

    def test(pairs: DataFrame) -> bool:
        """Verify pairs that were not verified before; whether a quarter of them are links."""
        nonlocal tested
        fresh = pairs.select(F.least("x.set_id", "y.set_id").alias("a"), F.greatest("x.set_id", "y.set_id").alias("b")).distinct()
        found = materialize(_verified(fresh.join(tested, ["a", "b"], "left_anti"), sets, percent), "verified")
        tested = tested.unionByName(found)
        n, links = found.agg(F.count("*"), F.count_if("linked")).first()
        return 4 * links > n

    idle = 0
    entry = F.struct("set_id", "n", "alone", "place", "label")
    for turn in range(LEADER_ROUNDS):
        # first the most central set of a key, then by turns the most central one outside its largest group and some member of that
        inside = turn and turn % 2 == 0
        groups = materialize(grouped(labelled(index), F.xxhash64("set_id", F.lit(turn)).cast("double") if inside else F.col("central")), "groups")
        # pairs of different groups under one key, against the number of entries under keys of several groups
        sizes = groups.groupBy(key).agg(F.count("*").alias("labels"), F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("inner")).filter("labels > 1")
        entries, cross = sizes.agg(F.coalesce(F.sum("all"), F.lit(0)), F.coalesce(F.sum((F.col("all") * F.col("all") - F.col("inner")) / 2), F.lit(0.0))).first()
        if cross <= entries / 2 or idle == 2:  # neither kind of leader finds much any more
            break
        largest = groups.groupBy(key).agg(F.count("*").alias("labels"), F.max(F.struct("m", "best")).alias("largest")).filter("labels > 1")
        if turn == 0:
            leaders = groups.groupBy(key).agg(F.count("*").alias("labels"), F.max_by("best.entry", "best").alias("y")).filter("labels > 1")
        elif inside:
            leaders = largest.select(*key, F.col("largest.best.entry").alias("y"))
        else:
            outside = groups.join(largest, key).filter(F.col("label") != F.col("largest.best.entry.label"))
            leaders = outside.groupBy(key).agg(F.max_by("best.entry", "best").alias("y"))
        # sets of a family share most of their keys and the leaders of these, so some sixteen of its keys are enough for a set
        some = F.pmod(F.xxhash64("gram", F.lit(turn)), F.greatest(F.lit(1), F.floor(F.col("n_keys") / 16))) == 0
        led = labelled(index.filter(some)).select(*key, entry.alias("x")).join(leaders.select(*key, "y"), key)
        idle = 0 if test(led.filter((F.col("x.label") != F.col("y.label")) & _may_link("x", "y", percent))) else idle + 1
        labels = components(tested.filter("linked"), rounds=2)
    labels = components(tested.filter("linked"))
    odd = sets.select(F.col("set_id").alias("of_set"), "odd")
    named = labelled(index)
    mixed = named.groupBy(key).agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high")
    rest = named.join(mixed.select(key), key, "left_semi").drop("n_keys", "central")
    rest = materialize(rest.join(odd, F.col("set_id") == F.col("of_set")).drop("of_set"), "open_keys")
    # members of a key's largest group are not paired with each other: one side is always a set outside it
    largest = grouped(rest, F.lit(0.0)).groupBy(key).agg(F.max(F.struct("m", "best"))["best"]["entry"]["label"].alias("main"))
    rest = materialize(rest.join(largest, key), "rest")
    entry = F.struct("set_id", "n", "alone", "place", "label", "before", "odd", "main")
    left, right = rest.filter(F.col("label") != F.col("main")).select(*key, entry.alias("x")), rest.select(*key, entry.alias("y"))
    allowed = _may_link("x", "y", percent) & _parities_allow(F.col("x.n"), F.col("x.odd"), F.col("y.n"), F.col("y.odd"), percent)
    # two sets whose previous keys are one key have met there, or under a twin of it that comes still earlier
    met = F.coalesce(F.col("x.before") == F.col("y.before"), F.lit(False))
    once = (F.col("y.label") == F.col("y.main")) | (F.col("x.set_id") < F.col("y.set_id"))
    test(left.join(right, key).filter(once & (F.col("x.label") != F.col("y.label")) & ~met & allowed))
    return tested.filter("linked").select("a", "b")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, frequent: int = 64) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each document; documents are linked if 100 |common| >= percent |union|.

    Words are runs without ASCII white space, A-Z in lower case; a text of fewer than ``shingle`` words has its whole
    sequence as one shingle.  ``component_id`` is the least ``doc_id`` that links lead to.  NULL texts and texts without words
    have no shingles and are linked with nothing; so are documents with a NULL id, whose ``component_id`` is NULL.  Rows
    of one id belong together whatever their texts.  Other columns are ignored; no rows, no result.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prefixed = materialize(_prefixed(slim, shingle, percent), "prefixes")
    members = prefixed.select("doc_id", "set_id", "n")
    survivors = materialize(_survivors(prefixed, percent), "survivors")
    kind = docs.schema[doc_id].dataType.simpleString()
    wanted = survivors.select(F.col("doc_id").alias("wanted"))
    wanted = prefilter.probable(slim, "doc_id", wanted).join(wanted, F.col("doc_id") == F.col("wanted"), "left_semi")
    sets = materialize(wanted.mapInArrow(_sets(shingle, percent, True), f"doc_id {kind}, set_id long, n long, tokens array<long>, odd array<long>")
                       .filter(F.size("tokens") > 0).select("set_id", "n", "tokens", "odd").dropDuplicates(["set_id"]), "sets")
    index = materialize(_without_twins(materialize(_index(_ranked(sets), percent, frequent), "keys")), "index")
    links = _links(index, sets, percent)

    full = members.filter("n > 0 and doc_id is not null")
    twins = full.groupBy("doc_id").agg(F.min("set_id").alias("a"), F.max("set_id").alias("last")).filter("a != last").select(F.col("doc_id").alias("twin"), "a")
    same_id = full.join(twins, F.col("doc_id") == F.col("twin")).select("a", F.col("set_id").alias("b"))
    labels = components(links.unionByName(same_id))
    least = full.groupBy("set_id").agg(F.min("doc_id").alias("least")).withColumnRenamed("set_id", "of_set")
    grouped = least.join(labels, F.col("of_set") == F.col("node"), "left").withColumn("label", F.coalesce("label", "of_set"))
    component = grouped.groupBy("label").agg(F.min("least").alias("component_id")).withColumnRenamed("label", "to_label")
    named = grouped.join(component, F.col("label") == F.col("to_label")).select("of_set", "component_id")
    found = members.join(named, (F.col("set_id") == F.col("of_set")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` whose document has the least id of its group, with their own columns.

    Repeated rows of a kept id stay, as do rows without an id.
    """
    gone_id, maybe = prefilter.fresh(docs.columns, "gone_id"), prefilter.fresh(docs.columns, "maybe_gone")
    groups = near_groups(docs, doc_id, text, **settings)
    gone = materialize(groups.filter(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias(gone_id)).distinct(), "near_copies")
    told = prefilter.flagged(docs, doc_id, gone, maybe)
    checked = told.filter(maybe).join(gone, F.col(doc_id) == F.col(gone_id), "left_anti")
    return told.filter(~F.col(maybe)).unionByName(checked).drop(maybe)
