"""Registered queries of the operators, each beside its SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from relish.llm import (collocations, ctw_scoring, decontaminate, jaccard_join, language_id, line_dedup, packing, preferences, reversed_search, revisits,
                        rule_ensemble, suffix_dedup, winnowing)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


@query("op1_context_tree")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code length of every document by a model of the corpus."""
    return ctw_scoring.score_corpus(table(spark, sf_dir, "documents")).withColumn(
        "bits_per_byte", -F.col("score") / ((F.col("n_bytes") + 1) * F.log10(F.lit(2.0))))


@query("op2_rule_ensemble")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return rule_ensemble.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_jaccard_join")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies among all documents."""
    return jaccard_join.near_groups(table(spark, sf_dir, "documents"))


@query("op4_harmonic_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


@query("op6_decontamination")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.judge(decontaminate.find_items(docs, table(spark, sf_dir, "benchmark")).drop("text"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op7_winnowing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, its edited text and its neighbour."""
    return winnowing.fingerprint_neighbours(table(spark, sf_dir, "documents"))


#: Captures derived from the pages: each page was fetched in full once and asked for again at another time, earlier or later.
RESPONSES = """
select page_id * 2 as record_id, url, page_id * 60 as ts,
       case when page_id % 5 = 0 then null else concat('"', substr(md5(html), 1, 16), '"') end as etag,
       concat('t', page_id) as last_modified, md5(html) as payload_digest, length(html) as size
from {pages}
"""
REVISITS = """
select page_id * 2 + 1 as record_id, concat(case when page_id % 2 = 0 then replace(url, 'http://', 'https://') else url end, '#again') as url,
       page_id * 60 + ascii(substr(md5(url), 1, 1)) * 37 % 5000 - 1500 as ts,
       case when page_id % 6 in (0, 1) then concat('W/"', substr(md5(html), 1, 16), '"') when page_id % 6 = 2 then '"other"' else null end as etag,
       case when page_id % 6 = 4 then concat('t', page_id) else null end as last_modified,
       case when page_id % 6 = 3 then md5(html) when page_id % 6 = 5 and page_id % 4 = 1 then 'other' else null end as payload_digest
from {pages}
"""


@query("op8_revisits", f"""
with responses as ({RESPONSES.format(pages='pages')}), revisits as ({REVISITS.format(pages='pages')}),
cut as (select record_id, 'p' as side, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as bare from responses
        union all select record_id, 'v', regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') from revisits),
asked as (select *, list_sort(list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'), lambda x: x <> '' and lower(regexp_extract(x, '^([^=]*)', 1)) not in ('fbclid', 'gclid', 'ref')
                 and not starts_with(lower(regexp_extract(x, '^([^=]*)', 1)), 'utm_'))) as params from cut),
urls as (select record_id, side, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\\.', ''), ':(80|443)$', '')
                || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/$', '')
                || case when len(params) > 0 then '?' || array_to_string(params, '&') else '' end as target_url from asked),
pairs as (select v.*, u.target_url, p.record_id as p_id, p.etag as p_etag, p.last_modified as p_modified, p.payload_digest as p_digest, p.size, p.ts as p_ts,
                 row_number() over (partition by v.record_id order by p.ts desc nulls last, p.record_id desc nulls last) as place
          from revisits v join urls u on u.record_id = v.record_id and u.side = 'v'
          left join (select r.*, w.target_url from responses r join urls w on w.record_id = r.record_id and w.side = 'p') p on p.target_url = u.target_url and p.ts < v.ts),
judged as (select *, case when p_id is null then 'no_response'
                  when etag is not null and p_etag is not null then case when regexp_replace(etag, '^W/', '') = regexp_replace(p_etag, '^W/', '') then 'resolved' else 'mismatch' end
                  when payload_digest is not null then case when payload_digest = p_digest then 'resolved' else 'mismatch' end
                  when last_modified is not null then case when last_modified = p_modified then 'resolved' else 'mismatch' end
                  else 'no_validator' end as status from pairs where place = 1)
select record_id, target_url, ts, case when status = 'resolved' then p_id end as refers_to, status,
       case when status = 'resolved' then concat_ws(';', 'cache-control=max-age=' || record_id % 7, 'content-length=' || size, 'content-type=text/html', 'date=' || ts, 'etag=' || coalesce(etag, p_etag))
            else concat_ws(';', 'cache-control=max-age=' || record_id % 7, 'content-length=0', 'date=' || ts, 'etag=' || etag, 'x-cache=hit') end as headers
from judged
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits of all pages with the responses they stand for."""
    pages = table(spark, sf_dir, "pages")
    responses, again = spark.sql(RESPONSES, pages=pages), spark.sql(REVISITS, pages=pages)

    def headers(**values) -> Column:
        pairs = F.array(*[F.struct(F.lit(k.replace("_", "-")).alias("key"), v.cast("string").alias("value")) for k, v in values.items()])
        return F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull()))

    responses = responses.withColumn("headers", headers(content_length=F.col("size"), content_type=F.lit("text/html"), date=F.col("ts"), etag=F.col("etag")))
    age = F.concat(F.lit("max-age="), F.col("record_id") % 7)
    again = again.withColumn("headers", headers(cache_control=age, content_length=F.lit(0), date=F.col("ts"), etag=F.col("etag"), x_cache=F.lit("hit")))
    found = revisits.resolve_revisits(responses, again)
    text = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return found.withColumn("headers", text)


#: Pairs derived from the conversations: a conversation is preferred to itself with the turns from some turn on answered as in the next one.
REJECTED = """
select c.conv_id as pair_id, c.turn, c.role,
       case when c.turn >= greatest(1, m.last_turn - c.conv_id % 3) then coalesce(o.text, reverse(c.text)) else c.text end as text
from {conversations} c join (select conv_id, max(turn) as last_turn from {conversations} group by conv_id) m on m.conv_id = c.conv_id
left join {conversations} o on o.conv_id = c.conv_id + 1 and o.turn = c.turn
"""


@query("op9_preferences", f"""
with both_sides as (select distinct pair_id, side, slot, role, text from (
       select conv_id as pair_id, 'c' as side, coalesce(turn, -1) as slot, coalesce(role, '') as role, coalesce(text, '') as text from conversations
       union all select pair_id, 'r', coalesce(turn, -1), coalesce(role, ''), coalesce(text, '') from ({REJECTED.format(conversations='conversations')}) x)),
slots as (select pair_id, slot, list(role || chr(0) || text order by role, text) filter (side = 'c') as c, list(role || chr(0) || text order by role, text) filter (side = 'r') as r
          from both_sides group by pair_id, slot),
cuts as (select pair_id, min(slot) filter (c is distinct from r) as cut from slots group by pair_id),
named as (select b.*, slot // 64 as part, case when cut is null or slot < cut then 'p' else side end as kind from both_sides b join cuts using (pair_id)
          where side = 'c' or not (cut is null or slot < cut)),
placed as (select *, coalesce(sum(length(role) + length(text) + 6) over (partition by pair_id, part, kind order by slot, role, text rows between unbounded preceding and 1 preceding), 0)
                  + length(role) + 5 as began from named)
select pair_id, part, count(distinct slot) filter (kind = 'p') as prompt_turns,
       coalesce(string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' order by slot, role, text) filter (kind = 'p'), '') as prompt,
       coalesce(string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' order by slot, role, text) filter (kind = 'c'), '') as chosen,
       coalesce(string_agg(cast(cast(began as bigint) as varchar) || '-' || cast(cast(began + length(text) + 1 as bigint) as varchar), ',' order by slot, role, text) filter (kind = 'c' and role = 'assistant'), '') as chosen_trained,
       coalesce(string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' order by slot, role, text) filter (kind = 'r'), '') as rejected,
       coalesce(string_agg(cast(cast(began as bigint) as varchar) || '-' || cast(cast(began + length(text) + 1 as bigint) as varchar), ',' order by slot, role, text) filter (kind = 'r' and role = 'assistant'), '') as rejected_trained
from placed group by pair_id, part
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against its altered form."""
    conversations = table(spark, sf_dir, "conversations")
    out = preferences.format_preferences(conversations.withColumnRenamed("conv_id", "pair_id"), spark.sql(REJECTED, conversations=conversations))
    for side in ("chosen_trained", "rejected_trained"):
        out = out.withColumn(side, F.array_join(F.transform(side, lambda s: F.concat_ws("-", s["from"], s["to"])), ","))
    return out


@query("op10_line_dedup", """
with docs as (select row_number() over () as row_id, doc_id, source, string_split(text, chr(10)) as all_lines, text from documents),
long_form as (select row_id, source, unnest(all_lines) as line, generate_subscripts(all_lines, 1) as place from docs),
counted as (select source, line, count(distinct row_id) as n from long_form where regexp_replace(line, '\\s+', '', 'g') <> '' group by source, line),
totals as (select source, count(*) as pages from documents group by source),
gone as (select c.source, c.line from counted c join totals t on t.source is not distinct from c.source where n >= 5 and n > 0.1::double * pages),
kept as (select l.row_id, string_agg(l.line, chr(10) order by place) filter (g.line is null) as text, count(g.line) as n_dropped, count(*) as n_lines
         from long_form l left join gone g on g.source is not distinct from l.source and g.line = l.line group by l.row_id)
select doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_dropped, 0) as n_dropped, case when d.text is null then null else coalesce(k.text, '') end as text
from docs d left join kept k using (row_id)
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the boilerplate lines of its source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_site_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")


@query("op5_suffix_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated 100-byte strings."""
    found = suffix_dedup.cut_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_collocations", """
with docs as (select row_number() over () as id, coalesce(lang, 'und') as lang,
                     regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\x0C\\r]') as parts from documents),
pieces as (select lang, regexp_extract_all(unnest(parts), '[^ \\t]+') as w from docs),
grams as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) as phrase from pieces, range(1, 5) r(k) where len(w) >= k),
counted as (select lang, k, phrase, count(*) as a from grams group by lang, k, phrase),
totals as (select lang, sum(a)::bigint as n from counted where k = 1 group by lang),
frequent as (select *, string_split(phrase, ' ') as w from counted where a >= 30),
phrases as (select * from frequent where k > 1),
inner_parts as (select lang, a, phrase as whole, unnest(list_concat([array_to_string(w[i : i + 1], ' ') for i in range(1, k)], [array_to_string(w[i : i + 2], ' ') for i in range(1, k - 1)])) as part from phrases where k > 2),
covered as (select distinct p.lang, p.phrase from phrases p join inner_parts i on i.lang = p.lang and i.part = p.phrase where i.part <> i.whole and 100 * i.a >= 80 * p.a),
cuts as (select p.lang, p.phrase, p.a, c.cut, array_to_string(p.w[1 : c.cut], ' ') as lhs, array_to_string(p.w[c.cut + 1 : p.k], ' ') as rhs
         from phrases p anti join covered v on v.lang = p.lang and v.phrase = p.phrase, range(1, 4) c(cut) where c.cut < p.k),
scored as (select c.lang, c.phrase, c.a, l.a as l, r.a as r, ((2000000::hugeint * c.a) // (l.a + r.a))::bigint as score,
                  row_number() over (partition by c.lang, c.phrase order by (2000000::hugeint * c.a) // (l.a + r.a), c.cut) as place
           from cuts c join frequent l on l.lang = c.lang and l.phrase = c.lhs join frequent r on r.lang = c.lang and r.phrase = c.rhs),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from scored where place = 1)
select k.lang, rank, phrase, a, l, r, n, score from ranked k join totals t on t.lang = k.lang where rank <= 2000
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of every language, over all documents."""
    return collocations.mine(table(spark, sf_dir, "documents"))


@query("op12_reversed_search", r"""
with docs as (select row_number() over () as id, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
lengths as (select id, doc_id, len(w) as n from docs where len(w) > 0),
totals as (select count(*) as big_n, coalesce(sum(n), 0)::bigint as big_l from lengths),
held as (select id, term, count(*) as tf from (select id, unnest(w) as term from docs) group by id, term),
asked as (select item_id, term, count(*) as q from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
          from (select distinct item_id, text from benchmark)) group by item_id, term),
weights as (select term, floor(1000 * ln((2 * big_n + 2)::double / (2 * df + 1)))::bigint as w from (select term, count(*) as df from held group by term), totals),
gains as (select h.id, h.term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))) as gain
          from held h join weights using (term) join lengths using (id), totals where term in (select term from asked)),
scored as (select item_id, id, sum(q * gain)::bigint as score from gains join asked using (term) group by item_id, id),
ranked as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from scored join lengths using (id) where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 20
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of all documents for every benchmark item."""
    return reversed_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_language_id")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return language_id.identify(table(spark, sf_dir, "documents"))
