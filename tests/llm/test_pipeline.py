"""The pipeline's stages on the smallest tables: what they return, and that each one's decisions take effect."""

from pyspark.sql import functions as F

import corpus_pipeline
import plain
from relish.session import materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(materialize(stage(spark, kept[-1], SF), name.replace(" ", "_")))
    assert all(d.columns == columns for d in kept[:-1])
    good = {r.doc_id for r in kept[1].select("doc_id").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert not [d for d, q in labels.items() if q == 0 and d in good] and not [d for d, q in labels.items() if q == 1 and d not in good]
    lines = {r.doc_id: r.text for r in kept[2].collect()}
    assert set(lines) == good
    groups = plain.near_groups(lines)
    single = {r.doc_id: r.text for r in kept[3].collect()}
    assert set(single) == {k for k, (_, c) in groups.items() if c == k}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {key for key, *_, contaminated in plain.hits(single.items(), items) if not contaminated}
    assert {r.doc_id for r in kept[4].select("doc_id").collect()} == clean == {r.doc_id for r in kept[5].select("doc_id").distinct().collect()}


CLASHING = ("n_lines", "n_dropped", "n_words", "hits", "n_hit", "n_items", "items_sha256", "contaminated", "labelled_id", "stat_n_words", "line_row", "near", "label", "set_id")


def test_stages_leave_own_columns_alone(spark):
    """Columns of all inner names, NULL and empty texts, NULL ids, repeated rows, a very long text; then no rows at all."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    more = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "", "en", None, 0), (None, "some words of no great length here", "en", "s", 34),
                                  (9003, "a rather long text with many words " * 40_000, "en", "s", 1), (9004, "twice", "en", "s", 5), (9004, "twice", "en", "s", 5)], docs.schema)
    docs = docs.unionByName(more)
    for i, name in enumerate(CLASHING):
        docs = docs.withColumn(name, F.concat(F.lit(f"own{i}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    docs = materialize(docs, "clashing")
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = materialize(stage(spark, rows, SF), name.replace(" ", "_"))
            assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            for r in out.collect():
                assert [r[c] for c in CLASHING] == [f"own{i}|{'none' if r.doc_id is None else r.doc_id}" for i in range(len(CLASHING))]
            if rows is docs and name != "quality":
                kept = [r.doc_id for r in out.collect()]
                assert {9001, 9002, 9003, 9004, None} <= set(kept) and kept.count(9004) == 2
        pieces = corpus_pipeline.STAGES[-1][1](spark, rows, SF)
        assert pieces.count() == 0 if rows is not docs else pieces.agg(F.sum("length")).first()[0] > 0


def test_stages_take_some_hundred_texts_at_a_time(spark, monkeypatch):
    """Every stage that is written hands its texts to the workers in batches far below Spark's 10,000 rows; later reads are left alone."""
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)

    def stage(spark, docs, sf_dir):
        seen.append(int(spark.conf.get(name)))
        return docs
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage), ("two", stage), ("last", lambda spark, docs, sf_dir: docs)])
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert len(seen) == 2 and max(seen) <= 1000 and spark.conf.get(name) == before
