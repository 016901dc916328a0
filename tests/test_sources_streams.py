import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from relish import schemas
from relish.session import materialize, scratch_dir
from relish.sources import files
from relish.streaming import requests as S


def test_bulk_listing_takes_csv_in_any_case_only(spark, tmp_path):
    for name, row in (("a.csv", "u1,g1,5.0"), ("b.CSV", "u2,g2,"), ("deep/c.csv", "u3,g3,1.5"), ("notes.txt", "x,y,9")):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("user_id,game_title,rating\n" + row + "\n")
    rows = files.read_all_csv(spark, str(tmp_path), schemas.RATINGS).collect()
    assert sorted((r["user_id"], r["rating"]) for r in rows) == [("u1", 5.0), ("u2", None), ("u3", 1.5)]
    assert {os.path.basename(r["source"]) for r in rows} == {"a.csv", "b.CSV", "c.csv"}


def test_titles_and_mapping_in_one_pretty_object(spark, tmp_path):
    (tmp_path / "titles.json").write_text('{\n "gameTitles": ["A", "B"]\n}')
    (tmp_path / "map.json").write_text('{\n "x": 0,\n "y": 1\n}')
    assert sorted(r[0] for r in files.read_titles(spark, str(tmp_path / "titles.json")).collect()) == ["A", "B"]
    assert sorted(map(tuple, files.read_mapping(spark, str(tmp_path / "map.json"), True).collect())) == [("x", 0), ("y", 1)]


def test_written_objects_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "MAPPING_CHUNK", 10)
    mapping = spark.range(95).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("idx"))
    path = files.write_mapping(mapping, str(tmp_path / "m"))
    assert spark.read.text(path).count() == 10
    assert files.read_mapping(spark, path).exceptAll(mapping).count() == 0


def test_quoted_line_breaks_and_empty_fields(spark, tmp_path):
    """An empty field is a missing value, quoted or not."""
    rows = spark.createDataFrame([("u", 'He said "no",\nthen left', 7.5), (None, "", None)], "user_id string, game_title string, rating double")
    path = files.write_csv(rows, str(tmp_path / "r"))
    back = files.read_csv(spark, path, schemas.RATINGS, multiline=True)
    want = [("u", 'He said "no",\nthen left', 7.5), (None, None, None)]
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(map(str, want))


def test_fallback_only_covers_missing_paths(spark, tmp_path):
    inline = spark.range(3)
    assert files.first_available([lambda: spark.read.parquet(str(tmp_path / "no"))], lambda: inline).count() == 3
    spark.range(1).write.parquet(str(tmp_path / "yes"))
    with pytest.raises(AnalysisException):
        files.first_available([lambda: spark.read.parquet(str(tmp_path / "yes")).select("missing")], lambda: inline)


def test_artifact_is_written_once(spark, tmp_path):
    path = str(tmp_path / "a")
    assert files.materialize_if_missing(spark.range(5), path).count() == 5
    assert files.materialize_if_missing(spark.range(9), path).count() == 5


def test_scratch_follows_the_session_setting(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch_dir(spark, "x")
    assert path.endswith("/x") and (base is None or path.startswith(base.rstrip("/")))
    assert materialize(spark.range(4), "t").count() == 4


def test_late_messages_do_not_reopen_a_window(spark):
    box = S.Delivery(spark, "late")
    seen = []
    for times in (["00:00:01", "00:00:02", "00:01:00"], ["00:02:00"], ["00:00:03", "00:01:59"], ["00:04:00"]):
        rows = spark.createDataFrame([(i, f"2024-01-01 {t}") for i, t in enumerate(times)], "event_id int, t string")
        box.deliver(rows.select("event_id", F.to_timestamp("t").alias("ts")))
        counted = S.rate(S.messages(spark, box.inbox, "event_id int, ts timestamp"), "ts", flood=2)
        S.drain_to_table(counted, box.out, box.state)
        seen.append(spark.read.parquet(box.out).count())
    got = {(str(r["window_start"])[11:], r["n_messages"], r["flooded"]) for r in spark.read.parquet(box.out).collect()}
    assert got == {("00:00:00", 2, True), ("00:01:00", 1, False), ("00:01:55", 1, False), ("00:02:00", 1, False)}
    assert seen == sorted(seen)


def test_stale_and_retry_filters(spark):
    rows = spark.createDataFrame([(1, 0, 3), (2, 30, 4), (3, 31, 0)], "event_id int, age int, retry_count int")
    rows = rows.select("*", F.lit("2024-01-01").cast("timestamp").alias("ts")).withColumn("arrived", F.col("ts") + F.make_dt_interval(secs="age"))
    assert [r[0] for r in S.fresh(rows, "ts", "arrived").select("event_id").collect()] == [1, 2]
    assert [r[0] for r in S.within_retries(rows).select("event_id").collect()] == [1, 3]


def test_probed_sources_are_written_from_stored_ratings(spark, monkeypatch):
    """The ratings are joined once, however many of the six sources they fill."""
    from relish.queries import sources
    joined = []
    monkeypatch.setattr(sources, "_ratings", lambda s, d: joined.append(s.range(60).select(
        F.format_string("u%d", F.col("id") % 5).alias("user_id"), F.format_string("g%d", "id").alias("game_title"), (F.col("id") % 11).cast("double").alias("rating"))) or joined[-1])
    stored, materialize = [], sources.materialize
    monkeypatch.setattr(sources, "materialize", lambda df, label: stored.append(df) or materialize(df, label))
    found = sources._probed(spark, "")
    assert stored == joined
    assert found.rows.count() == 55 and [r.verdict for r in found.report.orderBy("place").collect()] == ["missing", "unreadable", "empty", "dirty", "used", "untried"]
