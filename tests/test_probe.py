"""Sources that are probed: every verdict, every format, rows kept apart."""

from relish import schemas
from relish.sources import files, probe

FIELDS = schemas.RATINGS


def lines(found):
    return [tuple(r) for r in found.report.orderBy("place").collect()]


def rows(spark, n):
    return spark.createDataFrame([(f"u{i}", f"g{i}", float(i)) for i in range(n)], FIELDS)


def test_all_verdicts(spark, tmp_path):
    (tmp_path / "junk.csv").write_bytes(bytes(range(256)) * 40)
    (tmp_path / "broken.parquet").write_bytes(b"PAR1 no table")
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    (tmp_path / "empty.csv").write_text("user_id,game_title,rating\n")
    (tmp_path / "dirty.csv").write_text("user_id,game_title,rating\nu,g,x\nu,g,1,2\nu,g,3\n")
    (tmp_path / "good.csv").write_text("user_id,game_title,rating\nu1,g1,1.5\nu2,g2,\nu3,g3,oops\n,g4,2\n")
    names = ["missing.csv", "junk.csv", "broken.parquet", "other.csv", "empty.csv", "dirty.csv", "good.csv", "never.csv"]
    found = probe.first_good(spark, {n: str(tmp_path / n) for n in names}, FIELDS, lambda: rows(spark, 0), required=("user_id",))
    assert [(s, v, g, b) for _, s, v, g, b in lines(found)] == [
        ("missing.csv", "missing", None, None), ("junk.csv", "unreadable", None, None), ("broken.parquet", "unreadable", None, None),
        ("other.csv", "unreadable", None, None), ("empty.csv", "empty", 0, 0), ("dirty.csv", "dirty", 1, 2), ("good.csv", "used", 2, 2), ("never.csv", "untried", None, None)]
    assert sorted(map(str, map(tuple, found.rows.collect()))) == ["('u1', 'g1', 1.5)", "('u2', 'g2', None)"]
    kept = sorted((r.source, r.record) for r in found.bad.collect())
    assert kept == [("dirty.csv", "u,g,1,2"), ("dirty.csv", "u,g,x"), ("good.csv", "u3,g3,oops"), ("good.csv", '{"game_title":"g4","rating":2.0}')]


def test_inline_rows_when_nothing_can_be_used(spark, tmp_path):
    found = probe.first_good(spark, {"a": str(tmp_path / "a"), "b": str(tmp_path / "b.json")}, FIELDS, lambda: rows(spark, 3))
    assert found.rows.count() == 3 and [v for _, _, v, _, _ in lines(found)] == ["missing", "missing"]
    assert probe.first_good(spark, {}, FIELDS, lambda: rows(spark, 2)).rows.count() == 2


def test_json_and_parquet(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"user_id":"u","game_title":"g","rating":1}\n{"user_id":5,\nnot json\n')
    found = probe.first_good(spark, {"a": str(tmp_path / "a.json")}, FIELDS, lambda: rows(spark, 0), most_bad=0.7)
    assert lines(found) == [(0, "a", "used", 1, 2)] and found.rows.first() == ("u", "g", 1.0)
    rows(spark, 4).select("rating", "user_id", "game_title").write.parquet(str(tmp_path / "b.parquet"))
    spark.range(3).write.parquet(str(tmp_path / "c.parquet"))
    found = probe.first_good(spark, {n: str(tmp_path / n) for n in ("c.parquet", "b.parquet")}, FIELDS, lambda: rows(spark, 0))
    assert [v for _, _, v, _, _ in lines(found)] == ["unreadable", "used"]
    assert found.rows.columns == [f.name for f in FIELDS.fields] and found.rows.count() == 4


def test_mapping_pairs_are_published_together(spark, tmp_path):
    path = str(tmp_path / "m")
    table = spark.range(20).selectExpr("concat('k', id) as key", "id as idx")
    files.publish_mappings(table, table.limit(0), path)
    files.publish_mappings(table.where("idx < 5"), table.where("idx < 3"), path)
    users, items = files.newest_mappings(spark, path)
    assert (users.count(), items.count()) == (5, 3)
