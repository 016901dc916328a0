"""The batch dispatch and the tables that it answers from."""

from relish.queries import serving


def test_dispatch_reads_stored_tables(spark, monkeypatch, tmp_path):
    """Means, scores and vectors are worked out once and not for every branch that asks them."""
    asked = []
    monkeypatch.setattr(serving, "serving_tables", lambda *_: [spark.range(n) for n in (1, 2, 3)])
    monkeypatch.setattr(serving, "parsed", lambda *_: None)
    monkeypatch.setattr(serving.R, "dispatch", lambda _, *tables: asked.extend(tables) or spark.createDataFrame([], "event_id int, model_used string, id int, title string, description string"))
    serving.dispatch_batch(spark, str(tmp_path))
    assert [t.count() for t in asked] == [1, 2, 3] and all(t.inputFiles() for t in asked)
