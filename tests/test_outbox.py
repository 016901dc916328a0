"""The keyed queue of messages against a plain replay, and the forest that a stream follows."""

import datetime as dt
import random
import types

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from relish.operators import forest
from relish.queries import streams
from relish.streaming import outbox
from relish.streaming import requests as S

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def replay(rows, max_wait=30_000, max_retries=3):
    """(at_ms, seq, kind, event, user) rows of all users, one after the other."""
    out, state = [], {}
    for at, _, kind, event, user in sorted(rows):
        up, waiting = state.setdefault(user, [False, []])
        for m in [m for m in waiting if at - m[0] > max_wait]:
            out.append((m[1], user, "stale", m[2], max_wait + 1))
        waiting = [m for m in waiting if at - m[0] <= max_wait]
        if kind == "message":
            waiting.append([at, event, 0])
        else:
            up = kind == "up"
        if kind == "down":
            for m in waiting:
                m[2] += 1
            out += [(m[1], user, "retries", m[2], at - m[0]) for m in waiting if m[2] > max_retries]
            waiting = [m for m in waiting if m[2] <= max_retries]
        if up:
            out += [(m[1], user, "sent", m[2], at - m[0]) for m in waiting]
            waiting = []
        state[user] = [up, waiting]
    return sorted(out + [(m[1], u, "stale", m[2], max_wait + 1) for u, (_, waiting) in state.items() for m in waiting])


@pytest.mark.parametrize("salts", [1, 4])
def test_outcomes_equal_a_replay(spark, salts):
    r = random.Random(salts)
    rows = []
    for i in range(600):  # user a writes half of all
        user = "a" if r.random() < 0.5 else f"u{r.randrange(6)}"
        kind = r.choice(["message"] * 4 + ["down"] * 4 + ["up"])
        rows.append((r.randrange(0, 400_000, 500), i, kind, i if kind == "message" else None, user))
    late = sorted(rows, key=lambda x: x[0] + r.randrange(20_000))  # out of order by less than the watermark waits
    box = S.Delivery(spark, "outbox")
    for part in (late[:200], late[200:450], late[450:], [(4_000_000, 0, "tick", None, "")]):
        frame = spark.createDataFrame([(u, START + dt.timedelta(milliseconds=at), seq, kind, e, f"b{e}") for at, seq, kind, e, u in part], outbox.LOG)
        box.deliver(frame)
        S.drain_batches(outbox.outcomes(S.messages(spark, box.inbox, outbox.LOG), salts=salts), box.out, box.state, lambda batch: batch)
    got = spark.read.parquet(box.out).collect()
    assert sorted((x.event_id, x.user, x.outcome, x.retries, x.waited_ms) for x in got) == replay(rows)
    assert all(x.body == f"b{x.event_id}" for x in got)
    assert {x.outcome for x in got} == {"sent", "retries", "stale"}


def test_recommendations_leave_out_each_requests_own_titles(spark):
    titles = [f"T{i}" for i in range(7)]
    scores = spark.createDataFrame([(t, float(9 - i // 2)) for i, t in enumerate(titles)] + [("t0 ", 9.5)], "title string, predicted_score double")
    asks = {1: ["T0"], 2: ["t1 ", " T2", "T2"], 3: [], 4: None, 5: [*titles, "T0"], 6: ["nothing"]}
    requests = spark.createDataFrame(list(asks.items()), "event_id int, games array<string>")
    got = {}
    for row in forest.recommend(requests, scores, n=3).orderBy("event_id", "rank").collect():
        got.setdefault(row.event_id, []).append((row["rank"], row.title, row.description))
    order = sorted([(-float(9 - i // 2), t) for i, t in enumerate(titles)] + [(-9.5, "t0 ")])
    for key, liked in asks.items():
        keys = {x.strip().lower() for x in liked or []}
        free = [x for x in order if x[1].strip().lower() not in keys] or order
        assert got[key] == [(i + 1, t, f"Predicted Score: {-s:.2f}") for i, (s, t) in enumerate(free[:3])]


def test_newest_scores_follow_what_is_published(spark, tmp_path):
    rows = spark.createDataFrame([(f"t{i}", ["a", "b"][: 1 + i % 2], "E", f"p{i % 3}", f"d{i % 4}", float(i % 10), 2000 + i, float(i), 25 - i % 20) for i in range(60)],
                                 "title string, genres array<string>, product_rating string, publisher string, developer string, user_score double, release_year int, log_ratings_count double, game_age int")
    path = str(tmp_path / "forests")
    scores = forest.NewestScores(spark, path, rows)
    with pytest.raises(FileNotFoundError):
        scores()
    forest.publish(forest.fit(rows, numTrees=2, maxDepth=2), spark, path)
    version, first = scores()
    assert version == 0 and scores()[1] is first
    forest.publish(forest.fit(rows.withColumn("user_score", F.lit(1.0)), numTrees=2, maxDepth=2), spark, path)
    version, second = scores()
    assert version == 1 and {r.predicted_score for r in second.collect()} == {1.0}
    assert isinstance(forest.load(spark, path, 0), PipelineModel) and len({r.predicted_score for r in first.collect()}) > 1


def test_answers_are_not_broadcast_to_be_checked(spark, tmp_path):
    """Texts that repeat fill a small file and much memory; duplicates of a title count as often as they are told."""
    answers = spark.range(4000).selectExpr("id % 1000 as event_id", "if(id % 1000 < 500, 'Traditional', 'Naive') as model_used", "cast(id % 1000 div 600 as int) as version",
                                           "concat('t', id div 1000) as title", "'Predicted Score: 1.00' as description")
    answers.write.parquet(str(tmp_path / "answers"))
    liked = spark.range(1000).selectExpr("id as event_id", "array('t3') as games")
    told = spark.createDataFrame([(0, "t0", "Predicted Score: 1.00"), (0, "t1", "Predicted Score: 2.00"), (0, "t1", "Predicted Score: 1.00")], "version int, title string, expected string")
    found = streams.by_version(spark.read.parquet(str(tmp_path / "answers")), liked, told)
    assert "SortMergeJoin [event_id" in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.model_used, r.version, r.n_recs, r.n_liked, r.n_by_version): r["n"] for r in found.groupBy("model_used", "version", "n_recs", "n_liked", "n_by_version").agg(F.count("*").alias("n")).collect()}
    assert got == {("Traditional", 0, 5, 1, 2): 500, ("Naive", 0, 5, 0, 0): 100, ("Naive", 1, 4, 0, 0): 400}


class _Held:
    """A state handle in memory that counts the calls into it."""

    def __init__(self):
        self.calls, self.timers, self.kept = 0, set(), {}

    def getListState(self, name, schema):
        return _Variable(self, name)

    getValueState = getListState

    def registerTimer(self, at):
        self.calls, self.timers = self.calls + 1, self.timers | {at}

    def deleteTimer(self, at):
        self.calls, self.timers = self.calls + 1, self.timers - {at}


class _Variable:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name

    def _call(self, change=None):
        self.handle.calls += 1
        if change is not None:
            self.handle.kept[self.name] = change

    def exists(self):
        self._call()
        return bool(self.handle.kept.get(self.name))

    def get(self):
        self._call()
        found = self.handle.kept[self.name]
        return iter(found) if isinstance(found, list) else found

    def put(self, rows):
        self._call(rows)

    update = put

    def appendValue(self, row):
        self._call([*self.handle.kept.get(self.name, []), row])

    def clear(self):
        self._call([])


def test_a_bucket_asks_the_state_once_for_all_its_users():
    """Some thousand keys in one bucket, one without a name and messages without an id."""
    r, rows = random.Random(5), []
    for i in range(20_000):
        kind = r.choice(["message"] * 4 + ["down"] * 4 + ["up"])
        rows.append((r.randrange(0, 400_000, 500), i, kind, i if kind == "message" and i % 9 else None, f"u{r.randrange(2000)}" if i % 7 else None))
    handle, box, got, wait, codes = _Held(), outbox.Outbox(30_000, 3), [], 0, {"message": outbox._MESSAGE, "up": outbox._UP, "down": outbox._DOWN}
    box.init(handle)
    for now in (100_000, 130_000, 131_000, 250_000, 10_000_000):
        came = [x for x in rows if wait <= x[0] < now]
        wait = now
        if came:
            code = [outbox._NAMELESS if kind == "message" and event is None else codes[kind] for _, _, kind, event, _ in came]
            frame = pd.DataFrame({"user": [x[4] for x in came], "salt": 0, "at_ms": [x[0] for x in came], "seq": [x[1] for x in came], "kind": code,
                                  "event_id": [x[3] or 0 for x in came], "body": [f"b{x[1]}" for x in came]})
            assert not list(box.handleInputRows((0,), iter([frame.iloc[::2], frame.iloc[1::2]]), None))
        clock = types.SimpleNamespace(getCurrentWatermarkInMs=lambda now=now: now - 20_000)
        for at in [at for at in handle.timers if at <= now - 20_000]:
            handle.timers.remove(at)
            got += [x for frame in box.handleExpiredTimer((0,), clock, None) for x in frame.astype(object).itertuples(index=False, name=None)]
    assert handle.calls < 150
    plain = [(at, i, kind, (i, event), user) for at, i, kind, event, user in rows]
    told = sorted((int(body[1:]), None if pd.isna(event) else int(event), str(user), outcome, retries, waited) for event, user, outcome, retries, waited, body in got)
    assert told == sorted((i, event, str(user), outcome, retries, waited) for (i, event), user, outcome, retries, waited in replay(plain))
    assert not handle.timers and not handle.kept["ahead"] and not handle.kept["waiting"]


def test_a_bucket_is_worked_through_as_columns():
    """Users without a name, messages without an id and what waited before: the fates of a replay."""
    r, held, gone = random.Random(5), [], []
    waiting, line, wait_ms = outbox._WAITING.empty_table(), outbox._LINE.empty_table(), 30_000
    for turn in range(5):
        came = []
        for i in range(120):
            kind = r.choice([outbox._MESSAGE, outbox._MESSAGE, outbox._NAMELESS, outbox._UP, outbox._DOWN, outbox._DOWN, outbox._OTHER])
            came.append((r.choice([None, "a", "b", "c"]), r.randrange(2), turn * 60_000 + r.randrange(0, 60_000, 250), turn * 1000 + i, kind, 1000 * turn + i, f"b{turn}-{i}"))
        held += came
        due = pa.table([pa.array(c, t) for c, t in zip(zip(*came, strict=True), outbox._HELD.types, strict=True)], schema=outbox._HELD)
        told, waiting, line = outbox._work_through(due, waiting, line, (turn + 1) * 60_000, wait_ms, 3)
        gone += zip(*(told[c].to_pylist() for c in ("body", "user", "outcome", "retries", "waited_ms")), strict=True)
        assert told.column_names == outbox._RESULT.names and waiting.schema == outbox._WAITING and line.schema == outbox._LINE
    gone += [(b, u, "stale", n, wait_ms + 1) for b, u, n in zip(*(waiting[c].to_pylist() for c in ("body", "user", "retries")), strict=True)]
    ids, kinds = {}, {outbox._MESSAGE: "message", outbox._NAMELESS: "message", outbox._UP: "up", outbox._DOWN: "down", outbox._OTHER: "other"}
    plain = []
    for user, salt, at, seq, kind, _, body in held:
        ids[seq] = body
        plain.append((at, seq, kinds[kind], seq, (str(user), salt)))
    want = [(ids[seq], None if user == "None" else user, outcome, retries, waited) for seq, (user, _), outcome, retries, waited in replay([row for row in plain if row[2] != "other"])]
    assert sorted(gone, key=str) == sorted(want, key=str)


def test_what_is_held_takes_less_room_than_rows_as_they_come():
    r, rows = random.Random(6), []
    for i in range(4000):
        kind = r.choice([outbox._MESSAGE, *[outbox._UP, outbox._DOWN] * 3])
        event = i if kind == outbox._MESSAGE else 0
        rows.append((f"user{r.randrange(40)}", r.randrange(8), r.randrange(0, 400_000, 250), 10 * i, kind, event, f'{{"action":"send","id":{i}}}' if event else None))
    came = pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), outbox._HELD.types, strict=True)], schema=outbox._HELD)
    sink, handle, box = pa.BufferOutputStream(), _Held(), outbox.Outbox(30_000, 3)
    with pa.ipc.new_stream(sink, came.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as stream:
        stream.write_table(came)
    box.init(handle)
    assert list(box.handleInputRows((1,), iter([came.to_pandas()]), None)) == []
    assert len(handle.kept["ahead"][0][0]) < 0.7 * sink.getvalue().size
    assert sorted(outbox._unpacked(handle.kept["ahead"][0][0]).to_pylist(), key=str) == sorted(came.to_pylist(), key=str)
