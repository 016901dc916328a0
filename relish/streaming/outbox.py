"""Each user's queue of unsent messages as keyed state with a timer.

Rows of a log are messages (``message``), failed tries to reach the user (``down``) and connections (``up``).  A message goes
out at once while the user is connected and waits otherwise.  A failed try counts as a retry of every waiting message; one
that has been tried too often or has waited too long is dropped, the latter by timer.  Rows are worked through in order of
their event time once the watermark has passed them, so results do not depend on how rows were dealt to micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from relish.session import ROCKS
from relish.streaming.requests import MAX_RETRIES

#: Fixed value: milliseconds after which a waiting message is dropped.
MAX_WAIT_MS = 30_000
LOG = "user string, at timestamp, seq bigint, kind string, event_id bigint, body string"
RESULT = "event_id bigint, user string, outcome string, retries int, waited_ms bigint, body string"
#: keys of the state; users and salts are dealt to them by hash
BUCKETS = 1 << 11
_MESSAGE, _UP, _DOWN, _OTHER, _NAMELESS = range(5)  # the last is a message without an id
_WHO = [("user", pa.string()), ("salt", pa.int32())]
_HELD = pa.schema([*_WHO, pa.field("at_ms", pa.int64(), nullable=False), pa.field("seq", pa.int64(), nullable=False), ("kind", pa.int32()), ("event_id", pa.int64()), ("body", pa.string())])
_WAITING = pa.schema([*_WHO, ("at", pa.int64()), ("event_id", pa.int64()), ("retries", pa.int32()), ("body", pa.string())])
_LINE = pa.schema(_WHO)
_RESULT = pa.schema([("event_id", pa.int64()), ("user", pa.string()), ("outcome", pa.string()), ("retries", pa.int32()), ("waited_ms", pa.int64()), ("body", pa.string())])


class Outbox(StatefulProcessor):
    """The queues of one bucket of keys (see ``outcomes``).

    ``ahead`` holds rows the watermark has not passed, ``waiting`` the unsent messages, ``line`` the keys that are connected, and
    ``alarm`` the time of the only timer. All are packed tables of the whole bucket: a call into the state store is paid
    once for a bucket and not for every user.
    """

    def __init__(self, max_wait_ms: int, max_retries: int) -> None:
        self.max_wait_ms, self.max_retries = max_wait_ms, max_retries

    def init(self, handle) -> None:
        self.handle = handle
        self.ahead = handle.getListState("ahead", "rows binary")
        self.waiting = handle.getValueState("waiting", "rows binary")
        self.line = handle.getValueState("line", "rows binary")
        self.alarm = handle.getValueState("alarm", "at bigint")

    def _wake(self, at: int | None) -> None:
        """Keep one timer, at the next time something can happen."""
        set_for = self.alarm.get()[0] if self.alarm.exists() else None
        if at == set_for:
            return
        if set_for is not None:
            self.handle.deleteTimer(set_for)
        if at is None:
            self.alarm.clear()
        else:
            self.handle.registerTimer(at)
            self.alarm.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = pa.concat_tables([pa.Table.from_pandas(frame[_HELD.names], _HELD, preserve_index=False) for frame in rows])
        self.ahead.appendValue((_packed(came.sort_by([(c, "ascending") for c in ("user", "salt", "at_ms", "seq")])),))  # rows like each other take less room
        first = pc.min(came["at_ms"]).as_py()
        if not self.alarm.exists() or first < self.alarm.get()[0]:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.alarm.clear()
        now = timerValues.getCurrentWatermarkInMs()
        held = [_unpacked(t[0]) for t in self.ahead.get()] if self.ahead.exists() else []
        rows = pa.concat_tables(held) if held else _HELD.empty_table()
        passed = pc.less_equal(rows["at_ms"], now)
        due, ahead = rows.filter(passed), rows.filter(pc.invert(passed))
        waiting, line = (_unpacked(state.get()[0]) if state.exists() else schema.empty_table() for state, schema in ((self.waiting, _WAITING), (self.line, _LINE)))
        out, waiting, line = _work_through(due, waiting, line, now, self.max_wait_ms, self.max_retries)
        if ahead.num_rows:
            self.ahead.put([(_packed(ahead),)])
        else:
            self.ahead.clear()
        for state, kept in ((self.waiting, waiting), (self.line, line)):
            if kept.num_rows:
                state.update((_packed(kept),))
            else:
                state.clear()
        nexts = [pc.min(ahead["at_ms"]).as_py()] if ahead.num_rows else []
        self._wake(min(nexts + ([pc.min(waiting["at"]).as_py() + self.max_wait_ms + 1] if waiting.num_rows else []), default=None))
        if out.num_rows:
            yield out.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)

    def close(self) -> None:
        pass


def _work_through(due: pa.Table, waiting: pa.Table, line: pa.Table, now: int, max_wait_ms: int, max_retries: int) -> tuple[pa.Table, pa.Table, pa.Table]:
    """What became of messages up to ``now``, the messages that still wait and the keys that are connected then.

    A message's fate is the first connection, or the first failed try too many, that follows it in time in its key's rows. So all
    messages are worked through as columns: rows stand by key, time and number, and each message looks its next rows up. Those
    that waited before come before their key's first row.
    """
    n, w = due.num_rows, waiting.num_rows
    users = pa.chunked_array([c for t in (due, waiting, line) for c in t["user"].chunks], pa.string()).combine_chunks()
    salts = np.concatenate([t["salt"].to_numpy() for t in (due, waiting, line)]).astype(np.int64)
    keys = users.dictionary_encode("encode").indices.to_numpy() * (salts.max(initial=0) + 1) + salts
    _, one, whose = np.unique(keys, return_index=True, return_inverse=True)
    order = np.lexsort((due["seq"].to_numpy(), due["at_ms"].to_numpy(), whose[:n]))
    key, at, kind = whose[:n][order], due["at_ms"].to_numpy()[order], due["kind"].to_numpy()[order]
    start, stop = (np.searchsorted(key, np.arange(len(one)), side=side) for side in ("left", "right"))
    ups, downs, lines = np.flatnonzero(kind == _UP), np.flatnonzero(kind == _DOWN), np.flatnonzero((kind == _UP) | (kind == _DOWN))
    was_up = np.zeros(len(one), dtype=bool)
    was_up[whose[n + w:]] = True

    def connected(place: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Whether a key is connected before a place of its rows."""
        last = np.append(-1, lines)[np.searchsorted(lines, place)]
        return np.where(last >= start[of], np.append(kind, _OTHER)[last] == _UP, was_up[of])
    came = np.flatnonzero((kind == _MESSAGE) | (kind == _NAMELESS))
    of, sent_at = np.concatenate([whose[n:n + w], key[came]]), np.concatenate([waiting["at"].to_numpy(), at[came]])
    tries, begin = np.concatenate([waiting["retries"].to_numpy(), np.zeros(len(came), dtype=np.int32)]), np.concatenate([start[whose[n:n + w]], came + 1])
    at_once = np.concatenate([np.zeros(w, dtype=bool), connected(came, key[came])])
    before = np.searchsorted(downs, begin)
    up = np.append(ups, n)[np.searchsorted(ups, begin)]
    fail = np.append(downs, n)[np.minimum(before + np.maximum(max_retries - tries, 0), len(downs))]
    up_wait, fail_wait = (np.append(at, 0)[place] - sent_at for place in (up, fail))
    sent, failed = ((place < stop[of]) & (wait <= max_wait_ms) for place, wait in ((up, up_wait), (fail, fail_wait)))
    failed &= ~at_once & ~(sent & (up < fail))
    sent = at_once | (sent & ~failed)
    done = sent | failed | (now - sent_at > max_wait_ms)
    times = np.unique(np.concatenate([at, sent_at + max_wait_ms]))
    in_time = np.searchsorted(key * len(times) + np.searchsorted(times, at), of * len(times) + np.searchsorted(times, sent_at + max_wait_ms), side="right")
    tried = tries + np.searchsorted(downs, np.maximum(np.where(sent, up, in_time), begin)) - before
    retries = np.where(at_once, 0, np.where(failed, max_retries + 1, tried))
    waited = np.where(at_once, 0, np.where(sent, up_wait, np.where(failed, fail_wait, max_wait_ms + 1)))

    rows = due.take(pa.array(order[came]))
    named = pc.if_else(pc.equal(rows["kind"], _NAMELESS), pa.scalar(None, pa.int64()), rows["event_id"])
    told = pa.table({"user": pa.chunked_array([*waiting["user"].chunks, *rows["user"].chunks], pa.string()), "salt": pa.chunked_array([*waiting["salt"].chunks, *rows["salt"].chunks], pa.int32()),
                     "at": pa.array(sent_at, pa.int64()), "event_id": pa.chunked_array([*waiting["event_id"].chunks, *named.chunks], pa.int64()), "retries": pa.array(retries, pa.int32()),
                     "body": pa.chunked_array([*waiting["body"].chunks, *rows["body"].chunks], pa.string()), "waited_ms": pa.array(waited, pa.int64()),
                     "outcome": pa.array(np.array(["stale", "sent", "retries"], dtype=object)[np.where(sent, 1, np.where(failed, 2, 0))], pa.string())})
    still_up = one[connected(stop, np.arange(len(one)))]
    kept = told.filter(pa.array(~done)).select(_WAITING.names).cast(_WAITING)
    return told.filter(pa.array(done)).select(_RESULT.names), kept, pa.table({"user": users.take(pa.array(still_up)), "salt": pa.array(salts[still_up], pa.int32())})


def _packed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def outcomes(log: DataFrame, late: str = "30 seconds", max_wait_ms: int = MAX_WAIT_MS, max_retries: int = MAX_RETRIES, salts: int = 8) -> DataFrame:
    """What became of each message of a stream of ``LOG`` rows, as ``RESULT``: ``sent``, ``retries`` or ``stale``.

    ``seq`` orders rows of one time.  Rows may come out of order by up to ``late``; a message whose fate the watermark has
    not reached is not told yet.  As messages do not depend on each other, a user's messages are dealt to ``salts`` keys and
    their connection rows go to all of these, so that a user who writes a third of all messages is no single key.  Users and
    salts are dealt to ``BUCKETS`` keys of the state.
    """
    own = F.sequence(F.lit(0), F.lit(salts - 1))
    salt = F.when(F.col("kind") == "message", F.array(F.pmod(F.xxhash64("event_id"), F.lit(salts)).cast("int"))).otherwise(own)
    kind = F.when((F.col("kind") == "message") & F.col("event_id").isNull(), _NAMELESS).otherwise(
        F.coalesce(*[F.when(F.col("kind") == name, code) for name, code in (("message", _MESSAGE), ("up", _UP), ("down", _DOWN))], F.lit(_OTHER)))
    keyed = (log.withWatermark("at", late).withColumn("salt", F.explode(salt)).withColumn("bucket", F.pmod(F.xxhash64("user", "salt"), F.lit(BUCKETS)).cast("int"))
             .select("bucket", "user", "salt", "at", F.unix_millis("at").alias("at_ms"), "seq", kind.alias("kind"), F.coalesce("event_id", F.lit(0)).alias("event_id"), "body"))
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # the store that keeps lists and timers
    return keyed.groupBy("bucket").transformWithStateInPandas(Outbox(max_wait_ms, max_retries), RESULT, "append", "eventTime")
