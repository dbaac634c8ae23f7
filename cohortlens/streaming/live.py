"""Streams with keyed state: map state that takes back what a task was before, and rows that wait for their own timers.

Both run on ``transformWithStateInPandas``, whose state is held in RocksDB: a batch reads and writes the entries it
touches, so its cost follows the rows of the batch and not the size of a run's state.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import scalars as S
from .streams import FIELDS, task_done

STALL = "run_id string, ts timestamp, idle_sec double, stalled boolean"
PROGRESS = "run_id string, rows_seen long, submitted long, completed long, running long, failed long, elapsed_sec double"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that this kind of state needs; for queries that the session starts from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Progress(StatefulProcessor):
    """Of a run: the last row of each task, and the counts over them, changed by the difference that a new last row makes."""

    def __init__(self, expire_ms: int | None):
        self.expire_ms = expire_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.tasks = handle.getMapState("tasks", "task_id string", "ts long, status string, exit_code string, done boolean, failed boolean")
        self.totals = handle.getValueState("totals", "rows_seen long, submitted long, completed long, failed long, first long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        t = self.totals.get()
        seen, submitted, completed, failed, first, last = t if t else (0, 0, 0, 0, None, None)
        for frame in rows:
            seen += len(frame)
            lo, hi = int(frame["us"].min()), int(frame["us"].max())
            first, last = lo if first is None else min(first, lo), hi if last is None else max(last, hi)
            newest = frame.sort_values(["us", "status", "exit_code"], kind="stable").drop_duplicates("task_id", keep="last")
            for task, us, status, code, done, bad in newest[["task_id", "us", "status", "exit_code", "done", "failed"]].itertuples(index=False):
                new = (int(us), status, code, bool(done), bool(bad))
                old = self.tasks.getValue((task,))
                if old is not None and tuple(old[:3]) >= new[:3]:
                    continue  # a late row of a task that has gone on
                self.tasks.updateValue((task,), new)
                submitted += old is None
                completed += new[3] - (old[3] if old is not None else False)
                failed += new[4] - (old[4] if old is not None else False)
        self.totals.update((seen, submitted, completed, failed, first, last))
        if self.expire_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(max(last // 1000, timerValues.getCurrentWatermarkInMs()) + self.expire_ms)
        yield pd.DataFrame([(key[0], seen, submitted, completed, submitted - completed, failed, (last - first) / 1e6)], columns=[c.split()[0] for c in PROGRESS.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.tasks.clear()
        self.totals.clear()
        return iter(())

    def close(self) -> None:
        pass


def progress_stream(rows: DataFrame, delay: str = "1 hour", expire_ms: int | None = 7 * 86_400_000) -> DataFrame:
    """Each batch's changed runs with the counts of ``streams.progress``, in update mode: rows of one run with more rows_seen replace earlier ones.

    rows: run_id, task_id, ts, status, exit_code. A task counts once, as its last row says, whatever the order of arrival;
    the greatest of several rows at one time. Elapsed seconds run from the first to the last row of the run. Rows without run or task are
    left out. A run's state goes ``expire_ms`` of event time after its last row (None: never, and rows late by any time count).
    """
    use_rocksdb(rows.sparkSession)
    status, code = F.coalesce(F.col("status"), F.lit("")), F.coalesce(F.lpad(F.col("exit_code").cast("string"), 11, " "), F.lit(""))
    ready = rows.where(F.col("run_id").isNotNull() & F.col("task_id").isNotNull() & F.col("ts").isNotNull()).select(
        "run_id", F.col("task_id").cast("string").alias("task_id"), F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), status.alias("status"), code.alias("exit_code"),
        task_done(F.col("status")).alias("done"), F.coalesce(S.task_failed(F.col("status"), F.col("exit_code")), F.lit(False)).alias("failed"),
    )
    if expire_ms is not None:
        ready = ready.withWatermark("ts", delay)
    return ready.groupBy("run_id").transformWithStateInPandas(Progress(expire_ms), PROGRESS, "Update", "None" if expire_ms is None else "EventTime")


class Stall(StatefulProcessor):
    """Of a run: rows that wait for the watermark, by slots of time with a timer each, and the last heartbeat that changed."""

    def __init__(self, timeout_sec: float, expire_ms: int, slot_ms: int):
        self.timeout_sec, self.expire_ms, self.slot_ms = timeout_sec, expire_ms, slot_ms

    def init(self, handle) -> None:
        self.handle = handle
        fields = ", ".join(f"{f} long" for f in FIELDS)
        self.waiting = handle.getMapState("waiting", "slot long", "beats binary")  # rows of microseconds and fields, as 64-bit integers
        self.last = handle.getValueState("last", f"us long, {fields}, seen_ms long, ends_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at: dict[int, list] = {}
        for frame in rows:
            beats = frame[["us", *FIELDS]]
            if beats.isna().any(axis=None):
                raise ValueError("a heartbeat lacks its time or one of " + ", ".join(FIELDS))
            beats = beats.to_numpy(dtype="int64")
            beats = beats[np.argsort(beats[:, 0], kind="stable")]
            slots, first = np.unique(beats[:, 0] // (1000 * self.slot_ms), return_index=True)
            for slot, part in zip(slots.tolist(), np.split(beats, first[1:]), strict=True):
                at.setdefault(slot, []).append(part.tobytes())
        for slot, parts in at.items():
            old = self.waiting.getValue((slot,))
            if old is None:
                self.handle.registerTimer((slot + 1) * self.slot_ms)
            self.waiting.updateValue((slot,), (b"".join([bytes(old[0]) if old is not None else b"", *parts]),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        timer = expiredTimerInfo.getExpiryTimeInMs()
        slot, last = timer // self.slot_ms - 1, self.last.get()
        held = self.waiting.getValue((slot,)) if timer % self.slot_ms == 0 else None
        if held is None:
            if last is not None and last[-1] == timer:  # a run has one such timer at a time, set again while heartbeats come
                self._keep(last[:-2], last[-2], 0, timer)
            return
        beats = np.frombuffer(bytes(held[0]), "int64").reshape(-1, 1 + len(FIELDS))
        beats = beats[np.lexsort(beats.T[::-1])]
        us, ms = beats[:, 0], beats[:, 0] // 1000
        changed = np.ones(len(beats), bool)
        changed[1:] = (beats[1:, 1:] != beats[:-1, 1:]).any(axis=1) | (np.diff(ms) > self.expire_ms)
        if last is not None:
            changed[0] = tuple(beats[0, 1:].tolist()) != tuple(last[1:-2]) or int(ms[0]) - last[-2] > self.expire_ms
        of = np.maximum.accumulate(np.where(changed, np.arange(len(beats)), -1))
        since = np.where(of >= 0, us[of], last[0] if last is not None else 0)
        idle = np.maximum(0.0, (us - since) / 1e6)
        ends = last[-1] if last is not None and last[-1] > timer else 0
        self._keep((int(since[-1]), *beats[-1, 1:].tolist()), int(ms[-1]), ends, timer)
        self.waiting.removeKey((slot,))
        stalled = (idle >= self.timeout_sec) & (self.timeout_sec > 0)
        yield pd.DataFrame({"run_id": key[0], "ts": pd.to_datetime(us * 1000), "idle_sec": idle, "stalled": stalled})

    def _keep(self, beat: tuple, seen: int, ends: int, now: int) -> None:
        """The last heartbeat, unless the run is quiet for so long that its next one starts anew."""
        due = seen + self.expire_ms + 1
        if due <= now:
            self.last.clear()
            return
        if not ends:
            ends = due
            self.handle.registerTimer(ends)
        self.last.update((*beat, seen, ends))

    def close(self) -> None:
        pass


def stall_stream(heartbeats: DataFrame, timeout_sec: float, delay: str = "1 hour", expire_ms: int = 86_400_000, slot_ms: int = 600_000) -> DataFrame:
    """``streams.stall_batch`` as a stream, in append mode. Files don't arrive in event order, so each row waits until the watermark has passed its slot of ``slot_ms``,
    and rows are judged in order of time. A timer costs some milliseconds, so there is one for each slot of a run that holds rows and none for a row. A heartbeat more than
    ``expire_ms`` after the one before it starts anew, and a run's state goes then. Rows later than ``delay`` are left out.
    """
    use_rocksdb(heartbeats.sparkSession)
    ready = heartbeats.select("run_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), *[F.col(f).cast("long").alias(f) for f in FIELDS])
    return ready.withWatermark("ts", delay).groupBy("run_id").transformWithStateInPandas(Stall(timeout_sec, expire_ms, slot_ms), STALL, "Append", "EventTime")


def replay(parts: list[DataFrame], folder: str, make, keep) -> None:
    """Run ``make(stream)`` to the end of each part in turn, as a query that is stopped and started again between them.

    Parts are added to ``folder``/in; ``keep(batch, id)`` gets each batch of results; state lives in ``folder``/state.
    """
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        stream = part.sparkSession.readStream.schema(part.schema).parquet(f"{folder}/in")
        made = make(stream)
        q = made[0].writeStream.outputMode(made[1]).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package
