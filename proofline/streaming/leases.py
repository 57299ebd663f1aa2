"""Leases that heartbeats renew, and jobs that go back to the queue when one runs out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def expired(jobs: DataFrame, now: DataFrame, lease_us: int) -> DataFrame:
    """Jobs (attempt, beat in microseconds) whose lease ran out before now (one row), queued again with the next attempt."""
    due = jobs.join(F.broadcast(now), F.col("beat") + lease_us < F.col("now"))
    return due.withColumn("status", F.lit("REQUEUED")).withColumn("attempt", F.col("attempt") + 1)


def lease_expiries(beats: DataFrame, job: str, us: str, lease_us: int, now: DataFrame) -> DataFrame:
    """(job, last_beat, due, attempt) of every lease that ran out before now (one row), in microseconds: the batch form of lease_stream.

    A lease runs out lease_us after a beat unless another beat comes by then, the very microsecond included. Each of them
    raises the attempt, which is 0 before the first. Beats without a time, or of no job, are left out.
    """
    b = beats.filter(F.col(us).isNotNull() & F.col(job).isNotNull()).select(job, F.col(us).alias("last_beat"))
    over = f"over (partition by {job} order by last_beat)"
    due = b.withColumn("due", F.col("last_beat") + lease_us).withColumn("_next", F.expr(f"lead(last_beat) {over}")).filter("_next is null or _next > due")
    lost = due.join(F.broadcast(now), F.col("due") < F.col("now"))
    return lost.select(job, "last_beat", "due", F.expr(f"row_number() {over}").cast("long").alias("attempt"))


class Lease(StatefulProcessor):
    """A job's lease: the last beat, the attempts so far, and beats that wait until no earlier one can come.

    A beat that comes in time renews the lease whatever the order of arrival, so it is taken at once. What a later beat means
    hangs on the beats before it, and it waits until the watermark has passed the lease's end or, if there is no lease, the
    beat itself. The state of a job holds the beats of one delay at most. A timer wakes a job that has no more beats.
    """

    def __init__(self, job: str, lease_us: int) -> None:
        self.job, self.lease_us = job, lease_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "last long, attempt long")
        self.waiting = handle.getListState("waiting", "beat long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        beats = [int(b) for part in rows for b in part["beat_us"]]
        yield from self._advanced(key, beats, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advanced(key, [], timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        """Nothing is held outside the state."""

    def _advanced(self, key, beats: list[int], watermark: int) -> Iterator[pd.DataFrame]:
        last, attempt = self.lease.get() if self.lease.exists() else (None, 0)
        waiting, lost = sorted([b for (b,) in self.waiting.get()] + beats), []
        while True:
            if last is None:
                if not waiting or waiting[0] > watermark:
                    break
                last = waiting.pop(0)
            elif waiting and waiting[0] <= last + self.lease_us:
                last = max(last, waiting.pop(0))
            elif last + self.lease_us < watermark:
                attempt += 1
                lost.append((*key, last, last + self.lease_us, attempt))
                last = None
            else:
                break
        self.lease.update((last, attempt))
        self.waiting.put([(b,) for b in waiting]) if waiting else self.waiting.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if last is not None or waiting:
            self.handle.registerTimer((waiting[0] if last is None else last + self.lease_us) // 1000 + 1)
        if lost:
            yield pd.DataFrame(lost, columns=[self.job, "last_beat", "due", "attempt"])


def lease_stream(beats: DataFrame, job: str, at: str, lease_us: int, delay: str) -> DataFrame:
    """(job, last_beat, due, attempt) of the leases of a stream of beats (job, at) that ran out before the watermark.

    The watermark follows the latest beat by delay; beats later than that are dropped. The rows are those of lease_expiries
    with the last watermark as now. Needs the RocksDB state store (state_store).
    """
    kind = beats.schema[job].dataType.simpleString()
    timed = beats.filter(F.col(at).isNotNull() & F.col(job).isNotNull()).select(job, at, F.unix_micros(F.col(at).cast("timestamp")).alias("beat_us")).withWatermark(at, delay)
    return timed.groupBy(job).transformWithStateInPandas(Lease(job, lease_us), f"{job} {kind}, last_beat long, due long, attempt long", "append", "eventTime")
