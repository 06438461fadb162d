"""Keyed state with timers: tasks that become due by themselves, and batches by count or time.

Both fold rows one by one into state that Spark keeps and checkpoints: no key's rows are held whole (of a
task's failures, their different times are), and a stream that is restarted goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: seconds to the first new try, how often they double at most, and tries of a task
FIRST, MOST_DOUBLINGS, TRIES = 30, 30, 3
#: items that are held before they are put into the state together
HELD = 10_000
TASK = "id long, status string, retry_times int, next_retry long, due boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session with the state store that keyed state with timers needs, for the streams started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def next_retry(failed_at: int, tries: int) -> int:
    """When the try after the ``tries``-th failure is due."""
    return failed_at + (FIRST << min(tries - 1, MOST_DOUBLINGS))


TASK_STATE = "success long, last_at long, last string, fails int, fail_at long, sent int, times array<long>, counts array<int>"


def task_step(tries: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """What a batch of outcomes, or the time of the next try, makes of a task.

    The state has the task's first success, its last event and its failures as runs of times and counts, and the number of
    failures when it was last due. Outcomes count in the order of (time, name), however they arrive: a success is final, and what
    comes after it is ignored. States travel with the rows by Arrow: a call to the state store a task would be a round trip each.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        success, last_at, last, fails, fail_at, sent, times, counts = state.get if state.exists else (None, None, None, 0, None, 0, [], [])
        shown = []

        def show(due: bool) -> None:
            status = "success" if success is not None else "retrying" if sent >= fails > 0 and last == "fail" else last or "init"
            shown.append((key[0], status, fails, next_retry(fail_at, fails) if fails else 0, due))

        if not state.hasTimedOut:
            held = dict(zip(times, counts, strict=True))
            for part in parts:
                for at, what in zip(part["at"].tolist(), part["outcome"].tolist(), strict=True):
                    if at != at or at is None or what not in ("fail", "success", "retrying") or (success is not None and at > success):
                        continue
                    at = int(at)
                    if what == "success":
                        success = at
                        continue
                    if what == "fail":
                        held[at] = held.get(at, 0) + 1
                    if last_at is None or (at, what) > (last_at, last):
                        last_at, last = at, what
            if success is not None:  # some were counted before the success was known
                held = {at: n for at, n in held.items() if at <= success}
            fails, fail_at, times, counts = sum(held.values()), max(held, default=None), list(held), list(held.values())
            show(False)
        if success is None and last == "fail" and sent < fails < tries:
            wait = 1000 * next_retry(fail_at, fails) - state.getCurrentProcessingTimeMs()
            if wait > 0 and not state.hasTimedOut:
                state.setTimeoutDuration(wait)
            else:  # due, maybe already when its outcomes came
                sent = fails
                show(True)
        state.update((success, last_at, last, fails, fail_at, sent, times, counts))
        if shown:
            yield pd.DataFrame(shown, columns=["id", "status", "retry_times", "next_retry", "due"])

    return step


def timed_tasks(outcomes: DataFrame, tries: int = TRIES) -> DataFrame:
    """id, status, retry_times, next_retry, due: the state of every task in a batch, from a stream (id, at: epoch seconds, outcome).

    A failed task with tries left has a timer for its next try; when that time has come it is given out once with ``due``,
    as retrying, without any event. A success is final. Events without a time or of another kind are ignored.
    """
    with_state_store(outcomes.sparkSession)
    return outcomes.select("id", "at", "outcome").groupBy("id").applyInPandasWithState(task_step(tries), TASK, TASK_STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


class BatchProcessor(StatefulProcessor):
    """The items of a key that wait for their batch, and when they go even if it is not full."""

    def __init__(self, size: int, seconds: float) -> None:
        self.size, self.seconds = size, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getListState("items", "item string")
        self.count = handle.getValueState("count", "waiting int, batch int, timer long")

    def _out(self, key: tuple, batch: int, new: list[str], stored: bool, full: bool) -> Row:
        items = [x[0] for x in self.items.get()] if stored else []
        if stored:
            self.items.clear()
        return Row(key=key[0], batch=batch, items=items + new, full=full)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        stored, batch, timer = self.count.get() or (0, 0, None)
        before, new = stored, []
        for row in rows:
            new.append(row.item)
            if stored + len(new) == self.size:
                yield self._out(key, batch, new, stored > 0, True)
                stored, batch, before, new = 0, batch + 1, 0, []
            elif len(new) == HELD:
                self.items.appendList([(x,) for x in new])
                stored, new = stored + len(new), []
        if new:
            self.items.appendList([(x,) for x in new])
            stored += len(new)
        if not before:  # what waits came in this round: its time begins now
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.seconds) if stored else None
            if stored:
                self.handle.registerTimer(timer)
        self.count.update((stored, batch, timer))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        waiting, batch, _ = self.count.get() or (0, 0, None)
        if waiting:
            self.count.update((0, batch + 1, None))
            yield self._out(key, batch, [], True, False)

    def close(self) -> None:
        pass


def count_or_time(rows: DataFrame, key: str, item: str, size: int, seconds: float) -> DataFrame:
    """key, batch (from 0), items, full: the items of each key in batches of ``size``; a shorter one goes ``seconds`` after its first item."""
    with_state_store(rows.sparkSession)
    kind = dict(rows.dtypes)[key]
    df = rows.selectExpr(f"`{key}` AS key", f"CAST(`{item}` AS string) AS item")
    return df.groupBy("key").transformWithState(BatchProcessor(size, seconds), f"key {kind}, batch int, items array<string>, full boolean", "append", "processingTime")
