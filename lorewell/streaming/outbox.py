"""The state of tasks from the stream of their outcomes: init, success, fail with a backoff, retrying."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "status string, retry_times int, next_retry long"
#: seconds to the first new try, and how often they double at most (tasks give up long before)
FIRST, MOST_DOUBLINGS = 30, 30
OUT = "id long, status string, retry_times int, next_retry long"


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, tries, due = state.get if state.exists else ("init", 0, 0)
    events = pd.concat(list(frames)).sort_values(["at", "outcome"], kind="stable")
    for at, outcome in zip(events["at"], events["outcome"], strict=True):
        if status == "success":
            break
        if outcome == "fail":
            due, tries, status = int(at) + (FIRST << min(tries, MOST_DOUBLINGS)), tries + 1, "fail"
        elif outcome in ("success", "retrying"):
            status = outcome
    state.update((status, tries, due))
    yield pd.DataFrame({"id": [key[0]], "status": [status], "retry_times": [tries], "next_retry": [due]})


def task_states(outcomes: DataFrame) -> DataFrame:
    """Latest state of each task in a batch, from a stream (id, at: epoch seconds, outcome). A success is final."""
    return outcomes.groupBy("id").applyInPandasWithState(_step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
