"""Texts to a model in batches: exact sizes across Arrow's borders, in order, several calls at a time, each with a deadline."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

#: texts of a call, calls at a time in a task, and seconds of a call
SIZE, WORKERS, SECONDS = 10, 4, 60.0


class Call:
    """A call of the model that runs in a thread of its own; one that passes its deadline is left behind."""

    def __init__(self, model: Callable[[list[str]], Sequence[Sequence[float]]], texts: list[str], seconds: float) -> None:
        self.until, self.vectors, self.error = time.monotonic() + seconds, None, None
        self.n = len(texts)
        self.thread = threading.Thread(target=self._run, args=(model, texts), daemon=True)
        self.thread.start()

    def _run(self, model: Callable[[list[str]], Sequence[Sequence[float]]], texts: list[str]) -> None:
        try:
            self.vectors = [None if v is None else [float(x) for x in v] for v in model(texts)]
        except Exception as e:  # noqa: BLE001  whatever a model raises becomes the reason of its batch
            self.error = f"{type(e).__name__}: {e}"

    def result(self) -> tuple[list, str | None]:
        """A vector a text, or nulls and the reason."""
        self.thread.join(max(0.0, self.until - time.monotonic()))
        late, vectors, error = self.thread.is_alive(), self.vectors, self.error
        if late:
            return [None] * self.n, "deadline"
        if error is not None:
            return [None] * self.n, error
        if len(vectors) != self.n:
            return [None] * self.n, f"{len(vectors)} vectors for {self.n} texts"
        return vectors, None


def regrouped(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Tables of exactly ``size`` rows in order, the last one shorter."""
    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, size - n)
            held.append(part)
            n += part.num_rows
            at += part.num_rows
            if n == size:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def embedded(rows: DataFrame, model: Callable[[list[str]], Sequence[Sequence[float]]], text_col: str = "content", vector_col: str = "content_vector", reason_col: str = "embed_error", size: int = SIZE, workers: int = WORKERS, seconds: float = SECONDS) -> DataFrame:
    """``rows`` with a vector and, where there is none, the reason; rows stay in their task and in their order.

    ``model`` gets ``size`` texts a call (the last call of a task fewer), ``workers`` calls run at a time, and each
    has ``seconds`` from its start. A call that fails, answers too late or gives another number of vectors leaves nulls and a
    reason in its batch's rows alone, so that a caller can try these again. Null texts are empty ones.
    """
    at, kept = rows.columns.index(text_col), rows.drop(vector_col, reason_col).columns
    schema = ", ".join([f"`{c}` {dict(rows.dtypes)[c]}" for c in kept] + [f"`{vector_col}` array<double>", f"`{reason_col}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: deque[tuple[pa.Table, Call]] = deque()

        def done() -> Iterator[pa.RecordBatch]:
            table, call = waiting.popleft()
            vectors, reason = call.result()
            table = table.select(kept).append_column(vector_col, pa.array(vectors, pa.list_(pa.float64()))).append_column(reason_col, pa.array([reason] * call.n, pa.string()))
            yield from table.combine_chunks().to_batches()

        for table in regrouped(batches, size):
            if len(waiting) == workers:
                yield from done()
            waiting.append((table, Call(model, [x or "" for x in table.column(at).to_pylist()], seconds)))
        while waiting:
            yield from done()

    return rows.mapInArrow(run, schema)
