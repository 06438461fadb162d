"""The retry scan as a stream: every 30 seconds the due tasks go out again and are marked, once a batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorewell.operators import catalog
from lorewell.sources.keyed import KeyedTable
from lorewell.streaming.messages import TOPICS, run_batches

SECONDS, LIMIT = 30, 100


class RetryScan:
    """Sends due tasks of a keyed table (``schemas.TASK`` and ``task_type``) again, at most ``limit`` a batch.

    A batch has three steps, each of which leaves a mark, so that a batch that is handled again goes on where it
    stopped: the due tasks are written down (``claims``), given to ``publish``, and marked as retrying in the table. A
    batch that was published publishes nothing again; only a failure inside of ``publish``, or between it and its mark, sends
    messages twice, and those bear their task's id. A task that has changed since it was claimed is not marked.
    """

    def __init__(self, tasks: KeyedTable, path: str, publish: Callable[[DataFrame], None], now: Callable[[], Column] = F.current_timestamp, topics: Sequence[str] = TOPICS, limit: int = LIMIT) -> None:
        self.tasks, self.path, self.publish, self.now, self.topics, self.limit = tasks, path.rstrip("/"), publish, now, topics, limit
        self.spark = tasks.spark

    def _done(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def handle(self, _: DataFrame | None, batch: int) -> None:
        """One scan; ``batch`` is the stream's number of it."""
        claims, sent = f"claims/batch={batch}", f"sent/batch={batch}"
        if not self._done(claims):
            tasks = self.tasks.read()
            _, out = catalog.republished(tasks, self.now(), self.topics, limit=self.limit)
            claimed = out.join(tasks.select("id", "status", "retry_times"), "id")
            claimed.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{claims}")  # ``limit`` rows at most
        claimed = self.spark.read.parquet(f"{self.path}/{claims}")
        if not self._done(sent):
            self.publish(claimed.select("id", "topic", "value"))
            claimed.select("id").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{sent}")
        self.tasks.merge(claimed.select("id", "status", "retry_times"), self._marked)

    def _marked(self, old: DataFrame, claimed: DataFrame) -> DataFrame:
        was = claimed.select("id", F.col("status").alias("_status"), F.col("retry_times").alias("_times"))
        same = F.col("status").eqNullSafe(F.col("_status")) & F.col("retry_times").eqNullSafe(F.col("_times"))
        return catalog.updated(old.join(was, "id", "left"), same, status="retrying").drop("_status", "_times")

    def start(self, checkpoint: str, seconds: int = SECONDS) -> StreamingQuery:
        """A scan every ``seconds``, until the query is stopped."""
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return run_batches(ticks, self.handle, checkpoint, seconds)
