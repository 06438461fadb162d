"""Messages in and out, and ingestion that survives a restart."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lorewell.operators.documents import PENDING

TOPICS = ("document_index", "graph_generate")


def read_topic(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """value (string) of every message from the first offset on."""
    stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return stream.option("startingOffsets", "earliest").load().select(F.col("value").cast("string").alias("value"))


def read_folder(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """value of every line of the files that arrive in a folder."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(path)


def parsed(messages: DataFrame, schema: str, *needed: str) -> DataFrame:
    """Columns of ``schema``; malformed messages and those without a needed field are dropped."""
    df = messages.select(F.from_json("value", schema).alias("m")).where("m is not null").select("m.*")
    for name in needed:
        df = df.where(F.coalesce(F.col(name).cast("string"), F.lit("")) != "")
    return df


def once(messages: DataFrame, key: str, time_col: str, delay: str = "10 minutes") -> DataFrame:
    """Messages without those that repeat a ``key`` within ``delay`` of its first one.

    State of a key goes when the watermark, ``delay`` behind the latest time, has passed it. Messages later than that are dropped.
    """
    return messages.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([key])


def for_pending(messages: DataFrame, rows: DataFrame, key: str = "document_id") -> DataFrame:
    """Messages of documents that are pending; ``rows`` is a table, read anew for every micro-batch."""
    pending = rows.where(F.col("run_status") == PENDING).select(F.col("id").cast("string").alias(key)).distinct()
    return messages.join(pending, key, "left_semi")


def as_messages(rows: DataFrame, topic: str) -> DataFrame:
    """topic, value (JSON); only known topics."""
    if topic not in TOPICS:
        raise ValueError(f"no topic {topic!r}")
    some = F.coalesce(*[F.col(c).cast("string") for c in rows.columns]).isNotNull()  # a message of nulls is none
    return rows.where(some).select(F.lit(topic).alias("topic"), F.to_json(F.struct("*")).alias("value"))


def publish(rows: DataFrame, topic: str, servers: str) -> None:
    """Writes rows as messages of a topic, from the tasks that hold them."""
    as_messages(rows, topic).write.format("kafka").option("kafka.bootstrap.servers", servers).save()


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = None, mode: str = "append") -> StreamingQuery:
    """``handle`` for every micro-batch; all that is there at once, or every ``seconds``.

    A batch is handled again after a failure, so ``handle`` has to write by batch id or by key.
    """
    writer = stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def run_until_idle(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", seconds: float = 0.5, idle: int = 2) -> None:
    """Micro-batches until ``idle`` of them in a row had no rows to read.

    For streams with timers, whose batches go on without rows, so that a run over what is there would not end; timers that
    are due by then have fired. Batches that take longer than ``seconds`` follow each other without a pause, so the end
    doesn't wait for one: the batch that comes next is refused before it is handled, and is handled by the next run.
    """
    ended, refused, under_way = threading.Event(), threading.Event(), threading.Lock()

    def until_ended(df: DataFrame, batch: int) -> None:
        with under_way:
            if ended.is_set():
                refused.set()
                raise RuntimeError("the run has ended")
            handle(df, batch)

    query = stream.writeStream.outputMode(mode).foreachBatch(until_ended).option("checkpointLocation", checkpoint).trigger(processingTime=f"{int(1000 * seconds)} milliseconds").start()
    last, quiet = None, 0
    while query.isActive and quiet < idle:
        now = query.lastProgress
        if now is not None and now["batchId"] != last:
            last, quiet = now["batchId"], 0 if now["numInputRows"] else quiet + 1
        time.sleep(seconds / 4)
    with under_way:  # a batch that is being handled ends first
        ended.set()
    while query.isActive and query.status["isTriggerActive"]:  # until it is written down, or the next one is refused
        time.sleep(0.02)
    if query.exception() is not None and not refused.is_set():
        raise query.exception()
    query.stop()
