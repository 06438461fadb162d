"""Streams with timers, restarts, replays and repeated messages."""

import datetime
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from lorewell import schemas
from lorewell.sources.keyed import KeyedTable
from lorewell.streaming import messages, retries, stateful

EVENTS = "id long, at long, outcome string"


class Feed:
    """A folder that a stream reads; every put is a file."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n = spark, path, schema, 0
        (path / "in").mkdir()

    def put(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.path}/out{self.n}")
        part = next((self.path / f"out{self.n}").glob("part-*.parquet"))
        part.rename(self.path / "in" / f"{self.n:03}.parquet")

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in")


@pytest.fixture
def feed(spark, tmp_path):
    return lambda schema: Feed(spark, tmp_path, schema)


def brute(events):
    """State of each task from all of its events."""
    out = {}
    for i in {e[0] for e in events}:
        own = sorted((at, what) for j, at, what in events if j == i and at is not None and what in ("fail", "success", "retrying"))
        if ("success") in [w for _, w in own]:
            own = own[: [w for _, w in own].index("success") + 1]
        fails = [at for at, w in own if w == "fail"]
        status = own[-1][1] if own else "init"
        due = status == "fail" and len(fails) < 3
        out[i] = ("retrying" if due else status, len(fails), stateful.next_retry(max(fails), len(fails)) if fails else 0, due)
    return out


def run(stream, path):
    """The last row of each task, and how often each became due."""
    rows = []
    messages.run_until_idle(stream, lambda df, n: rows.extend((n, r) for r in df.collect()), f"{path}/marks", mode="update")
    last, due = {}, {}
    for n, r in sorted(rows, key=lambda x: (x[0], x[1]["due"])):
        last[r["id"]] = (r["status"], r["retry_times"], r["next_retry"])
        due[r["id"]] = due.get(r["id"], 0) + r["due"]
    return last, due


def test_tasks_become_due_by_themselves_and_survive_a_restart(spark, feed, tmp_path):
    rng, f = random.Random(1), feed(EVENTS)
    first = [(rng.randrange(20), rng.randrange(1000), rng.choice(["fail", "fail", "retrying", "success", "odd", None])) for _ in range(60)] + [(30, 5, "fail"), (31, None, "fail")]
    f.put(first)
    last, due = run(stateful.timed_tasks(f.stream()), tmp_path)
    assert last == {i: s[:3] for i, s in brute(first).items()} and due == {i: int(s[3]) for i, s in brute(first).items()}
    assert due[30] == 1 and last[30] == ("retrying", 1, 35)
    second = [(rng.randrange(20), rng.randrange(500, 2000), rng.choice(["fail", "success"])) for _ in range(40)] + [(30, 90, "fail")]
    f.put(second)  # the stream goes on with the state it had
    last, due = run(stateful.timed_tasks(f.stream()), tmp_path)
    want = brute(first + second)
    assert {i: want[i][:3] for i in last} == last and set(last) == {e[0] for e in second}
    assert due[30] == 1 and last[30] == ("retrying", 2, 150)  # due again, later by twice the wait


def test_a_task_is_not_due_before_its_time(spark, feed, tmp_path):
    f, now = feed(EVENTS), int(time.time())
    f.put([(1, now + 900, "fail"), (2, now - 31, "fail")])
    last, due = run(stateful.timed_tasks(f.stream()), tmp_path)
    assert last[1] == ("fail", 1, now + 930) and due[1] == 0
    assert last[2] == ("retrying", 1, now - 1) and due[2] == 1


def test_a_key_with_very_many_events(spark, feed, tmp_path):
    f = feed(EVENTS)
    f.put([(1, t, "fail") for t in range(20_000)] + [(1, 9_999, "success")])
    last, _ = run(stateful.timed_tasks(f.stream()), tmp_path)
    assert last == {1: ("success", 10_000, stateful.next_retry(9_999, 10_000))}


def test_batches_by_count_or_time(spark, feed, tmp_path):
    f = feed("k string, x int")
    rows = []
    stream = lambda: stateful.count_or_time(f.stream(), "k", "x", 3, 1.5)
    handle = lambda df, n: rows.extend(df.collect())
    f.put([("a", i) for i in range(7)] + [("b", 100)])
    messages.run_until_idle(stream(), handle, f"{tmp_path}/marks", idle=8)
    full = [r for r in rows if r["full"]]
    assert sorted((r["key"], r["batch"], len(r["items"])) for r in full) == [("a", 0, 3), ("a", 1, 3)]
    late = [r for r in rows if not r["full"]]
    assert sorted((r["key"], r["batch"], len(r["items"])) for r in late) == [("a", 2, 1), ("b", 0, 1)]
    assert sorted(int(x) for r in rows for x in r["items"]) == [*range(7), 100]
    rows.clear()
    f.put([("b", 1), ("b", 2), ("b", 3), ("b", 4)])
    messages.run_until_idle(stream(), handle, f"{tmp_path}/marks", idle=8)
    assert sorted((r["batch"], r["full"], len(r["items"])) for r in rows) == [(1, True, 3), (2, False, 1)]


def test_repeated_and_late_messages(spark, feed, tmp_path):
    f = feed("document_id string, ts timestamp")
    pending = spark.createDataFrame([("a", "pending"), ("b", "pending"), ("c", "pending"), ("d", "done")], "id string, run_status string")
    out = []

    def put(*rows):
        f.put([(i, datetime.datetime.fromisoformat(f"2024-01-01T{t}:00")) for i, t in rows])

    put(("a", "10:00"), ("a", "10:03"), ("d", "10:00"))
    put(("a", "10:05"), ("b", "10:30"))
    put(("c", "09:00"))  # behind the watermark
    put(("a", "10:45"))  # long after: taken as new
    stream = messages.for_pending(messages.once(f.stream(), "document_id", "ts", "10 minutes"), pending)
    messages.run_batches(stream, lambda df, n: out.extend((n, r["document_id"]) for r in df.collect()), f"{tmp_path}/marks").awaitTermination()
    assert [i for _, i in sorted(out)] == ["a", "b", "a"]


@pytest.fixture
def scan(spark, tmp_path):
    tasks = KeyedTable.create(spark, str(tmp_path / "tasks"), schemas.TASK + ", task_type string", buckets=4)
    old = "timestamp'2024-01-01 00:00:00'"
    df = spark.range(250).selectExpr(
        "id", "CASE WHEN id % 10 = 0 THEN 'success' ELSE 'fail' END AS status", "CAST(id % 2 AS int) AS retry_times", "3 AS max_retry_times", f"{old} + make_interval(0,0,0,0,0,0,id) AS next_retry_time", f"{old} AS created_time",
        "to_json(struct(CAST(id AS string) AS document_id)) AS payload", "CASE WHEN id % 7 = 0 THEN 'other' ELSE 'document_index' END AS task_type",
    )
    tasks.put(df)
    sent = []
    return tasks, sent, retries.RetryScan(tasks, str(tmp_path / "scan"), lambda out: sent.extend(out.collect()))


def test_a_replayed_scan_sends_nothing_twice(spark, scan):
    tasks, sent, job = scan
    job.handle(None, 0)
    first = len(sent)
    assert 0 < first <= 100 and all(json.loads(r["value"])["local_message_id"] == str(r["id"]) for r in sent)
    assert {r["id"] for r in tasks.read().where("status = 'retrying'").collect()} == {r["id"] for r in sent}
    job.handle(None, 0)
    assert len(sent) == first
    for batch in range(1, 6):
        job.handle(None, batch)
    want = {i for i in range(250) if i % 10 and i % 7}
    assert len(sent) == len({r["id"] for r in sent}) and {r["id"] for r in sent} <= want


def test_a_scan_goes_on_where_it_stopped(spark, scan, monkeypatch):
    tasks, sent, job = scan
    monkeypatch.setattr(tasks, "merge", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        job.handle(None, 0)
    monkeypatch.undo()
    first = [r["id"] for r in sent]
    tasks.put(tasks.find(first[0]).withColumn("status", F.lit("success")))  # done in the meantime
    job.handle(None, 0)
    assert [r["id"] for r in sent] == first
    status = {r["id"]: r["status"] for r in tasks.read().collect()}
    assert status[first[0]] == "success" and all(status[i] == "retrying" for i in first[1:])


def test_scans_run_as_a_stream(spark, scan, tmp_path):
    tasks, sent, job = scan
    query = job.start(f"{tmp_path}/ticks", seconds=1)
    until = time.time() + 60
    while time.time() < until and len(sent) < 120:
        time.sleep(0.5)
    while query.status["isTriggerActive"]:
        time.sleep(0.05)
    query.stop()
    assert len(sent) >= 120 and len(sent) == len({r["id"] for r in sent})


def test_a_task_and_a_batch_cost_few_calls_to_the_state(spark, feed, tmp_path):
    """Calls to the state store used to grow with rows: a call an item, and a dozen a task, each a round trip."""
    began, f = time.time(), feed(EVENTS)
    f.put([(i, i, "fail") for i in range(6000)])
    last, due = run(stateful.timed_tasks(f.stream()), tmp_path)
    assert len(last) == 6000 and set(last.values()) == {("retrying", 1, stateful.next_retry(i, 1)) for i in range(6000)} and set(due.values()) == {1}
    assert time.time() - began < 60
    calls = []

    class State:
        def __getattr__(self, name):
            return lambda *a: calls.append(name)

    batch = stateful.BatchProcessor(400, 1)
    batch.handle = batch.items = batch.count = State()
    batch.count = type("Count", (State,), {"get": lambda self: None})()
    now = type("Now", (), {"getCurrentProcessingTimeInMs": lambda self: 0})()
    out = list(batch.handleInputRows(("k",), iter([type("R", (), {"item": str(i)}) for i in range(4100)]), now))
    assert [len(r["items"]) for r in out] == [400] * 10 and [r["batch"] for r in out] == list(range(10))
    assert calls == ["appendList", "registerTimer", "update"]


def test_a_run_ends_though_its_batches_follow_without_a_pause(spark, feed, tmp_path):
    """Its end used to wait for a moment between two batches, and slow ones leave none."""
    f, rows, began = feed(EVENTS), [], []

    def handle(df, n):
        began.append(n)
        assert len(began) < 12
        time.sleep(0.8)
        rows.extend((n, r) for r in df.collect())

    f.put([(1, 5, "fail"), (2, 5, "success")])
    messages.run_until_idle(stateful.timed_tasks(f.stream()), handle, f"{tmp_path}/marks", mode="update")
    assert {(r["id"], r["status"], r["due"]) for _, r in rows} == {(1, "fail", False), (1, "retrying", True), (2, "success", False)}
    began.clear()
    rows.clear()
    f.put([(1, 90, "success")])  # the run before refused a batch, or none: nothing is lost
    messages.run_until_idle(stateful.timed_tasks(f.stream()), handle, f"{tmp_path}/marks", mode="update")
    assert [(r["id"], r["status"]) for _, r in rows] == [(1, "success")]


def test_a_failed_batch_fails_the_run(spark, feed, tmp_path):
    f = feed(EVENTS)
    f.put([(1, 5, "fail")])
    with pytest.raises(Exception, match="no room"):
        messages.run_until_idle(stateful.timed_tasks(f.stream()), lambda df, n: (_ for _ in ()).throw(RuntimeError("no room")), f"{tmp_path}/marks", mode="update")
