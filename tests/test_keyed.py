"""Keyed tables: a batch changes its buckets only, and old rows aren't shuffled."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lorewell.operators.graph import upsert_docs
from lorewell.sources import keyed, tables
from lorewell.sources.keyed import KeyedTable

SCHEMA = "id string, v int, w double"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(path):
    return {(str(p), p.stat().st_mtime_ns) for p in Path(path, "data").rglob("*.parquet")}


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable.create(spark, str(tmp_path / "t"), SCHEMA, buckets=6)


def test_batches_replace_keys_and_touch_their_buckets_only(spark, table):
    assert rows(table.read()) == []
    first = [(f"k{i}", i, float(i)) for i in range(200)]
    table.put(spark.createDataFrame(first, SCHEMA).repartition(3))
    assert rows(table.read()) == sorted(first, key=str)
    before, held = files(table.path), table.read().select("id", F.input_file_name().alias("file")).collect()
    change = [("k5", -5, None), ("new", 1, 1.0), ("k5", -6, None)]
    bucket = {r["id"]: r["b"] for r in table.read().select("id", table._bucket("id").alias("b")).collect()}
    touched = {r[0] for r in spark.createDataFrame(change, SCHEMA).select(table._bucket("id")).distinct().collect()}
    table.put(spark.createDataFrame(change, SCHEMA))
    want = {r[0]: r for r in first} | {"k5": ("k5", -5, None), "new": ("new", 1, 1.0)}
    assert rows(table.read()) == sorted(want.values(), key=str)
    assert before <= files(table.path)  # nothing was written over
    now = {r["id"]: r["file"] for r in table.read().select("id", F.input_file_name().alias("file")).collect()}
    assert all((now[r["id"]] == r["file"]) == (bucket[r["id"]] not in touched) for r in held)
    assert rows(table.find("k5", "new", "nowhere")) == [("k5", -5, None), ("new", 1, 1.0)]
    assert table.vacuum() > 0 and rows(table.read()) == sorted(want.values(), key=str) and len(files(table.path)) < len(before) + 5


def test_old_rows_are_not_shuffled(spark, table):
    table.put(spark.createDataFrame([(f"k{i}", i, 0.0) for i in range(500)], SCHEMA))
    part = spark.createDataFrame([("k1", 0, 0.0)], SCHEMA)
    for side in table._apart(table.read(), part):
        side.collect()
        plan = side._jdf.queryExecution().executedPlan().toString()
        old = plan.split("BroadcastExchange")[0]
        assert "BroadcastHashJoin" in old and "Exchange" not in old.replace("BroadcastExchange", "").replace("BroadcastQueryStage", "")


def test_large_batches_are_cut(spark, table, monkeypatch):
    monkeypatch.setattr(keyed, "BATCH", 20)
    first = [(f"k{i}", i, 0.0) for i in range(300)]
    table.put(spark.createDataFrame(first, SCHEMA))
    table.put(spark.createDataFrame([(k, -v, 1.0) for k, v, _ in first if v % 2], SCHEMA))
    assert rows(table.read()) == sorted(((k, -v, 1.0) if v % 2 else (k, v, 0.0) for k, v, _ in first), key=str)
    table.remove(spark.createDataFrame([(k,) for k, v, _ in first if v > 9], "id string"))
    assert table.read().count() == 10
    table.remove(table.read())
    assert rows(table.read()) == [] and keyed._parts({1: 15, 2: 4, 3: 9, 4: 50}) == [([1, 2], 1), ([4], 4), ([3], 1)]


def test_a_batch_that_fails_leaves_the_version(spark, table):
    table.put(spark.createDataFrame([("a", 1, 1.0)], SCHEMA))

    def fails(old, new):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        table.merge(spark.createDataFrame([("a", 2, 2.0)], SCHEMA), fails)
    assert rows(table.read()) == [("a", 1, 1.0)]
    table.put(spark.createDataFrame([(None, 2, 2.0)], SCHEMA))
    assert rows(table.read()) == [("a", 1, 1.0)]


def test_graph_documents_are_merged(spark, tmp_path):
    kind = "id string, graph_type string, description string, weight double, source_ids array<string>, updated_at int"
    old = [(f"e{i}", "relation", f"d{i}", 1.0, [f"c{i}"], 1) for i in range(40)]
    new = [("e3", "relation", "more", 3.0, ["c3", "x"], 2), ("e99", "entity", "n", 1.0, ["y"], 2), ("e3", "relation", "last", 5.0, [], 3)]
    table = KeyedTable.create(spark, str(tmp_path / "g"), kind, buckets=4)
    tables.put_graph_docs(table, spark.createDataFrame(old, kind))
    tables.put_graph_docs(table, spark.createDataFrame(new, kind))
    assert rows(table.read()) == rows(upsert_docs(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind)))


def test_empty_buckets_are_written_in_one_pass(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "BATCH", 20)
    table = keyed.KeyedTable.create(spark, f"{tmp_path}/fresh", "id long, x string", buckets=4)
    rows = spark.range(400).selectExpr("id % 300 as id", "cast(id as string) as x")
    table.put(rows)
    assert table._version()[0] == 1  # one pass; in parts of BATCH rows it took a version each
    assert {r["id"]: r["x"] for r in table.read().collect()} == {i: max(str(i), str(i + 300)) if i < 100 else str(i) for i in range(300)}
    table.put(spark.createDataFrame([(5, "new"), (999, "more")], "id long, x string"))
    assert table.read().count() == 301 and [r["x"] for r in table.find(5).collect()] == ["new"]
    table.put(rows.limit(0))
    assert table.read().count() == 301
