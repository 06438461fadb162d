"""Tables by key that change a batch at a time: a batch rewrites the buckets that its keys fall in, and nothing else.

Rows lie in buckets by a hash of their key. A version of the table is a list of buckets, each with the
folder that holds it; files never change. A batch is applied in parts of at most ``BATCH`` rows, which are small
enough to be sent to every executor: rows of the touched buckets are read in place, those that the
part does not name are written on as they are, and only rows of the same key are brought
together. So old rows are never shuffled, whatever the table's size.

A version counts once its list is written whole: a job that fails leaves the last one, and readers keep
the version they began with. ``vacuum`` deletes folders that the last version no longer names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lorewell.sources.scratch import shared_path

#: rows of a batch that are sent to every executor at once
BATCH = 500_000
BUCKETS = "bucket int, folder string"


class KeyedTable:
    """Reads and writes the table below ``path``; ``create`` makes an empty one."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        about = spark.read.parquet(f"{self.path}/about").first()
        self.key, self.buckets, self.schema = about["key"], about["buckets"], StructType.fromJson(json.loads(about["schema"]))

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType | str, key: str = "id", buckets: int = 64) -> KeyedTable:
        kind = spark.createDataFrame([], schema).schema
        kind = spark.createDataFrame([], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind)).schema  # without what a column says of nulls
        spark.createDataFrame([(key, buckets, kind.json())], "key string, buckets int, schema string").coalesce(1).write.parquet(f"{path.rstrip('/')}/about")
        spark.createDataFrame([], BUCKETS).coalesce(1).write.parquet(f"{path.rstrip('/')}/versions/0")
        return cls(spark, path)

    def _there(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _version(self) -> tuple[int, dict[int, str]]:
        """The last version's number, and the folder of each bucket that has rows."""
        at, files = self._there("versions")
        done = lambda p: files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        last = max(int(s.getPath().getName()) for s in files.listStatus(at) if done(s.getPath()))
        rows = self.spark.read.schema(BUCKETS).parquet(f"{self.path}/versions/{last}").collect()
        return last, {r["bucket"]: r["folder"] for r in rows}

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _rows(self, folders: dict[int, str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}/bucket={b}" for b, f in sorted(folders.items())])

    def read(self) -> DataFrame:
        """The rows of the last version."""
        return self._rows(self._version()[1])

    def find(self, *keys: object) -> DataFrame:
        """The rows of some keys, from their buckets alone."""
        kind = self.schema[self.key].dataType
        wanted = self.spark.createDataFrame([(k,) for k in keys], StructType().add(self.key, kind))
        numbers = {r[0] for r in wanted.select(self._bucket(self.key)).distinct().collect()}
        folders = {b: f for b, f in self._version()[1].items() if b in numbers}
        return self._rows(folders).where(F.col(self.key).isin(list(keys)))

    def put(self, batch: DataFrame) -> None:
        """Rows in place of those of their keys; of rows that share a key in the batch, one is kept."""
        last = batch.groupBy(self.key).agg(F.max(F.struct(*[c for c in self.schema.names if c != self.key])).alias("_r"))
        self.merge(last.select(self.key, "_r.*"), lambda old, new: new)

    def remove(self, keys: DataFrame) -> None:
        self.merge(keys.select(self.key).distinct(), lambda old, new: old.limit(0))

    def merge(self, batch: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """``combine(old rows of the batch's keys, rows of the batch)`` in place of the old rows.

        The batch is cut by key, so ``combine`` sees all rows of a key together. Rows without a key take no part. The batch
        is written by bucket, so a part reads its own rows alone; buckets that hold nothing yet are written in one pass, whatever their number of rows.
        """
        kept = shared_path(self.spark, "keyed-batch")
        batch = batch.where(F.col(self.key).isNotNull()).withColumn("_bucket", self._bucket(self.key))
        batch.write.partitionBy("_bucket").parquet(kept)
        rows = self.spark.read.schema(batch.schema).parquet(kept)
        counts = {r["_bucket"]: r["n"] for r in rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect()}  # a number a bucket
        held = self._version()[1]
        fresh = sorted(b for b in counts if b not in held)
        if fresh:
            self._write(combine(self.spark.createDataFrame([], self.schema), rows.where(F.col("_bucket").isin(fresh)).drop("_bucket")), fresh)
        for numbers, cuts in _parts({b: n for b, n in counts.items() if b in held}):
            for cut in range(cuts):
                part = rows.where(F.col("_bucket").isin(numbers))
                if cuts > 1:  # a bucket of its own, whose rows are too many to be sent at once
                    part = part.where(F.pmod(F.xxhash64(self.key, F.lit("cut")), F.lit(cuts)) == cut)
                self._apply(part.drop("_bucket"), numbers, combine)

    def _apply(self, part: DataFrame, numbers: list[int], combine: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        old = self._rows({b: f for b, f in self._version()[1].items() if b in numbers})
        same, hit = self._apart(old, part)
        held = shared_path(self.spark, "keyed-hit")
        hit.write.parquet(held)
        self._write(combine(self.spark.read.schema(self.schema).parquet(held), part), numbers, same)

    def _write(self, changed: DataFrame, numbers: list[int], same: DataFrame | None = None) -> None:
        """A version in which the buckets ``numbers`` hold ``changed``, and ``same`` as it is."""
        version, folders = self._version()
        changed = changed.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        folder = uuid.uuid4().hex
        after = (changed if same is None else same.unionByName(changed)).withColumn("bucket", self._bucket(self.key))
        after.write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        at, files = self._there(f"data/{folder}")
        now = {int(s.getPath().getName().split("=")[1]) for s in files.listStatus(at) if s.isDirectory()}
        lists = {b: f for b, f in folders.items() if b not in numbers} | dict.fromkeys(now, folder)
        self.spark.createDataFrame(sorted(lists.items()), BUCKETS).coalesce(1).write.parquet(f"{self.path}/versions/{version + 1}")

    def _apart(self, old: DataFrame, part: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(old rows that the part doesn't name, those that it names); the part's keys are sent to the rows."""
        keys = F.broadcast(part.select(self.key).distinct())  # at most BATCH rows
        return old.join(keys, self.key, "left_anti").select(*self.schema.names), old.join(keys, self.key, "left_semi").select(*self.schema.names)

    def vacuum(self) -> int:
        """Deletes what earlier versions held and the last one doesn't; the number of folders deleted. Readers of earlier versions have to be done."""
        version, folders = self._version()
        at, files = self._there("data")
        gone = [s.getPath() for s in files.listStatus(at) if s.getPath().getName() not in folders.values()] if files.exists(at) else []
        kept = {(f, b) for b, f in folders.items()}
        for s in files.listStatus(at) if files.exists(at) else []:
            for p in files.listStatus(s.getPath()) if s.getPath() not in gone else []:
                name = p.getPath().getName()
                if name.startswith("bucket=") and (s.getPath().getName(), int(name.split("=")[1])) not in kept:
                    gone.append(p.getPath())
        lists, _ = self._there("versions")
        gone += [s.getPath() for s in files.listStatus(lists) if int(s.getPath().getName()) < version]
        for p in gone:
            files.delete(p, True)
        return len(gone)


def _parts(counts: dict[int, int]) -> list[tuple[list[int], int]]:
    """Buckets that are changed together, ``BATCH`` rows at most, and in how many cuts a larger one alone."""
    out, held, size = [], [], 0
    for bucket, n in sorted(counts.items()):
        if n > BATCH:
            out.append(([bucket], -(-n // BATCH) + 1))  # a hash cuts unevenly
            continue
        if held and size + n > BATCH:
            out.append((held, 1))
            held, size = [], 0
        held, size = [*held, bucket], size + n
    return [*out, (held, 1)] if held else out
