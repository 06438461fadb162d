"""Indexes and graphs as partitioned Parquet tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lorewell.operators.graph import keep_last, upsert_docs
from lorewell.sources.keyed import KeyedTable
from lorewell.sources.scratch import shared_path


def ensure_table(spark: SparkSession, name: str, schema: str, partitions: Sequence[str] = ()) -> None:
    """Creates an empty Parquet table unless it is there."""
    by = f" PARTITIONED BY ({', '.join(partitions)})" if partitions else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet{by}")


def put_chunks(chunks: DataFrame, path: str, key: str = "id", order: str = "create_timestamp_flt", partition: str = "kb_id") -> None:
    """Puts the last row of each key in place of the stored row of that key; all other rows stay.

    Partitions that ``chunks`` touches are merged into a table of their own first, and then replaced.
    """
    spark, rows = chunks.sparkSession, keep_last(chunks, [partition, key], order)
    if _exists(spark, path):
        found = spark.read.parquet(path).schema
        kind = rows.schema[partition].dataType  # a folder name alone would be read as a number
        old = spark.read.schema(StructType([StructField(f.name, kind if f.name == partition else f.dataType) for f in found])).parquet(path)
        touched = rows.select(F.col(partition).alias("_touched")).distinct()
        old = old.join(touched, F.col(partition).eqNullSafe(F.col("_touched")), "left_semi")
        merged = shared_path(spark, "merged-chunks")
        merge_chunks(old, rows, [partition, key]).write.parquet(merged)
        _replace(spark.read.parquet(merged), path, partition)
        _folder(spark, merged).delete(spark._jvm.org.apache.hadoop.fs.Path(merged), True)
    else:
        _replace(rows, path, partition)


def _replace(rows: DataFrame, path: str, partition: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def _folder(spark: SparkSession, path: str) -> JavaObject:
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` holds a partition."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = _folder(spark, path)
    return files.exists(at) and any(s.isDirectory() and "=" in s.getPath().getName() for s in files.listStatus(at))


def merge_chunks(old: DataFrame, new: DataFrame, key: str | Sequence[str] = "id") -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal keys."""
    keys = [key] if isinstance(key, str) else list(key)
    gone = new.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return old.join(gone, same, "left_anti").unionByName(new, allowMissingColumns=True)


def put_graph_docs(table: KeyedTable, new: DataFrame) -> None:
    """Merges documents into a keyed table of them; only documents of the batch's ids are read into the merge."""
    table.merge(new, upsert_docs)


def single_precision(vectors: DataFrame, column: str) -> DataFrame:
    return vectors.withColumn(column, F.transform(column, lambda x: x.cast("float")))


def audited(rows: DataFrame, now: Column, new: bool = True) -> DataFrame:
    """With the times of creation (new rows) and change."""
    return rows.withColumns({**({"created_time": now} if new else {}), "updated_time": now})


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def without(rows: DataFrame, gone: Column) -> DataFrame:
    """Rows that a delete leaves; unknown ones stay."""
    return rows.where(~F.coalesce(gone, F.lit(False)))


def point(rows: DataFrame, **key: object) -> DataFrame:
    """The row of a key; the filter reaches the scan."""
    for name, value in key.items():
        rows = rows.where(F.col(name) == value)
    return rows.limit(1)
