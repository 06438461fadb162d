"""Tables written once and read again, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a temporary one in a local session (tests), an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.lorewell.scratch", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='lorewell-')}"
        spark.conf.set("spark.lorewell.scratch", folder)
    return folder.rstrip("/")


class Scratch:
    """Names tables of one job below the shared folder and removes those that are no longer needed.

    A written table cuts the lineage: when executors are lost, later stages read it again
    instead of computing it again. What is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, job: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{job}-{uuid.uuid4().hex}"
        at, files = self._there(self.root)
        files.deleteOnExit(at)

    def _there(self, path: str) -> tuple[JavaObject, JavaObject]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` as Parquet and returns the table that was written."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables whose rows nothing will read again."""
        for name in names:
            at, files = self._there(self.path(name))
            files.delete(at, True)
