"""Files as documents."""

from __future__ import annotations

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions import text as T


#: Schemes of addresses on the web; those of file systems with a host (hdfs, s3a and others) are paths.
WEB = ("http", "https", "ftp", "ftps", "ws", "wss")


def load_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, path, text: a row for each file below ``path``; web addresses are refused.

    Files are decoded by Spark; PDF and spreadsheets need a parser of their own: see ``load_binary``.
    """
    scheme, _, rest = path.partition("://")
    if rest and scheme.lower() in WEB:
        raise ValueError("an address on the web is no file path")
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return df.select(F.md5("path").alias("doc_id"), "path", "text")


def ensure_folder(spark: SparkSession, path: str) -> None:
    """Creates a folder (a bucket's prefix) unless it is there."""
    at, files = _there(spark, path)
    files.mkdirs(at)


def put_object(spark: SparkSession, local: str, path: str) -> None:
    """Copies a file of the driver to any file system Spark can write; what was there is replaced."""
    at, files = _there(spark, path)
    files.copyFromLocalFile(False, True, spark._jvm.org.apache.hadoop.fs.Path(f"file://{local}"), at)


def get_object(spark: SparkSession, path: str, local: str) -> None:
    """Copies a file to the driver."""
    at, files = _there(spark, path)
    files.copyToLocalFile(False, at, spark._jvm.org.apache.hadoop.fs.Path(f"file://{local}"), True)


def remove_object(spark: SparkSession, path: str) -> bool:
    """Whether there was a file to remove."""
    at, files = _there(spark, path)
    return bool(files.delete(at, False))


def _there(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def load_binary(spark: SparkSession, path: str, parse) -> DataFrame:
    """doc_id, path, text, where ``parse`` (a pandas UDF over content and path) reads PDF or spreadsheets; others as UTF-8."""
    df = spark.read.format("binaryFile").load(path)
    special = T.extension(F.col("path")).isin(".pdf", ".xlsx", ".xls")
    text = F.when(special, parse(F.col("content"), F.col("path"))).otherwise(F.decode("content", "UTF-8"))
    return df.select(F.md5("path").alias("doc_id"), "path", text.alias("text"))
