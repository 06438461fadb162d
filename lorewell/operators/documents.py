"""Documents of knowledge bases as a table: uploads, parsing, clearing, and listings of them and their chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.operators import catalog
from lorewell.operators.lexical import matches
from lorewell.sources.keyed import KeyedTable

#: Run states of a document, and the limits of one upload.
PENDING, INDEXING, CANCELED = "pending", "indexing", 3
MOST_FILES, MOST_BYTES = 10, 100 * 1024 * 1024


def admitted(files: DataFrame, base: dict, by: str, now: Column, batch_col: str = "upload_id", name_col: str = "name", size_col: str = "size") -> tuple[DataFrame, DataFrame]:
    """(document rows of the files taken, files refused with a reason).

    Of an upload of more than ``MOST_FILES`` files or ``MOST_BYTES`` bytes nothing is taken; a file without a name or
    size is refused alone. ``base``: kb_id, tenant_id, parser_id, parser_config of the knowledge base.
    """
    totals = files.groupBy(batch_col).agg(F.count(F.lit(1)).alias("_files"), F.sum(F.coalesce(size_col, F.lit(0))).alias("_bytes"))
    nameless = F.coalesce(T.trim(F.col(name_col)), F.lit("")) == ""
    reason = F.when(F.col("_files") > MOST_FILES, "too many files").when(F.col("_bytes") > MOST_BYTES, "too large").when(nameless, "no name").when(F.coalesce(size_col, F.lit(-1)) < 0, "no size")
    judged = files.join(totals, batch_col).withColumn("reason", reason)
    taken = judged.where("reason is null")
    doc_id, kind = F.md5(F.concat_ws("/", F.col(batch_col).cast("string"), F.lit(str(base["kb_id"])), F.col(name_col))), F.substring(T.extension(F.col(name_col)), 2, 100)
    config = base.get("parser_config") or "{}"
    rows = taken.select(
        doc_id.alias("id"), F.lit(base["kb_id"]).alias("kb_id"), F.col(name_col).alias("doc_name"), F.when(kind == "", "unknown").otherwise(kind).alias("doc_type"), F.col(size_col).cast("long").alias("doc_size"),
        T.object_key(F.lit(str(base["tenant_id"])), F.lit(str(base["kb_id"])), doc_id, F.col(name_col)).alias("storage_path"), F.lit(1).alias("status"), F.lit(PENDING).alias("run_status"), F.lit(by).alias("created_by"),
        F.lit(base.get("parser_id")).cast("string").alias("parser_id"), F.lit(config).alias("parser_config"), F.lit("local").alias("source_type"), F.lit(0.0).alias("progress"), F.lit(0).cast("long").alias("token_num"), F.lit(0).cast("long").alias("chunk_num"),
        now.alias("created_time"), now.alias("updated_time"),
    )
    return rows, judged.where("reason is not null").select(*files.columns, "reason")


def within_base(rows: DataFrame, kb_id: object, ids: Sequence[object], id_col: str = "id", kb_col: str = "kb_id") -> DataFrame:
    """Rows of a base with one of ``ids``; the filter reaches the scan. No ids ask for nothing."""
    return rows.where((F.col(kb_col) == kb_id) & F.col(id_col).isin(list(ids)))


def to_parse(rows: DataFrame, kb_id: object, ids: Sequence[object], user: object, tenant: object) -> tuple[DataFrame, DataFrame]:
    """(rows with those of ``ids`` in the base pending again, a message for each of these)."""
    chosen = (F.col("kb_id") == kb_id) & F.col("id").isin(list(ids))
    now = catalog.updated(rows, F.coalesce(chosen, F.lit(False)), run_status=PENDING, status=1, progress=0.0)
    message = within_base(rows, kb_id, ids).select(
        F.lit(str(user)).alias("user_id"), F.lit(str(tenant)).alias("tenant_id"), F.col("kb_id").cast("string").alias("knowledge_base_id"), F.col("id").cast("string").alias("document_id"), F.lit(None).cast("string").alias("local_message_id")
    )
    return now, message


def mark_pending(table: KeyedTable, kb_id: object, ids: Sequence[object]) -> None:
    """Documents with one of ``ids`` in the base are pending again, in a keyed table: only the buckets of these ids are written."""
    chosen = within_base(table.find(*ids), kb_id, ids).select("id")
    table.merge(chosen, lambda old, _: catalog.updated(old, F.lit(True), run_status=PENDING, status=1, progress=0.0))


def to_index(messages: DataFrame, rows: DataFrame) -> DataFrame:
    """Documents that messages name and that are still pending; repeated messages name them once."""
    named = messages.select(F.col("document_id").alias("id")).distinct()
    return rows.where(F.col("run_status") == PENDING).join(named, "id", "left_semi")


def cleared(rows: DataFrame, chunks: DataFrame, kb_id: object) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, storage paths to remove) after a base is emptied; what is being indexed stays."""
    gone = F.coalesce((F.col("kb_id") == kb_id) & (F.col("run_status") != INDEXING), F.lit(False))
    ids = rows.where(gone).select(F.col("id").alias("doc_id"))
    paths = rows.where(gone & (F.col("source_type") == "local") & (F.coalesce("storage_path", F.lit("")) != "")).select("storage_path")
    return rows.where(~gone), deleted_chunks(chunks, kb_id, ids), paths


def deleted_chunks(chunks: DataFrame, kb_id: object, docs: DataFrame | None = None) -> DataFrame:
    """Chunks that a delete of a base, or of ``docs`` (doc_id) in it, leaves."""
    own = F.coalesce(F.col("kb_id") == kb_id, F.lit(False))
    if docs is None:
        return chunks.where(~own)
    return chunks.where(~own).unionByName(chunks.where(own).join(docs, "doc_id", "left_anti"))


def chunk_page(chunks: DataFrame, doc_id: object, word: str = "", number: int = 1, size: int = 10) -> DataFrame:
    """One page of a document's chunks in order, those that hold any token of ``word``."""
    df = chunks.where(F.col("doc_id") == doc_id).where(matches(F.col("content"), word))
    return catalog.page(df, F.asc("create_timestamp_flt"), F.asc("chunk_index"), F.asc("id"), number=number, size=size)


def listed(rows: DataFrame) -> DataFrame:
    """Documents in the shape that listings show: texts that are missing are empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return rows.select("id", "kb_id", text("doc_name"), text("doc_type"), "doc_size", text("storage_path"), "status", "run_status", "chunk_num", "token_num", text("parser_config"), "progress", "created_by", "created_time", "updated_time")
