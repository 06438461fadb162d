"""Metadata queries: visibility, paging, lookups, counters and state changes over plain tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions import text as T


def where_given(df: DataFrame, **wanted: object) -> DataFrame:
    """Equality on every column whose value is given; None and empty strings ask for nothing."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), [kv for kv in wanted.items() if kv[1] not in (None, "")], df)


def keyword(df: DataFrame, word: str, name_col: str, id_col: str) -> DataFrame:
    """Names like ``%word%`` (its wildcards count) or an equal id."""
    return df.where(F.col(name_col).like(f"%{word}%") | (F.col(id_col).cast("string") == word)) if word else df


def name_contains(df: DataFrame, word: str, name_col: str) -> DataFrame:
    """Names that hold ``word`` in any case; everything for an empty one."""
    return df.where(F.contains(F.lower(name_col), F.lit(word.lower()))) if word else df


def among(df: DataFrame, col: str, values: Sequence[object], **given: object) -> DataFrame:
    """Rows whose ``col`` is one of ``values``, with equality on what else is given; no values ask for nothing."""
    return where_given(df.where(F.col(col).isin(list(values))), **given)


def alive(df: DataFrame, gone: object, status_col: str = "status", **given: object) -> DataFrame:
    """Rows that aren't deleted: any status but ``gone``, a missing one too."""
    return where_given(df.where(~F.col(status_col).eqNullSafe(F.lit(gone))), **given)


def own(id_value: object, tenant: object, id_col: str = "id", tenant_col: str = "tenant_id") -> Column:
    """Condition of a row by id and tenant, for selects, updates and deletes that another tenant's id can't reach."""
    return F.coalesce((F.col(id_col) == id_value) & (F.col(tenant_col) == tenant), F.lit(False))


def counted(df: DataFrame, **wanted: object) -> DataFrame:
    """total: the rows that ``where_given`` leaves."""
    return where_given(df, **wanted).agg(F.count(F.lit(1)).alias("total"))


def counters(chunks: DataFrame, by: str, doc_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """doc_num, chunk_num, token_num by base."""
    return chunks.groupBy(by).agg(F.count_distinct(doc_col).alias("doc_num"), F.count(F.lit(1)).alias("chunk_num"), F.sum(T.token_estimate(F.col(content_col))).alias("token_num"))


def models_by_factory(models: DataFrame, factories: DataFrame, group: str = "model_type", *listed: str) -> DataFrame:
    """A row per factory: its logo ('' if unknown), its models in order, keys masked, and the host of the first address."""
    logos = factories.groupBy("llm_factory").agg(F.max("logo").alias("logo"))
    rows = models.withColumn("api_key", T.masked(F.coalesce("api_key", F.lit("")))).withColumn("_base", F.nullif("api_base", F.lit("")))
    out = grouped(rows, "llm_factory", "_base", "llm_name", group, "api_key", *listed)
    out = out.join(logos, "llm_factory", "left")
    return out.select("llm_factory", F.coalesce("logo", F.lit("")).alias("logo"), T.host(F.coalesce("_base", F.lit(""))).alias("api_base"), F.col("items").alias("models"))


def page(df: DataFrame, *order: Column, number: int = 1, size: int = 10) -> DataFrame:
    """Rows of one page; a top-k, never a full sort of the table."""
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def visible(bases: DataFrame, members: DataFrame, user: str | int) -> DataFrame:
    """Active knowledge bases a user sees: own ones and those their tenants share. Without a tenant: none."""
    own = members.where((F.col("user_id") == user) & (F.col("status") == 1)).select("tenant_id").distinct()
    some = own.limit(1).select(F.lit(True).alias("member"))  # one row or none
    shared = own.withColumn("_in", F.lit(True))
    df = bases.where(F.col("status") == 1).join(shared, "tenant_id", "left").join(F.broadcast(some))
    return df.where((F.col("created_by") == user) | (F.col("_in") & (F.col("permission") == "team"))).select(*bases.columns)


def may_list(documents: DataFrame, bases: DataFrame, members: DataFrame, user: str | int) -> DataFrame:
    """Documents of bases whose tenant the user belongs to, personal bases by their creator only."""
    own = members.where((F.col("user_id") == user) & (F.col("status") == 1)).select("tenant_id").distinct()
    open_ = bases.join(own, "tenant_id", "left_semi").where((F.col("permission") != "me") | (F.col("created_by") == user))
    return documents.join(open_.select("kb_id"), "kb_id", "left_semi")


def with_name(rows: DataFrame, names: DataFrame, key: str, name_key: str, name_col: str, out: str = "name") -> DataFrame:
    """Left join of a name, '' where there is none."""
    found = names.select(F.col(name_key).alias("_k"), F.col(name_col).alias("_n"))
    return rows.join(found, F.col(key) == F.col("_k"), "left").withColumn(out, F.coalesce("_n", F.lit(""))).drop("_k", "_n")


def owners(members: DataFrame, users: DataFrame) -> DataFrame:
    """tenant_id, user_id, name: the owner of least id of each tenant."""
    held = members.where((F.col("role") == "owner") & (F.col("status") == 1)).groupBy("tenant_id").agg(F.min("user_id").alias("user_id"))
    return with_name(held, users, "user_id", "user_id", "name")


def models_of(bases: DataFrame, models: DataFrame, model_col: str = "embedding") -> DataFrame:
    """Bases with the tenant's model that ``name@factory`` names; those without one are left out."""
    key = bases.withColumns({"llm_name": T.model_name(F.col(model_col)), "llm_factory": T.model_factory(F.col(model_col))})
    return key.join(models, ["tenant_id", "llm_factory", "llm_name"])


def grouped(rows: DataFrame, by: str, first: str, *listed: str) -> DataFrame:
    """``by``, ``items`` (ordered structs) and the first non-null ``first`` in that order."""
    item = F.struct(*listed)
    return rows.groupBy(by).agg(F.sort_array(F.collect_list(item)).alias("items"), F.min_by(first, F.when(F.col(first).isNotNull(), item)).alias(first))


def latest(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The ``n`` last rows of each ``by``; rows that tie in ``order`` go by their other columns."""
    w = Window.partitionBy(by).orderBy(F.desc(order), *[F.asc(c) for c in rows.columns if c not in (by, order)])
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def numbered(messages: DataFrame, by: str, *order: str) -> DataFrame:
    """Messages with their running number in the conversation."""
    return messages.withColumn("seq_id", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def in_parts(rows: DataFrame, parts: int, *order: str, by: str) -> DataFrame:
    """Rows of each ``by`` in ``parts`` near-equal runs, longer ones first."""
    return rows.withColumn("part", F.ntile(parts).over(Window.partitionBy(by).orderBy(*order)))


def in_batches(rows: DataFrame, size: int, *order: str, by: str) -> DataFrame:
    """Rows of each ``by`` in batches of ``size``; the last one may be shorter."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    return rows.withColumn("batch", F.floor(n / size).cast("int"))


def histogram(rows: DataFrame, value: str, bounds: Sequence[float], *labels: str) -> DataFrame:
    """count, sum and cumulative buckets (le_0, le_1, ...) for each set of labels."""
    buckets = [F.count_if(F.col(value) <= b).alias(f"le_{i}") for i, b in enumerate(bounds)]
    return rows.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), *buckets)


def number_of(meta: str, key: str, kind: str = "double") -> Column:
    """A number in a map of strings; 0 if it is none."""
    return F.coalesce(F.col(meta)[key].try_cast(kind), F.lit(0).cast(kind))


# state changes: each returns the table as it is afterwards


def updated(rows: DataFrame, changed: Column, **values: object) -> DataFrame:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return rows.withColumns({c: F.when(changed, as_column(v)).otherwise(F.col(c)) for c, v in values.items()})


def patched(rows: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Non-empty fields of a patch replace the row's."""
    p = patches.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in patches.columns if c != key])
    new = lambda c: F.nullif(F.col(f"_{c}"), F.lit("").cast(dict(rows.dtypes)[c])) if dict(rows.dtypes)[c] == "string" else F.col(f"_{c}")
    return rows.join(p, key, "left").select(*[F.coalesce(new(c), F.col(c)).alias(c) if c != key and c in patches.columns else F.col(c) for c in rows.columns])


def default_of(rows: DataFrame, group: Column, chosen: Column) -> DataFrame:
    """Within ``group`` only the chosen row is the default."""
    return rows.withColumn("is_default", F.when(group, chosen.cast("int")).otherwise(F.col("is_default")))


def compare_and_set(rows: DataFrame, chosen: Column, column: str, expected: object, value: object) -> tuple[DataFrame, DataFrame]:
    """(rows afterwards, rows that were in another state: conflicts)."""
    now = chosen & (F.col(column) == expected)
    return updated(rows, now, **{column: value}), rows.where(chosen & ~F.coalesce(F.col(column) == expected, F.lit(False)))


def insert_ignore(rows: DataFrame, new: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that are new by ``keys``, those that were there or repeat one)."""
    w = Window.partitionBy(*keys).orderBy(F.xxhash64(*[c for c in new.columns]))
    tried = new.withColumn("_n", F.row_number().over(w))
    there = rows.select(*keys).distinct().withColumn("_there", F.lit(True))
    tried = tried.join(there, list(keys), "left").withColumn("_new", (F.col("_n") == 1) & F.col("_there").isNull())
    return tried.where("_new").select(*new.columns), tried.where("not _new").select(*new.columns)


def cascade_delete(base: str, bases: DataFrame, documents: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without a knowledge base."""
    gone = lambda df: df.where(~F.coalesce(F.col("kb_id") == base, F.lit(False)))
    return gone(bases), gone(documents), gone(chunks)


# retries


def retryable(tasks: DataFrame, now: Column, limit: int = 100) -> DataFrame:
    """Tasks due: failed with tries left and their time come, or started more than five minutes ago."""
    due = (F.col("status") == "fail") & (F.col("next_retry_time") <= now) & (F.col("retry_times") < F.col("max_retry_times"))
    stuck = (F.col("status") == "init") & (F.col("created_time") < now - F.expr("interval 5 minutes"))
    return tasks.where(due | stuck).orderBy("next_retry_time", "id").limit(limit)


def republished(tasks: DataFrame, now: Column, known: Sequence[str], kind_col: str = "task_type", limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """(tasks afterwards, messages): due tasks of a known kind go out again with their id, and are marked as retrying.

    What is due is at most ``limit`` rows, so it is broadcast.
    """
    due = retryable(tasks, now, limit).where(F.col(kind_col).isin(list(known)) & F.get_json_object("payload", "$").isNotNull())
    message = F.map_concat(F.from_json("payload", "map<string,string>"), F.create_map(F.lit("local_message_id"), F.col("id").cast("string")))
    out = due.select("id", F.col(kind_col).alias("topic"), F.to_json(message).alias("value"))
    marks = due.select("id", F.lit(True).alias("_out"))
    after = tasks.join(F.broadcast(marks), "id", "left")
    return updated(after, F.col("_out").isNotNull(), status="retrying").select(*tasks.columns), out


def failed(tasks: DataFrame, ids: Column, now: Column) -> DataFrame:
    """Tasks with another failure: the next try is 30 s away, then 60 s, 120 s ..."""
    wait = T.backoff_seconds(F.col("retry_times"))
    later = F.timestamp_seconds(F.unix_seconds(now) + wait)
    return updated(tasks, ids, next_retry_time=later, status="fail", retry_times=F.col("retry_times") + 1)
