"""Entities and relations: parsed from extraction records, merged, stored and viewed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.sources.scratch import kept

#: Fixed values of the record format.
RECORD, FIELD, DONE = "##", "<|>", "<|DONE|>"
#: halvings after which the largest double is 0 beside any weight that counts
HALVINGS = 2200


def records(chunks: DataFrame, id_col: str = "chunk_id", answer_col: str = "answer", order_col: str = "chunk_index") -> DataFrame:
    """chunk_index, source_id, record_index, fields: the well-framed records of an answer."""
    cut = F.split(F.coalesce(F.col(answer_col), F.lit("")), RECORD)
    df = chunks.select(F.col(order_col).alias("chunk_index"), F.col(id_col).alias("source_id"), F.posexplode(cut).alias("record_index", "r"))
    bare = F.regexp_replace(F.regexp_replace(T.trim(F.col("r")), r"^\(", ""), r"\)$", "")
    fields = F.transform(F.split(bare, r"<\|>"), lambda x: F.regexp_replace(x, '^"+|"+$', ""))
    return df.where(T.trim(F.col("r")) != "").select("chunk_index", "source_id", "record_index", fields.alias("fields")).where(F.size("fields") >= 2)


def _field(i: int) -> Column:
    return F.get("fields", i)


def entities(parsed: DataFrame) -> DataFrame:
    """chunk_index, record_index, source_id, name, type, description."""
    df = parsed.where((_field(0) == "entity") & (F.size("fields") >= 4))
    return df.select("chunk_index", "record_index", "source_id", _field(1).alias("name"), _field(2).alias("type"), _field(3).alias("description"))


def relations(parsed: DataFrame) -> DataFrame:
    """chunk_index, record_index, source_id, src_id, dst_id, type, description, weight (0 unless a number)."""
    df = parsed.where((_field(0) == "relationship") & (F.size("fields") >= 6))
    number = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
    weight = F.when(_field(5).rlike(number), _field(5).try_cast("double"))
    return df.select(
        "chunk_index", "record_index", "source_id", _field(1).alias("src_id"), _field(2).alias("dst_id"), _field(3).alias("type"), _field(4).alias("description"), F.coalesce(weight, F.lit(0.0)).alias("weight")
    )


def _sources(at: Column) -> Column:
    """Distinct sources in the order they were first seen; each source is kept once per group before the shuffle ends."""
    return F.array_distinct(F.transform(F.sort_array(F.collect_set(F.struct(at.alias("at"), F.col("source_id")))), lambda x: x["source_id"]))


def merged_entities(found: DataFrame) -> DataFrame:
    """One row per name: the first type, the first of the longest descriptions, all sources."""
    at = F.struct("chunk_index", "record_index")
    longest = F.struct(F.octet_length("description").alias("n"), (-F.col("chunk_index")).alias("c"), (-F.col("record_index")).alias("r"))
    df = found.groupBy("name").agg(F.min_by("type", at).alias("type"), F.max_by("description", longest).alias("description"), _sources(at).alias("source_id"))
    return df


def merged_relations(found: DataFrame) -> DataFrame:
    """One row per (src_id, dst_id): the first type, weights folded as (so far + next) / 2, descriptions appended.

    The fold goes by (chunk_index, record_index). The n-th weight from the end counts 2^-n in it (the first
    one twice that), so it is a weighted sum. Tasks keep the last ``HALVINGS`` weights of a relation before the shuffle; those
    before are halved to nothing that a double can hold. Only distinct descriptions and sources are gathered. Empty descriptions add nothing.
    ``found`` is written first: its answers are parsed once, not once for descriptions, sources and weights each.
    """
    found = kept(found, "relations")
    at = F.struct("chunk_index", "record_index")
    told = found.where("description <> ''")
    first_text = told.groupBy("src_id", "dst_id", "description").agg(F.min(at).alias("at"))
    texts = first_text.groupBy("src_id", "dst_id").agg(F.sort_array(F.collect_list(F.struct("at", "description"))).alias("d"))
    append = lambda acc, x: F.when(F.contains(acc, x["description"]), acc).otherwise(F.concat(acc, F.lit("\n"), x["description"]))
    texts = texts.select("src_id", "dst_id", F.aggregate(F.slice("d", 2, F.greatest(F.size("d") - 1, F.lit(0))), F.get("d", 0)["description"], append).alias("description"))
    one = found.select("src_id", "dst_id", "type", "source_id", at.alias("at"), "weight")
    whole = one.groupBy("src_id", "dst_id").agg(F.min_by("type", "at").alias("type"), _sources(F.col("at")).alias("source_id"), F.count(F.lit(1)).alias("n"))
    last = one.withColumn("n", F.row_number().over(Window.partitionBy("src_id", "dst_id").orderBy(F.desc("at")))).where(F.col("n") <= HALVINGS)
    share = F.pow(F.lit(0.5), F.col("n"))
    folded = last.groupBy("src_id", "dst_id").agg(F.sum(F.col("weight") * share).alias("weight"), F.max_by(F.col("weight") * share, "n").alias("first"), F.max("n").alias("held"))
    both = whole.join(folded, ["src_id", "dst_id"]).join(texts, ["src_id", "dst_id"], "left")
    weight = F.col("weight") + F.when(F.col("held") == F.col("n"), F.col("first")).otherwise(0.0)
    return both.select("src_id", "dst_id", "type", F.coalesce("description", F.lit("")).alias("description"), weight.alias("weight"), "source_id")


def gleaned(chunks: DataFrame, extract: Callable[[Column, Column], Column], content_col: str = "content", rounds: int = 3) -> DataFrame:
    """``chunks`` with ``answer``: up to ``rounds`` answers of ``extract(content, so far)``, ended by the done mark."""
    df = chunks.withColumns({"answer": F.lit(""), "_done": F.lit(False)})
    for _ in range(rounds):
        more = F.when(~F.col("_done"), extract(F.col(content_col), F.col("answer")))
        df = df.withColumn("_more", F.coalesce(more, F.lit("")))
        text = F.replace("_more", F.lit(DONE), F.lit(""))
        answer = F.when(text == "", F.col("answer")).when(F.col("answer") == "", text).otherwise(F.concat("answer", F.lit(RECORD), text))
        df = df.withColumns({"answer": answer, "_done": F.col("_done") | F.contains("_more", F.lit(DONE))})
    return df.drop("_done", "_more")


def upsert_docs(old: DataFrame, new: DataFrame, order: str = "updated_at") -> DataFrame:
    """Graph documents by id: sources united, descriptions appended unless held already, ``updated_at`` replaced.

    Weights of relations are averaged; an entity (``graph_type``, where there is one) keeps its own. Rows
    of ``new`` that share an id are applied one after another by ``order`` (where there is one) and content;
    the first of an unknown id is stored as it is.
    """
    fields = sorted((c for c in new.columns if c != "id"), key=lambda c: c != order)
    kind = dict(new.dtypes)  # without what a column says of nulls
    batch = new.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(*[F.col(c).cast(kind[c]).alias(c) for c in fields]))).alias("rows"))
    start = F.when(F.col("_old"), F.struct(*[F.col(f"o.{c}").cast(kind[c]).alias(c) for c in fields])).otherwise(F.get("rows", 0))
    rest = F.when(F.col("_old"), F.col("rows")).otherwise(F.slice("rows", F.lit(2), F.size("rows")))
    nothing = F.array().cast("array<string>")

    def merged(acc: Column, x: Column) -> Column:
        mean = F.coalesce((acc["weight"] + x["weight"]) / 2, acc["weight"], x["weight"])
        said = F.when(x["description"].isNull() | F.contains(acc["description"], x["description"]), acc["description"])
        values = {
            "source_ids": F.array_union(F.coalesce(acc["source_ids"], nothing), F.coalesce(x["source_ids"], nothing)),
            "weight": F.when(x["graph_type"] == "entity", acc["weight"]).otherwise(mean) if "graph_type" in fields else mean,
            "description": said.otherwise(F.concat(F.coalesce(acc["description"], F.lit("")), F.when(acc["description"] != "", "\n").otherwise(""), x["description"])),
        }
        return F.struct(*[values.get(c, F.coalesce(x[c], acc[c])).cast(kind[c]).alias(c) for c in fields])

    both = old.withColumn("_old", F.lit(True)).alias("o").join(batch, "id", "full_outer").withColumn("_old", F.coalesce("_old", F.lit(False)))
    now = both.withColumn("_now", F.when(F.col("rows").isNull(), start).otherwise(F.aggregate(rest, start, merged)))
    return now.select(*[F.col("id") if c == "id" else F.col(f"_now.{c}") if c in fields else F.col(f"o.{c}") for c in old.columns])


def keep_last(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key, of ties the one of largest content; combined before the shuffle."""
    rest = [order, *[c for c in rows.columns if c not in keys and c != order]]
    last = rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_last"))
    return last.select(*keys, "_last.*").select(*rows.columns)


def graph_view(nodes: DataFrame, edges: DataFrame, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """(nodes with their degree as ``val``, edges): first edges in order, both of whose ends exist, then their ends.

    Of nodes that share a name the last one, by all its columns, is shown.
    """
    names = nodes.select("name").distinct()
    held = edges.join(names.withColumnRenamed("name", "src_id"), "src_id", "left_semi").join(names.withColumnRenamed("name", "dst_id"), "dst_id", "left_semi")
    held = held.select(*edges.columns).orderBy("src_id", "dst_id").limit(limit)
    degree = degrees(held)
    shown = keep_last(nodes, ["name"], next((c for c in nodes.columns if c != "name"), "name")) if len(nodes.columns) > 1 else names
    ends = shown.join(degree.withColumnRenamed("degree", "val"), "name")
    return ends, held


def size(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes, edges: how many there are."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    return n.crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))  # a row each


def with_name_vectors(found: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """Entities with the vector of their name; ``embed`` gives null where it fails, and the entity stays without one."""
    return found.withColumn("embedding", embed(F.col("name")))


def degrees(edges: DataFrame) -> DataFrame:
    """name, degree: in and out."""
    return edges.select(F.explode(F.array("src_id", "dst_id")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("degree"))


def neighbours(edges: DataFrame, name: str) -> DataFrame:
    """Names one step away, in either direction."""
    out = edges.where(F.col("src_id") == name).select(F.col("dst_id").alias("name"))
    return out.unionByName(edges.where(F.col("dst_id") == name).select(F.col("src_id").alias("name"))).where(F.col("name") != name).distinct()


def search_nodes(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Names that contain ``query``, case-sensitive; shown with ``val`` 5 and no links."""
    return nodes.where(F.contains("name", F.lit(query))).orderBy("name").limit(limit).withColumn("val", F.lit(5))


def reachable(edges: DataFrame, start: str, hops: int) -> DataFrame:
    """name, hops: names within ``hops`` steps of ``start``; a frontier is joined per step, never all pairs."""
    ways = edges.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"))
    ways = ways.unionByName(ways.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    seen = edges.sparkSession.range(1).select(F.lit(start).alias("name"), F.lit(0).alias("hops"))
    for step in range(1, hops + 1):
        front = seen.where(F.col("hops") == step - 1).select(F.col("name").alias("a"))
        more = ways.join(front, "a", "left_semi").select(F.col("b").alias("name")).distinct().withColumn("hops", F.lit(step))
        seen = seen.unionByName(more).groupBy("name").agg(F.min("hops").alias("hops"))
    return seen


def search_docs(kb: Column, found: DataFrame) -> DataFrame:
    """Graph documents of merged entities."""
    return found.select(
        T.entity_id(kb, F.col("name")).alias("id"), kb.alias("kb_id"), F.lit("entity").alias("graph_type"), F.col("name").alias("entity_name"), "description", F.col("source_id").alias("source_ids"), F.concat_ws(": ", "name", "description").alias("content_with_weight")
    )
