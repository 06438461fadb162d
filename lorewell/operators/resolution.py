"""Entities that are the same under several names: similar names found without comparing all, one name kept, relations merged.

Names are brought into a normal form; those of one form are one class. Two forms are alike
when their sets of character n-grams have a Jaccard similarity of ``percent`` or more. Grams are ordered from the rarest
to the most frequent, and alike sets must share a gram among their first few (the prefix filter), so forms
meet only through rare grams. Of a gram's forms every one is first compared with the least of them: in a
crowd of alike names that links nearly all, and afterwards only forms of different groups are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions import text as T
from lorewell.operators import graph
from lorewell.sources.scratch import shared_path


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def normal(name: Column) -> Column:
    """Lower case, with single spaces for whatever is neither letter nor digit."""
    return T.trim(F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]+", " ")))


def grams(text: Column, n: int) -> Column:
    """Distinct n-grams of a text between two spaces, so that a short one has some as well."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(padded) - (n - 1), F.lit(1))), lambda i: F.substring(padded, i, F.lit(n))))


def groups(links: DataFrame) -> DataFrame:
    """node, label: the least node reachable over ``links`` (a, b).

    Every node takes the least label around it, then its label's label, until none changes. Least labels are taken before the shuffle.
    """
    both = _kept(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = _kept(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).withColumn("label", F.least("node", "label")), "labels")
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        near = labels.join(around, labels["node"] == around["a"]).select("node", F.least("label", "near").alias("near"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        now = _kept(near.join(jump, "near").select("node", F.least("near", "far").alias("label"), "was"), "labels")
        labels = now.select("node", "label")
        if now.where("label <> was").isEmpty():
            return labels


def _needed(size: Column, percent: int) -> Column:
    """Grams that a set of ``size`` shares at least with any that is alike."""
    return F.ceil(size * percent / 100)


def _prefixes(forms: DataFrame, n: int, percent: int) -> DataFrame:
    """gram, form, size, place, all: the first grams of every form, from the rarest on."""
    each = forms.select("form", F.explode(grams(F.col("form"), n)).alias("gram"))
    often = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    own = each.join(often, "gram").groupBy("form").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("g"))  # as many as a name is long
    own = own.select("form", F.transform("g", lambda x: x["gram"]).alias("all"), F.size("g").alias("size"))
    first = F.slice("all", F.lit(1), (F.col("size") - _needed(F.col("size"), percent) + 1).cast("int"))
    return own.select("form", "size", "all", F.posexplode(first).alias("place", "gram"))


def alike(forms: DataFrame, n: int = 3, percent: int = 80) -> DataFrame:
    """a, b: links between forms that are alike; enough of them that linked forms are those of all such pairs."""
    rows = _kept(_prefixes(forms, n, percent), "prefixes")
    side = lambda df, s: df.select("gram", *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c != "gram"])

    def verified(pairs: DataFrame) -> DataFrame:
        total, shared = F.col("size_a") + F.col("size_b"), F.size(F.array_intersect("all_a", "all_b"))
        least = F.ceil(total * percent / (100 + percent))
        rest = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))  # what both still hold from the shared gram on
        may = (100 * F.col("size_a") >= percent * F.col("size_b")) & (100 * F.col("size_b") >= percent * F.col("size_a")) & (rest + F.least("place_a", "place_b") >= least)
        return pairs.where(may).where(100 * shared >= percent * (total - shared)).select(F.col("form_a").alias("a"), F.col("form_b").alias("b")).distinct()

    hubs = rows.groupBy("gram").agg(F.min(F.struct("form", "size", "all", "place")).alias("h")).select("gram", "h.*")
    first = _kept(verified(side(hubs, "a").join(side(rows, "b"), "gram").where("form_a < form_b")), "alike")
    labels = groups(first)
    named = rows.join(labels, rows["form"] == labels["node"], "left").select(*rows.columns, F.coalesce("label", "form").alias("label"))
    pairs = side(named, "a").join(side(named, "b"), "gram").where("form_a < form_b and label_a <> label_b")
    return first.unionByName(verified(pairs))


def resolved(names: DataFrame, name_col: str = "name", n: int = 3, percent: int = 80) -> DataFrame:
    """name, canonical: for every distinct name the most frequent name of its group, of equals the least.

    A row is a mention. Names without a letter or digit are left as they are; null ones are left out.
    """
    said = names.select(F.col(name_col).alias("name")).where("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    said = _kept(said.withColumn("form", normal(F.col("name"))), "names")
    links = alike(said.where("form <> ''").select("form").distinct(), n, percent)
    labels = groups(links)
    group = F.when(F.col("form") == "", F.concat(F.lit("\x00"), "name")).otherwise(F.coalesce("label", "form"))
    every = said.join(labels, said["form"] == labels["node"], "left").withColumn("of", group)
    best = every.groupBy("of").agg(F.min(F.struct((-F.col("n")).alias("n"), "name")).alias("best"))
    return every.join(best, "of").select("name", F.col("best.name").alias("canonical"))


def _renamed(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
    new = names.select(F.col("name").alias(column), F.col("canonical").alias("_new"))
    return rows.join(new, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def resolved_entities(found: DataFrame, names: DataFrame) -> DataFrame:
    """Entities merged under their canonical names."""
    return graph.merged_entities(_renamed(found, names, "name"))


def resolved_relations(found: DataFrame, names: DataFrame) -> DataFrame:
    """Relations whose ends bear canonical names, merged where both ends are the same; those that only then link a name with itself go."""
    both = _renamed(_renamed(found.withColumn("_loop", F.col("src_id") == F.col("dst_id")), names, "src_id"), names, "dst_id")
    return graph.merged_relations(both.where("_loop or src_id <> dst_id").drop("_loop"))
