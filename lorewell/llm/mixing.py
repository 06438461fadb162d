"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every document of a source starts with the same expected number of copies, its source's target
over its source's size. The whole part is certain; the fractional part is a copy probability.
Probabilities are turned into whole copies by pivoting: two units exchange expected words, in a
random direction whose odds keep every expectation, until one of them is integral. Words given
are words taken, so a source's total never moves.

The tree: leaves of about ``fanout`` documents pivot each document, largest first, against the
pooled rest of its leaf, which leaves at most one fractional document, usually the smallest.
Those residuals go up a level, are dealt to leaves again and pivoted in pairs, until one leaf a
source is left; its last residual is drawn with its own probability. A source of any size is
dealt over as many leaves as it needs, so a hot source is no hot group.

Randomness is a hash of ids, level and seed: reruns agree.

Rows equal in id, source and text, however many, are one unit: of m of them m times the
probability, rounded down, get a copy for certain, and only what is left over is drawn for one more.

Defined results: documents without words (null or blank text) have size 0, one copy and take 0 words; the
null source is a source of its own, last in order; repeated rows are separate documents that may
get different copies; rows without an id are told apart by their texts; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.llm.scratch import Scratch

EPS = 1e-9
ROW = "array<struct<size:bigint,salt:bigint,doc_id:{id},whole:bigint,p:double>>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _ranked(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds rank: the number of sources before it by code point, null last. Parts of a range are counted, then each is numbered."""
    order = F.col("source").asc_nulls_last()
    parts = scratch.keep(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("k")).withColumn("first", F.coalesce(F.sum("k").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return parts.withColumn("i", within).join(counts.select("part", "first"), "part").withColumn("rank", F.col("first") + F.col("i")).drop("part", "i", "first")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """Columns source, docs, source_size, target: one row per source of ``sizes`` (source, docs, size).

    Weights repeat over the sources in code-point order, null last. Targets share ``share`` of all
    words by weight, up to ``limit`` times the source's words; what is over goes to the others by
    weight. Round after round, sources above their limit at the level so far are fixed, until none is.
    """
    scratch = Scratch(sizes.sparkSession, "targets")
    totals = scratch.keep(sizes.groupBy("source").agg(F.sum("docs").alias("docs"), F.sum("size").alias("source_size")), "totals")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    df = scratch.keep(_ranked(totals, scratch).withColumns({"w": w, "most": F.col("source_size") * F.lit(float(limit))}), "weighed")
    words = (df.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    level, fixed = 0.0, -1
    while True:
        full = F.col("most") < F.lit(level) * F.col("w")
        now = df.agg(F.count(F.when(full, 1)).alias("n"), F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("spent"), F.sum(F.when(~full, F.col("w"))).alias("open")).first()
        if now["n"] == fixed or not now["open"]:
            break
        fixed, level = now["n"], (words - (now["spent"] or 0.0)) / now["open"]
    return df.select("source", "docs", "source_size", F.least(F.col("most"), F.lit(level) * F.col("w")).alias("target"))


def _uniform(*of: Column) -> Column:
    """In [0, 1), from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11) * F.lit(2.0**-53)


def _snap(p: Column) -> Column:
    return F.when(p < EPS, 0.0).when(p > 1 - EPS, 1.0).otherwise(p)


def _with_p(x: Column, p: Column) -> Column:
    return F.struct(x["size"].alias("size"), x["salt"].alias("salt"), x["doc_id"].alias("doc_id"), x["whole"].alias("whole"), p.alias("p"))


def _leaf(rows: Column, kind: str, seed: int) -> Column:
    """Documents of one probability, largest first: each pivots against all that follow it."""

    def step(acc: Column, x: Column) -> Column:
        p, w = acc["p"], x["size"].cast("double")
        rest = acc["rest"] - w
        up, down = F.least((1 - p) * w, p * rest), F.least(p * w, (1 - p) * rest)
        rises = _uniform(x["salt"], F.lit(seed)) < down / (up + down)
        stays = (p == 0) | (p == 1) | (rest <= 0)
        own = F.when(stays, p).otherwise(_snap(F.when(rises, p + up / w).otherwise(p - down / w)))
        others = F.when(stays, p).otherwise(_snap(F.when(rises, p - up / rest).otherwise(p + down / rest)))
        return F.struct(others.alias("p"), rest.alias("rest"), F.concat(acc["out"], F.array(_with_p(x, own))).alias("out"))

    words = F.aggregate(rows, F.lit(0.0), lambda a, x: a + x["size"])
    start = F.struct(F.get(rows, 0)["p"].alias("p"), words.alias("rest"), F.array().cast(kind).alias("out"))
    return F.aggregate(rows, start, step, lambda acc: acc["out"])


def _pairs(rows: Column, kind: str, seed: int) -> Column:
    """Residuals of different probabilities: the one held pivots against the next."""

    def step(acc: Column, x: Column) -> Column:
        i = F.get(acc["held"], 0)
        a, b = i["p"] * i["size"], x["p"] * x["size"]
        give, take = F.least(a, x["size"] - b), F.least(b, i["size"] - a)
        gives = _uniform(i["salt"], x["salt"], F.lit(seed)) < take / (give + take)
        moved = F.when(gives, -give).otherwise(take)
        pair = F.array(_with_p(i, _snap((a + moved) / i["size"])), _with_p(x, _snap((b - moved) / x["size"])))
        both = F.when(i.isNull(), F.array(x)).otherwise(pair)
        done = lambda y: (y["p"] == 0) | (y["p"] == 1)
        return F.struct(F.filter(both, lambda y: ~done(y)).alias("held"), F.concat(acc["out"], F.filter(both, done)).alias("out"))

    empty = F.array().cast(kind)
    return F.aggregate(rows, F.struct(empty.alias("held"), empty.alias("out")), step, lambda acc: F.concat(acc["out"], acc["held"]))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    limit: float = 2.0,
    fanout: int = 128,
    seed: int = 7,
) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies and taken (copies x size)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    text = F.col(text_col).cast("string")
    mark = [F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit(1)).alias("b")]
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"), *mark)
    sized = scratch.keep(sized.groupBy("doc_id", "source", "size", "a", "b").agg(F.count(F.lit(1)).alias("m")), "sizes")
    each = sized.groupBy("source").agg(F.sum("m").alias("docs"), F.sum(F.col("size") * F.col("m")).alias("size"))
    targets = scratch.keep(source_targets(each, weights, share, limit), "targets")  # a row per source
    leaves = F.ceil(F.col("docs") / F.lit(fanout))
    df = sized.join(targets, sized["source"].eqNullSafe(targets["source"]), "left").drop(targets["source"])
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    df = df.withColumn("r", expected).withColumn("whole", F.floor(F.col("r") + EPS).cast("long"))
    df = df.withColumn("p", _snap(F.greatest(F.lit(0.0), F.col("r") - F.col("whole"))))
    df = df.withColumns({"salt": F.xxhash64("doc_id", "source", "a", "b", F.lit(seed)), "leaves": leaves})
    # the m rows of a unit: the first ones are certain of a copy, the next one is drawn, the others get none
    certain = F.floor(F.col("p") * F.col("m") + EPS)
    df = df.select("*", certain.alias("certain"), _snap(F.col("p") * F.col("m") - certain).alias("over"), F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("i"))
    own = F.when(F.col("i") <= F.col("certain"), 1.0).when(F.col("i") == F.col("certain") + 1, F.greatest(F.lit(0.0), F.col("over"))).otherwise(0.0)
    df = df.withColumn("p", F.when(F.col("m") == 1, F.col("p")).otherwise(own))

    kind = ROW.format(id=dict(sized.dtypes)["doc_id"])
    outcome = ["source", "doc_id", "size", "whole", "p"]
    settled = (F.col("p") == 0) | (F.col("p") == 1) | (F.col("size") == 0)
    parts = [df.where(settled).select(*outcome)]
    level, most = 0, targets.agg(F.max(leaves)).first()[0] or 0
    todo = df.where(~settled).withColumn("many", F.col("m") > 1)
    while most:
        leaf = F.pmod(F.xxhash64("salt", F.lit(level), F.lit(seed)), F.col("leaves"))
        row = F.struct("size", F.xxhash64("salt", F.lit(seed + level)).alias("salt"), "doc_id", "whole", "p")
        groups = todo.groupBy("source", "leaves", leaf.alias("leaf"), "many").agg(F.sort_array(F.collect_list(row), asc=False).alias("rows"))
        folded = _pairs(F.col("rows"), kind, seed + level)
        if level == 0:  # what is left over of a unit has a probability of its own
            folded = F.when(F.col("many"), folded).otherwise(_leaf(F.col("rows"), kind, seed))
        done = groups.select("source", "leaves", F.explode(folded).alias("x")).select("source", "leaves", "x.*")
        done = scratch.keep(done, f"level{level}")
        open_ = ~((F.col("p") == 0) | (F.col("p") == 1))
        parts.append(done.where(~open_).select(*outcome))
        todo = done.where(open_).withColumns({"leaves": F.ceil(F.col("leaves") / F.lit(fanout)), "many": F.lit(False)})
        level += 1
        if most == 1:
            last = F.when(_uniform(F.col("salt"), F.lit(seed + level)) < F.col("p"), 1.0).otherwise(0.0)
            parts.append(todo.withColumn("p", last).select(*outcome))
        most = 0 if most == 1 else -(-most // fanout)
    rounded = parts[0]
    for part in parts[1:]:
        rounded = rounded.unionByName(part)
    rounded = rounded.withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.col("p").cast("long")).otherwise(F.lit(1).cast("long")))
    totals = targets.select(F.col("source").alias("_source"), "source_size", "target")
    return (
        rounded.join(totals, rounded["source"].eqNullSafe(totals["_source"]), "left")
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )
