"""Chunk quality in five parts, as column expressions, and the selection of chunks that need questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions import text as T

#: Words that a chunk shouldn't begin with or hold many of.
CONJUNCTIONS = ["但是", "并且", "因此", "所以", "然而", "不过", "而且", "以及", "或者"]
PRONOUNS = ["它", "他", "她", "这", "那", "该", "其", "此"]
#: Fixed value: the marks of a sentence that was cut off.
CUT_OFF = [",", "，", "、", ";", "；", ":", "："]
QA = "array<struct<question:string,answer:string>>"
#: what ``scored`` adds to a chunk
SCORES = ["length", "structure", "content_score", "semantic", "qa", "total", "issues", "suggestions"]


def _begins(text: Column, words: list[str]) -> Column:
    return text.rlike("^(" + "|".join(words) + ")")


def _issues(*pairs: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(c, name) for c, name in pairs]), lambda x: x.isNotNull())


def length_score(content: Column) -> Column:
    n = F.char_length(content)
    return F.when(n.between(300, 800), 20.0).when(n.between(100, 299), 12.0).when(n.between(801, 1000), 16.0).when(n < 100, 6.0).otherwise(10.0)


def structure_score(content: Column) -> Column:
    bare = T.trim(content)
    end = F.when(T.last_char(bare).isin(T.SENTENCE_ENDS), 10.0).otherwise(5.0)
    whole = end + F.when(_begins(bare, CONJUNCTIONS), 0.0).otherwise(5.0) + F.when(_begins(bare, PRONOUNS), 0.0).otherwise(5.0)
    return F.when(bare == "", 0.0).otherwise(whole)


def overlap_ratio(previous: Column, content: Column) -> Column:
    least = F.least(F.char_length(previous), F.char_length(content))
    return F.coalesce(T.overlap(previous, content) / F.nullif(least, F.lit(0)), F.lit(0.0))


def semantic_score(content: Column) -> Column:
    count = lambda words: sum((T.occurrences(content, w) for w in words), F.lit(0))
    return F.greatest(F.lit(0.0), 20.0 - 2.0 * F.least(count(PRONOUNS), F.lit(5)) - 3.0 * F.least(count(CONJUNCTIONS), F.lit(3)))


def qa_score(content: Column, qa: Column) -> Column:
    n = F.size(qa)
    begins = F.transform(qa, lambda x: F.left(x["question"], F.lit(4)))
    repeated = n - F.size(F.array_distinct(begins))
    matched = F.size(F.filter(qa, lambda x: F.exists(T.han_runs(x["question"]), lambda r: F.contains(content, r))))
    return F.when(n > 0, F.least(n, F.lit(3)) / 3 * 10 + (1 - repeated / n) * 5 + matched / n * 5).otherwise(0.0)


def scored(chunks: DataFrame, id_col: str = "doc_id", order_col: str = "chunk_index", content_col: str = "content", qa_col: str | None = None, previous_col: str | None = None) -> DataFrame:
    """``chunks`` with length, structure, content_score, semantic, qa, total, issues and suggestions.

    The predecessor is the chunk before it in its document, so documents spread over the cluster; where
    ``previous_col`` holds its content already, nothing is shuffled.
    A null content is an empty one.
    """
    content = F.coalesce(F.col(content_col), F.lit(""))
    before = F.col(previous_col) if previous_col else F.lag(content).over(Window.partitionBy(id_col).orderBy(order_col))
    qa = F.coalesce(F.col(qa_col), F.array().cast(QA)) if qa_col else F.array().cast(QA)
    df = chunks.withColumns({"_c": content, "_prev": before, "_qa": qa})
    c, prev, qa = F.col("_c"), F.col("_prev"), F.col("_qa")
    df = df.withColumns({"_ratio": F.when(prev.isNotNull(), overlap_ratio(prev, c)).otherwise(0.0), "_density": F.coalesce(T.density(c), F.lit(0.0)) * 10})
    df = df.withColumns(
        {
            "length": length_score(c),
            "structure": structure_score(c),
            "content_score": F.col("_density") + (1 - F.col("_ratio")) * 10,
            "semantic": semantic_score(c),
            "qa": qa_score(c, qa),
        }
    )
    bare, n = T.trim(c), F.char_length(c)
    issues = _issues(
        (n < 100, "chunk_too_short"),
        (n > 1000, "chunk_too_long"),
        (T.last_char(bare).isin(CUT_OFF), "truncated_end"),
        (_begins(bare, PRONOUNS), "dangling_reference"),
        ((c != "") & (F.col("_density") < 5), "low_info_density"),
        (F.col("_ratio") > 0.5, "high_overlap"),
        (F.size(qa) < 2, "low_qa_coverage"),
    )
    advice = _issues((n < 100, "merge_with_prev"), (n > 1000, "split_further"), (T.last_char(bare).isin(CUT_OFF), "extend_boundary"), (F.size(qa) < 2, "generate_qa"))
    total = F.col("length") + F.col("structure") + F.col("content_score") + F.col("semantic") + F.col("qa")
    return df.withColumns({"total": total, "issues": issues, "suggestions": advice}).drop("_c", "_prev", "_qa", "_ratio", "_density")


def statistics(scores: DataFrame, total_col: str = "total") -> DataFrame:
    """One row: high (80 and more), mid (60 and more), low and the mean; a missing score counts as 0."""
    s = F.coalesce(F.col(total_col), F.lit(0.0))
    return scores.agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(s >= 80).alias("high"), F.count_if((s >= 60) & (s < 80)).alias("mid"), F.count_if(s < 60).alias("low"), F.avg(s).alias("mean")
    )


def needs_questions(chunks: DataFrame, qa_col: str, content_col: str = "content", least: int = 100, wanted: int = 2) -> DataFrame:
    """Chunks of ``least`` characters or more with fewer than ``wanted`` questions."""
    return chunks.where((F.coalesce(F.size(qa_col), F.lit(0)) < wanted) & (F.char_length(content_col) >= least))


def parsed_questions(answer: Column) -> Column:
    """Questions and answers of a model's reply: the JSON list in it, without incomplete items; null if there is none."""
    found = F.from_json(T.json_list(answer), QA)
    return F.filter(found, lambda x: x["question"].isNotNull() & x["answer"].isNotNull() & (x["question"] != "") & (x["answer"] != ""))


def with_questions(chunks: DataFrame, answer: Callable[[Column], Column], qa_col: str = "qa_pairs", content_col: str = "content") -> DataFrame:
    """Adds the questions that ``answer`` (an expression or pandas UDF over a chunk) finds, where they are needed."""
    wanted = (F.coalesce(F.size(qa_col), F.lit(0)) < 2) & (F.char_length(content_col) >= 100)
    return chunks.withColumn(qa_col, F.when(wanted, F.coalesce(parsed_questions(answer(F.col(content_col))), F.col(qa_col))).otherwise(F.col(qa_col)))
