"""Quality filtering by weak supervision, in DataFrame functions only.

Each rule looks at one surface statistic of a text and votes ``GOOD``, ``BAD`` or abstains.
No rule is trusted by itself: expectation-maximisation over the distinct vote patterns
estimates, for every rule, how often it casts each vote on good and on bad texts, and the
posterior probability of a good text replaces a conjunction of thresholds.

Defined results: a null text has no words (all counts 0, ``base_failed`` true); rows are
judged one by one, so repeated ids give repeated rows; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.llm.scratch import Scratch

SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: words without any letter or digit
LONE_SYMBOLS = r"(?<![^\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]+(?![^\x20\x09-\x0D])"
WINDOW = 5
BAD, ABSTAIN, GOOD = 0, 1, 2


def split_words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def _ordered_windows(words: str, hashes: str) -> Column:
    """Windows of a text, equal ones side by side, with their start positions.

    Windows are ordered by their words themselves, so equal hashes of different words do no harm.
    """
    return F.sort_array(
        F.transform(
            F.col(hashes),
            lambda _, i: F.struct(F.array_join(F.slice(F.col(words), i + 1, WINDOW), " ").alias("s"), i.alias("i")),
        )
    )


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts that the rules read. No shuffle."""
    long = "long"
    text = F.coalesce(F.col("_text"), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    df = df.select("doc_id", "_text", split_words(F.col("_text")).alias("_words"))
    df = df.withColumn("n_words", F.size("_words").cast(long))
    # windows as 64-bit hashes; texts without a repeated hash, nearly all, stop here
    hashes = F.transform(
        F.slice(F.col("_words"), F.lit(1), F.greatest(F.size("_words") - (WINDOW - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *[F.get(F.col("_words"), i + k) for k in range(1, WINDOW)]),
    )
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    df = df.withColumns({"_hashes": hashes, "_lines": lines})
    df = df.withColumn("_repeats", F.size(F.array_distinct("_hashes")) < F.size("_hashes"))
    nothing = F.array().cast("array<struct<s:string,i:int>>")
    df = df.withColumn("_windows", F.when(F.col("_repeats"), _ordered_windows("_words", "_hashes")).otherwise(nothing))
    same = lambda x, i: F.coalesce(F.get(F.col("_windows"), i)["s"] == x["s"], F.lit(False))
    starts = F.sort_array(F.transform(F.filter(F.col("_windows"), lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))
    df = df.withColumn("_starts", starts)
    # each start covers its window, or the words up to the next start
    covered = F.transform(F.col("_starts"), lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_starts"), i + 1) - p, F.lit(WINDOW))))
    return df.select(
        "doc_id",
        "n_words",
        F.char_length(F.array_join("_words", "")).cast(long).alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast(long).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast(long).alias("n_dup_lines"),
        F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast(long).alias("n_repeat_words"),
        F.size("_lines").cast(long).alias("n_lines"),
        F.size(F.array_distinct("_words")).cast(long).alias("n_distinct_words"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast(long).alias("n_upper"),
        F.regexp_count(text, F.lit(r"\p{L}")).cast(long).alias("n_letters"),
        F.regexp_count(text, F.lit(r"[0-9]")).cast(long).alias("n_digits"),
        F.regexp_count(text, F.lit(r"[!?]")).cast(long).alias("n_marks"),
        F.regexp_count(text, F.lit(LONE_SYMBOLS)).cast(long).alias("n_lone_symbols"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def rules() -> dict[str, Column]:
    """Votes by name, over the columns of ``text_statistics``; a share that can't be formed abstains."""
    share = lambda a, b: F.col(a) / F.when(F.col(b) > 0, F.col(b))
    symbols, upper, marks = share("n_symbols", "n_words"), share("n_upper", "n_letters"), share("n_marks", "n_words")
    digits, letters = share("n_digits", "word_chars"), share("n_letters", "word_chars")
    lines, repeats = share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")
    alone = share("n_lone_symbols", "n_words")
    length, variety = share("word_chars", "n_words"), share("n_distinct_words", "n_words")
    return {
        "symbols": _vote(symbols > 0.3, symbols < 0.05),
        "capitals": _vote(upper > 0.4, upper < 0.15),
        "marks": _vote(marks > 0.3, marks < 0.05),
        "digits": _vote(digits > 0.2, digits < 0.05),
        "letters": _vote(letters < 0.7, letters > 0.85),
        "lone_symbols": _vote(alone > 0.2, alone < 0.05),
        "lines": _vote(lines > 0.3, lines < 0.05),
        "repeats": _vote(repeats > 0.1, repeats == 0),
        "length": _vote((length < 2.5) | (length > 12), length.between(3.5, 9)),
        "variety": _vote(variety < 0.15, variety > 0.3),
    }


def _posterior(names: list[str], model: dict) -> Column:
    """Probability that a text is good, from its votes."""
    odds = F.lit(math.log(model["good"] / (1 - model["good"])))
    for name in names:
        p = model[name]
        ratio = [math.log(p[GOOD][v] / p[BAD][v]) for v in (BAD, ABSTAIN, GOOD)]
        odds = odds + F.element_at(F.array(*map(F.lit, ratio)), F.col(name) + 1)
    return 1 / (1 + F.exp(-F.least(F.lit(500.0), F.greatest(F.lit(-500.0), odds))))


def fit_votes(patterns: DataFrame, names: list[str], rounds: int = 12, start_bad: float = 0.8, start_good: float = 0.05) -> dict:
    """Expectation-maximisation over vote patterns.

    ``patterns`` has a row per distinct vote pattern with its count ``n``: at most three to the
    power of the number of rules; the driver sees three pairs of sums per rule and round. Texts with a
    BAD vote start as bad with probability ``start_bad``, others with ``start_good``; it ends when
    the expected number of bad texts moves by a ten-thousandth or less. Add-one
    counts keep every probability above 0, so an empty table gives uninformative rules.
    """
    bad = F.when(F.least(*[F.col(n) for n in names]) == BAD, F.lit(start_bad)).otherwise(F.lit(start_good))
    cast = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("vote")) for n in names]))
    model: dict = {}
    before = 0.0
    for _ in range(rounds + 1):
        df = patterns.select("n", (F.col("n") * bad).alias("bad"), cast.alias("x"))
        rows = df.groupBy("x.rule", "x.vote").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).collect()
        sums = {(r["rule"], r["vote"]): (r["bad"], r["n"] - r["bad"]) for r in rows}
        votes = (BAD, ABSTAIN, GOOD)
        all_bad, all_good = (sum(sums.get((names[0], v), (0.0, 0.0))[k] for v in votes) for k in (0, 1))
        model = {"good": (all_good + 1) / (all_bad + all_good + 2)}
        for name in names:
            per = [sums.get((name, v), (0.0, 0.0)) for v in votes]
            model[name] = {BAD: [(x[0] + 1) / (all_bad + 3) for x in per], GOOD: [(x[1] + 1) / (all_good + 3) for x in per]}
        bad = 1 - _posterior(names, model)
        if abs(all_bad - before) <= 1e-4 * (all_bad + all_good):
            break
        before = all_bad
    return model


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Statistics, votes, the posterior ``quality`` and ``kept`` (base rules hold and quality >= threshold).

    The statistics are computed once and written to the shared folder; estimating the rules
    and judging the texts read that narrow table.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    named = {f"vote_{k}": v for k, v in rules().items()}
    names = list(named)
    stats = scratch.keep(text_statistics(docs, id_col, text_col).withColumns({"base_failed": base_failed(), **named}), "statistics")
    patterns = scratch.keep(stats.where(~F.col("base_failed")).groupBy(*names).agg(F.count(F.lit(1)).alias("n")).coalesce(1), "patterns")
    model = fit_votes(patterns, names)
    return stats.withColumn("quality", _posterior(names, model)).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
