"""Scalar expressions over text columns; all of them run in the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Marks that end a sentence, and those that end a header candidate's chances.
SENTENCE_ENDS = ["。", "？", "！", ".", "?", "!"]
NO_HEADER_ENDS = ["。", "？", "！", ".", "?", "!", ";", "；", ":", "："]
DEFAULT_FACTORY = "Local"


def trim(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def last_char(text: Column) -> Column:
    return F.right(text, F.lit(1))


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return F.regexp_count(text, F.lit(rf"\Q{word}\E"))


def density(text: Column) -> Column:
    """Share of characters that aren't white space; null for an empty text."""
    return F.char_length(F.regexp_replace(text, r"(?U)\s", "")) / F.nullif(F.char_length(text), F.lit(0))


def overlap(before: Column, after: Column) -> Column:
    """Characters of the longest end of ``before`` that begins ``after``.

    An end of more than 16 characters can fit only where ``before`` holds the first 17 of ``after``, so
    nearly every pair of texts is settled by 16 short comparisons. The others go to ``longest_overlap``, in time
    linear in their length; of all other pairs it gets nulls.
    """
    first = F.left(after, F.lit(17))
    long = F.coalesce((F.char_length(first) == 17) & F.contains(before, first), F.lit(False))
    most = F.least(F.char_length(before), F.char_length(after), F.lit(16))
    fits = F.filter(F.sequence(F.lit(0), most), lambda i: F.right(before, i) == F.left(after, i))
    return F.coalesce(longest_overlap(F.when(long, before), F.when(long, after)), F.array_max(fits), F.lit(0))


def overlap_of(before: str, after: str) -> int:
    """The same for two strings: the state that the prefix automaton of ``after`` is in at the end of ``before``."""
    most = min(len(before), len(after))
    start, end = after[:most], before[len(before) - most :]
    back, k = [0] * most, 0  # the longest border of each beginning
    for i in range(1, most):
        c = start[i]
        while k and start[k] != c:
            k = back[k - 1]
        k += start[k] == c
        back[i] = k
    k = 0
    for c in end:
        while k and (k == most or start[k] != c):
            k = back[k - 1]
        k += start[k] == c
    return k


@F.pandas_udf(IntegerType())
def longest_overlap(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else overlap_of(a, b) for a, b in zip(before, after, strict=True)], dtype="Int32")


def han_runs(text: Column) -> Column:
    """Runs of two Han characters or more."""
    return F.regexp_extract_all(text, F.lit(r"\p{IsHan}{2,}"), F.lit(0))


def atoms(text: Column) -> Column:
    """Trimmed, non-empty sentences, without the marks that end them."""
    return F.filter(F.transform(F.split(text, r"[。！？.!?\n]+"), trim), lambda x: x != "")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, and the pairs inside runs of Han characters."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    pairs = F.flatten(
        F.transform(han_runs(F.coalesce(text, F.lit(""))), lambda r: F.transform(F.sequence(F.lit(1), F.char_length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))
    )
    return F.concat(words, pairs)


def token_estimate(text: Column) -> Column:
    """A quarter of the bytes, rounded down."""
    return F.floor(F.octet_length(text) / 4).cast("long")


def model_name(model: Column) -> Column:
    """What stands before the last @; all of it without one."""
    return F.when(model.contains("@"), F.regexp_extract(model, r"(?s)^(.*)@([^@]*)$", 1)).otherwise(model)


def model_factory(model: Column) -> Column:
    """What stands behind the last @; the default factory without it, nothing for nothing."""
    found = F.regexp_extract(model, r"(?s)^(.*)@([^@]*)$", 2)
    return F.when(model == "", "").when(found == "", DEFAULT_FACTORY).otherwise(found)


def masked(key: Column) -> Column:
    """First and last four characters of a key of more than eight."""
    return F.when(F.octet_length(key) <= 8, "****").otherwise(F.concat(F.left(key, F.lit(4)), F.lit("****"), F.right(key, F.lit(4))))


def host(base: Column) -> Column:
    """Host of an http address; what was given if it is none."""
    return F.when(base.rlike("^https?://"), F.regexp_extract(base, "^https?://([^/]*)", 1)).otherwise(base)


def is_url(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), F.lit(False))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def is_markdown(path: Column) -> Column:
    return extension(path).isin(".md", ".markdown")


def is_pdf(path: Column) -> Column:
    return extension(path) == ".pdf"


def space_name(kb: Column, prefix: str = "kg_") -> Column:
    return F.concat(F.lit(prefix), F.translate(kb, "-", "_"))


def object_key(tenant: Column, kb: Column, doc: Column, path: Column) -> Column:
    return F.concat(F.lit("tenant_"), tenant, F.lit("/kb_"), kb, F.lit("/"), doc, F.regexp_extract(path, r"\.[^./]+$", 0))


def title(message: Column, size: int = 20) -> Column:
    return F.substring(trim(message), 1, size)


def is_email(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"), F.lit(False))


def may_register(nickname: Column, email: Column, password: Column, repeated: Column) -> Column:
    """The first rule that a registration breaks; null if none."""
    n = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    return F.when(~n(nickname).between(1, 50), "nickname").when(~is_email(email), "email").when(n(password) < 6, "password").when(~password.eqNullSafe(repeated), "repeated")


def is_strong(password: Column) -> Column:
    """Whether it has upper-case and lower-case letters and digits, of any script."""
    return F.coalesce(password.rlike(r"\p{Lu}") & password.rlike(r"\p{Ll}") & password.rlike(r"\p{Nd}"), F.lit(False))


def tags(text: Column) -> Column:
    """A comma-separated list; none for an empty text."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, ","))


def millis(time: Column) -> Column:
    return F.unix_millis(time.cast("timestamp"))


def shown_time(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss")


def rfc3339(time: Column) -> Column:
    """In the session's time zone."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ssXXX")


def backoff_seconds(retries: Column, first: int = 30) -> Column:
    return (F.lit(first) * F.pow(F.lit(2), retries)).cast("long")


def json_list(answer: Column) -> Column:
    """What stands between the first [ and the last ] of an answer; null without it."""
    return F.nullif(F.regexp_extract(answer, r"(?s)\[.*\]", 0), F.lit(""))


def cleaned(text: Column, spaces: bool = True, addresses: bool = True) -> Column:
    """Without web and mail addresses, runs of white space as one blank."""
    out = F.regexp_replace(text, r"https?://\S+|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "") if addresses else text
    return trim(F.regexp_replace(out, r"(?U)\s+", " ")) if spaces else out


def chunk_id(content: Column, doc_id: Column, prefix: str = "chunk") -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.md5(F.concat(content, F.lit("-"), doc_id.cast("string"))))


def entity_id(kb: Column, name: Column) -> Column:
    return F.concat(F.lit("entity_"), F.md5(F.concat(kb, name)))


def relation_id(kb: Column, src: Column, dst: Column) -> Column:
    return F.concat(F.lit("relation_"), F.md5(F.concat(kb, src, dst)))
