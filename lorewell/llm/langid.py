"""Language identification of mixed texts: script ranges, word scores and Viterbi.

Letters' script ranges narrow a word's candidate languages to those that were seen writing that
script. Within them, character n-grams of the word give each language a log-probability. Viterbi
over the words of the whole text, with a penalty for each change of language, labels spans; the
language with most words is the text's. Words end at white space; letters of scripts that are
written without spaces are words of their own.

Defined results: null texts and texts without a letter are ``und`` with score 0; words whose
script no known language writes, and words without letters, support no language; a text whose
letters support none gets the language of most counted letters, with score 0; without any
labelled row every text is ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm.shingles import MIX, mixed

#: First code point of a range of letters and its script; a range ends where the next begins.
SCRIPT_RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "thaana"), (0x07C0, "nko"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"),
    (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "cherokee"), (0x1400, "other"), (0x1780, "khmer"),
    (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "bopomofo"), (0x3130, "hangul"),
    (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"),
    (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"),
    (0x20000, "han"), (0x30000, "other"),
]
STARTS = np.array([a for a, _ in SCRIPT_RANGES])
SCRIPTS = sorted({s for _, s in SCRIPT_RANGES})
SCRIPT_AT = np.array([SCRIPTS.index(s) for _, s in SCRIPT_RANGES])
#: Letters of scripts that put no spaces between words
UNSPACED = re.compile("([\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\U00020000-\U0002FFFF])")
BUCKETS = 1 << 15
LARGEST = 12.0
LONGEST = 4
SEEDS = np.arange(1, LONGEST + 1, dtype=np.uint64) * MIX[2]


@cache
def _letters() -> np.ndarray:
    """By code point: whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    return text.split() if text.isascii() else UNSPACED.sub(r" \1 ", text).split()


def letter_runs(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters of all words between marks 1 and 2, where each word starts, and its script (-1: no letter)."""
    points = np.frombuffer("\n".join(tokens).lower().encode("utf-32-le", "replace"), "<u4")
    owner = np.cumsum(points == 10)
    own = _letters()[points]
    letters, owner = points[own], owner[own]
    n = np.bincount(owner, minlength=len(tokens))
    before = np.cumsum(n) - n
    starts = before + 2 * np.arange(len(tokens))
    out = np.zeros(len(letters) + 2 * len(tokens), np.uint64)
    out[starts], out[starts + n + 1] = 1, 2
    out[np.arange(len(letters)) + 2 * owner + 1] = letters
    script = np.full(len(tokens), -1)
    some = n > 0
    script[some] = SCRIPT_AT[np.searchsorted(STARTS, letters[before[some]], side="right") - 1]
    return out, starts, script


def ngram_buckets(runs: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n-grams of 1 to 4 letters and marks: the bucket of the one at each place, and whether it lies within a word."""
    left = np.diff(np.append(starts, len(runs)))
    left = np.repeat(starts + left, left) - np.arange(len(runs))  # letters to the word's end
    h = np.zeros(len(runs), np.uint64)
    for n in range(1, LONGEST + 1):
        ahead = np.zeros(len(runs), np.uint64)
        ahead[: len(runs) - n + 1] = runs[n - 1 :]
        h = h * MIX[1] + ahead
        yield (mixed(h + SEEDS[n - 1]) >> np.uint64(49)).astype(np.int64), left >= n


class LanguageModel:
    """Languages, the scripts they write and their log-probabilities by n-gram bucket."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray) -> None:
        self.languages = languages
        table = counts.reshape(-1, BUCKETS) + 0.5
        self.table = np.log(table / table.sum(axis=1, keepdims=True)).T.astype(np.float32)  # bucket, language
        #: script, language
        self.writes = ((scripts > 0) & (scripts >= 0.01 * scripts.sum(axis=1, keepdims=True))).T
        self.common = int(scripts.sum(axis=1).argmax()) if languages else 0

    def scores(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores by language, 0 for the best candidate and at least -LARGEST, and what each word is: 0 without letters, 1 of no known script, 2 known."""
        k = len(self.languages)
        parts, step = [], max(1, 400_000 // max(1, k))
        for at in range(0, len(tokens), step):
            runs, starts, script = letter_runs(tokens[at : at + step])
            able = self.writes[script] & (script >= 0)[:, None]
            known = able.any(axis=1)
            s = np.zeros((len(starts), k), np.float32)
            for bucket, inside in ngram_buckets(runs, starts):
                s += np.add.reduceat(self.table[bucket] * inside[:, None], starts)
            s = np.where(able, s / 2, -np.inf)  # n-grams overlap
            s[~known] = 0
            parts.append((np.maximum(s - s.max(axis=1, keepdims=True), -LARGEST), known.astype(np.int8) + (script >= 0)))
        return np.concatenate([p for p, _ in parts]), np.concatenate([q for _, q in parts])


class WordTable(dict):
    """Number of each word seen; ``rows`` and ``kinds`` hold its scores and kind. Emptied between groups when full."""

    def __init__(self, model: LanguageModel, limit: int = 300_000) -> None:
        super().__init__()
        self.model, self.limit, self.new = model, limit, []
        self.rows, self.kinds = np.zeros((1024, len(model.languages)), np.float32), np.zeros(1024, np.int8)

    def __missing__(self, token: str) -> int:
        i = self[token] = len(self)
        self.new.append(token)
        return i

    def settle(self) -> None:
        """Scores all words that are new, together."""
        if self.new:
            n, first = len(self), len(self) - len(self.new)
            if n > len(self.kinds):
                self.rows = np.concatenate([self.rows[:first], np.zeros((2 * n - first, self.rows.shape[1]), np.float32)])
                self.kinds = np.concatenate([self.kinds[:first], np.zeros(2 * n - first, np.int8)])
            self.rows[first:n], self.kinds[first:n] = self.model.scores(self.new)
            self.new = []

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of every word. ``scores``: words of texts one after another, longest text first.

    All texts advance together, one word a step; texts that have ended drop off the end.
    """
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    k = scores.shape[1]
    path = np.zeros(len(scores), np.int16)
    origin = np.empty((len(scores), k), np.int16)
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # texts longer than t words
    own = np.arange(k, dtype=np.int16)
    value = np.zeros((len(lengths), k), np.float32)
    last = np.zeros(len(lengths), np.int16)
    for t in range(longest):
        n = active[t]
        v, at = value[:n], starts[:n] + t
        if t:
            best = v.argmax(axis=1)
            jump = v[np.arange(n), best] - penalty
            leaves = v < jump[:, None]
            origin[at] = np.where(leaves, best[:, None].astype(np.int16), own)
            v = np.where(leaves, jump[:, None], v)
        value[:n] = v + scores[at]
    if longest:
        last = value.argmax(axis=1).astype(np.int16)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        path[at] = last[:n]
        if t:
            last[:n] = origin[at, last[:n]]
    return path


def spans(text: str, model: LanguageModel, penalty: float = 8.0) -> list[tuple[str, str]]:
    """(language, words) of the labelled spans of one text, in order."""
    words = words_of(text)
    if not words or not model.languages:
        return []
    path = viterbi(model.scores(words)[0], np.array([len(words)]), penalty)
    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1), len(words)]
    return [(model.languages[path[a]], " ".join(words[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]


def _counted(texts: DataFrame) -> DataFrame:
    """lang, i, n: n-grams by bucket, and words by the script of their first letter behind them, of (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                here = seen.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                words = words_of(text)
                for at in range(0, len(words), 100_000):
                    runs, starts, script = letter_runs(words[at : at + 100_000])
                    lettered = np.repeat(script >= 0, np.diff(np.append(starts, len(runs))))
                    for bucket, inside in ngram_buckets(runs, starts):
                        here[:BUCKETS] += np.bincount(bucket[inside & lettered], minlength=BUCKETS)
                    here[BUCKETS:] += np.bincount(script[script >= 0], minlength=len(SCRIPTS))
        for lang, here in seen.items():
            i = np.flatnonzero(here)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), pa.array(i, pa.int64()), pa.array(here[i], pa.int64())], ["lang", "i", "n"])

    return texts.mapInArrow(run, "lang string, i long, n long").groupBy("lang", "i").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 300) -> LanguageModel:
    """Counts n-grams of at most ``per_language`` texts a language, those of the least hash of their id, in tasks.

    The driver gets a row per language and bucket.
    """
    from pyspark.sql import Window

    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and id is not null")
    by = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    ids = known.withColumn("r", F.row_number().over(by)).where(F.col("r") <= per_language).select("id", "lang").distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").join(F.broadcast(ids), "id")
    found = _counted(texts.select("lang", "text")).toPandas()
    languages = sorted(set(found["lang"]))
    counts = np.zeros((len(languages), BUCKETS + len(SCRIPTS)))
    counts[np.searchsorted(np.array(languages, object), found["lang"].to_numpy(object)), found["i"].to_numpy(int)] = found["n"].to_numpy(float)
    return LanguageModel(languages, counts[:, :BUCKETS], counts[:, BUCKETS:])


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", penalty: float = 8.0) -> DataFrame:
    """doc_id, lang_pred, score (share of its words) and n_spans of every row; no shuffle."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x 32768 numbers
    most = max(1, 8_000_000 // max(1, len(model.languages)))

    def label(texts: list[str | None], words: WordTable) -> list[tuple[str, float, int]]:
        tokens = [words_of(t) for t in texts]
        ids = [np.fromiter(map(words.__getitem__, t), np.int32, len(t)) for t in tokens]
        words.settle()
        order = np.argsort([-len(x) for x in ids], kind="stable")
        lengths = np.array([len(ids[i]) for i in order])
        flat = np.concatenate([ids[i] for i in order])
        languages = words.model.languages
        out: list[tuple[str, float, int]] = [("und", 0.0, 0)] * len(ids)
        if len(flat) and languages:
            path = viterbi(words.rows[flat], lengths, penalty)
            kinds, at = words.kinds[flat], 0
            for i, n in zip(order, lengths, strict=True):
                own, has, kind = path[at : at + n], kinds[at : at + n] == 2, kinds[at : at + n]
                at += n
                if has.any():
                    votes = np.bincount(own[has], minlength=len(languages))
                    out[i] = (languages[int(votes.argmax())], float(votes.max() / votes.sum()), int(np.count_nonzero(np.diff(own)) + 1))
                elif kind.any():
                    out[i] = (languages[words.model.common], 0.0, 1)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTable(shared.value)
        for batch in batches:
            texts, group, size, rows = batch.column(1).to_pylist(), [], 0, []
            for t in texts:
                group.append(t)
                size += len(t or "") // 5
                if size >= most:
                    rows += label(group, words)
                    group, size = [], 0
                    words.trim()
            if group:
                rows += label(group, words)
                words.trim()
            lang, score, n = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(n, pa.int64())], ["doc_id", "lang_pred", "score", "n_spans"])

    return narrow.mapInArrow(run, f"doc_id {dict(narrow.dtypes)['doc_id']}, lang_pred string, score double, n_spans long")
