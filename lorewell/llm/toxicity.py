"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean over the word and its character n-grams, hashed into buckets, so a
misspelling never seen shares most of its vectors with the word it comes from. A window of about
64 words is the mean of its distinct words; a softmax over two classes reads it. Embeddings and softmax
are trained together on a bounded sample of labelled rows. A text's score is that of its worst
window, over the whole text: a few words in a long text count as much as in a short one.

Since the model is linear in a word's vectors, scoring needs one number a word.

Defined results: null, empty and blank texts get the score of the bias alone; repeated rows get
the same score each; without labels of both classes every score is 0.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 64
#: a bag of fewer words is averaged as if it had this many, so that one odd word is no verdict
FEWEST = 32
BUCKETS = 1 << 16


#: longest word, with its marks, whose n-grams are held as strings; those of longer ones are held as four bytes each
HELD_WORD = 256


def subwords(token: str) -> list[int] | np.ndarray:
    """Buckets of a word and its distinct n-grams of 3 to 5 characters; none without letters or digits."""
    word = "".join(filter(str.isalnum, token.lower()))
    if not word:
        return []
    marked = f"<{word}>"
    if len(marked) > HELD_WORD:
        whole = np.array([zlib.crc32(marked.encode("utf-8", "replace"))], np.uint32)
        return np.unique(np.concatenate([whole, *(gram_checksums(marked, n) for n in (3, 4, 5))])) % np.uint32(BUCKETS)
    grams = {marked} | {marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)}
    return [zlib.crc32(g.encode("utf-8", "replace")) % BUCKETS for g in sorted(grams)]


def _checksum_steps() -> np.ndarray:
    """What a byte adds to a CRC-32, by the rule of its polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


STEPS = _checksum_steps()


def gram_checksums(word: str, n: int, at_once: int = 1 << 20) -> np.ndarray:
    """CRC-32 of every distinct n-gram's UTF-8 bytes, without a string for any of them."""
    points = np.frombuffer(word.encode("utf-32-le", "replace"), np.uint32)
    found = []
    for at in range(0, len(points) - n + 1, at_once):
        c = np.full(min(at_once, len(points) - n + 1 - at), 0xFFFFFFFF, np.uint32)
        for k in range(n):
            p = points[at + k : at + k + len(c)]
            size = 1 + (p >= 0x80) + (p >= 0x800) + (p >= 0x10000)
            first = np.array([0, 0, 0xC0, 0xE0, 0xF0], np.uint32)[size] | (p >> (6 * (size - 1)).astype(np.uint32))
            for j in range(4):  # a character has one to four bytes
                rest = np.uint32(0x80) | ((p >> (6 * np.maximum(size - 1 - j, 0)).astype(np.uint32)) & np.uint32(0x3F))
                byte = first if j == 0 else rest
                c = np.where(size > j, STEPS[(c ^ byte) & np.uint32(0xFF)] ^ (c >> np.uint32(8)), c)
        found.append(np.unique(c ^ np.uint32(0xFFFFFFFF)))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint32)


def mean_weights(words: list[str], weights: np.ndarray) -> np.ndarray:
    """For each word (letters and digits in lower case, one at least) the mean weight of what ``subwords`` finds, for all words at once."""
    marked = [f"<{w}>" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    p = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), np.uint32)
    word, left = np.repeat(np.arange(len(marked)), lengths), np.repeat(np.cumsum(lengths), lengths) - np.arange(len(p))
    size = 1 + (p >= 0x80) + (p >= 0x800) + (p >= 0x10000)
    first = np.array([0, 0, 0xC0, 0xE0, 0xF0], np.uint32)[size] | (p >> (6 * (size - 1)).astype(np.uint32))
    rest = [(at := np.flatnonzero(size > j), np.uint32(0x80) | ((p[at] >> (6 * (size[at] - 1 - j)).astype(np.uint32)) & np.uint32(0x3F))) for j in (1, 2, 3)]
    whole = np.fromiter((zlib.crc32(m.encode("utf-8", "replace")) for m in marked), np.uint32, len(marked))
    at, c, found = np.arange(len(p)), np.full(len(p), 0xFFFFFFFF, np.uint32), [(np.arange(len(marked)) << 32) | whole]
    for n in range(1, 6):  # the checksum of n characters goes on from that of n - 1
        keep = left[at] >= n
        at, c = at[keep], c[keep]
        c = STEPS[(c ^ first[at + n - 1]) & np.uint32(0xFF)] ^ (c >> np.uint32(8))
        for places, byte in rest:
            here = np.searchsorted(at, places - (n - 1))
            here[here == len(at)] = 0
            some = at[here] == places - (n - 1) if len(at) else np.zeros(len(places), bool)
            here = here[some]
            c[here] = STEPS[(c[here] ^ byte[some]) & np.uint32(0xFF)] ^ (c[here] >> np.uint32(8))
        if n > 2:
            found.append((word[at] << 32) | (c ^ np.uint32(0xFFFFFFFF)))
    different = np.sort(np.concatenate(found))
    different = different[np.diff(different, prepend=-1) != 0]
    word = different >> 32
    return np.bincount(word, weights[different % BUCKETS], len(words)) / np.bincount(word, minlength=len(words))


class WordScores(dict):
    """Scores of words seen before; emptied when full."""

    def __init__(self, weights: list[float], limit: int = 400_000) -> None:
        super().__init__()
        self.weights, self.limit = weights, limit
        self.array = np.array(weights, np.float64)

    def learn(self, texts: list[list[str]], at_once: int = 4096) -> None:
        """Scores the new tokens of texts together; long ones are left to be scored where they occur."""
        if len(self) >= self.limit:
            self.clear()
        new = [token for token in set().union(*texts) if token not in self and len(token) <= HELD_WORD // 4]
        place: dict[str, int] = {"": 0}
        at = [place.setdefault(w if w.isalnum() else "".join(filter(str.isalnum, w)), len(place)) for w in map(str.lower, new)]
        words = list(place)
        scores = np.concatenate([[0.0], *(mean_weights(words[a : a + at_once], self.array) for a in range(1, len(words), at_once))])
        self.update(zip(new, scores[at].tolist() if at else (), strict=True))

    def __missing__(self, token: str) -> float:
        if len(self) >= self.limit:
            self.clear()
        found = subwords(token)
        if isinstance(found, np.ndarray):  # a word that long is not held
            return float(self.array[found].mean())
        score = self[token] = sum([self.weights[b] for b in found]) / len(found) if found else 0.0
        return score


def window_starts(n: int) -> np.ndarray:
    """Starts of equal windows of 64 words or more, at most 127."""
    count = max(1, n // WINDOW)
    return (np.arange(count) * n) // count


@dataclass
class ToxicityModel:
    """Bucket weights (difference of the two classes) and the bias."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None], words: WordScores, at_once: int = 256) -> Iterator[float]:
        """The score of every text, in order; new words of some texts are scored together."""
        for a in range(0, len(texts), at_once):
            split = [text.split() if text else [] for text in texts[a : a + at_once]]
            words.learn(split)
            yield from (self._score(tokens, words) for tokens in split)

    def score(self, text: str | None, words: WordScores) -> float:
        return self._score(text.split() if text else [], words)

    def _score(self, tokens: list[str], words: WordScores) -> float:
        logit = self.bias
        if tokens:
            cuts = [*window_starts(len(tokens)).tolist(), len(tokens)]
            bags = [set(tokens[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            logit += max(sum(map(words.__getitem__, bag)) / max(FEWEST, len(bag)) for bag in bags)
        return 1 / (1 + math.exp(-min(500.0, max(-500.0, logit))))


def _bags(texts: list[str], least: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Word numbers of each text and the buckets of each word.

    Buckets met in fewer than ``least`` texts tell texts apart, not classes: they are left out.
    """
    vocabulary: dict[str, int] = {}
    grams: list[np.ndarray] = []
    bags = []
    for text in texts:
        ids = []
        for token in text.split():
            i = vocabulary.get(token)
            if i is None:
                i = vocabulary[token] = len(grams)
                grams.append(np.array(subwords(token), np.int32))
            ids.append(i)
        bags.append(np.array(ids, np.int32))
    met = np.zeros(BUCKETS, np.int32)
    for bag in bags:
        if len(bag):
            met[np.unique(np.concatenate([grams[i] for i in np.unique(bag)]))] += 1
    return bags, [g[met[g] >= least] for g in grams]


def train(texts: list[str], labels: list[int], prior: float, size: int = 4, steps: int = 500, batch: int = 512, rate: float = 0.4, least: int = 4, seed: int = 3) -> ToxicityModel:
    """Adagrad on windows that are labelled as their texts.

    ``prior`` is the share of label 1 among all labelled rows. After each third of the steps, of a
    text labelled 1 only the best window and those more likely toxic than not stay: the others need not hold anything toxic.
    """
    bags, grams = _bags(texts, least)
    if not bags or len(set(labels)) < 2:
        return ToxicityModel(np.zeros(BUCKETS), -500.0)
    windows = [np.unique(w) for bag in bags for w in np.split(bag, window_starts(len(bag))[1:])]
    owner = np.repeat(np.arange(len(bags)), [len(window_starts(len(bag))) for bag in bags])
    target = np.array(labels)[owner]
    lens = np.array([len(g) for g in grams], np.int64)
    ends = np.cumsum(lens)
    flat = np.concatenate(grams)
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.05, (BUCKETS, size)).astype(np.float32)
    w, b = rng.normal(0, 0.5, (size, 2)).astype(np.float32), np.zeros(2, np.float32)
    sides = [np.flatnonzero(target == v) for v in (0, 1)]
    every = sides[1]
    ge, gw, gb = np.full_like(e, 1e-8), np.full_like(w, 1e-4), np.full_like(b, 1e-4)

    def forward(chosen: np.ndarray):
        n = np.array([max(FEWEST, len(windows[i])) for i in chosen])
        words, inverse = np.unique(np.concatenate([windows[i] for i in chosen]), return_inverse=True)
        k = lens[words]
        ids = flat[np.repeat(ends[words] - np.cumsum(k), k) + np.arange(k.sum())]
        row = np.repeat(np.arange(len(words)), k)
        vectors = np.stack([np.bincount(row, e[ids, c], len(words)) for c in range(size)], axis=1) / np.maximum(k, 1)[:, None]
        place = np.repeat(np.arange(len(chosen)), [len(windows[i]) for i in chosen])
        means = np.stack([np.bincount(place, vectors[inverse, c], len(chosen)) for c in range(size)], axis=1) / n[:, None]
        return n, k, ids, row, inverse, place, means, len(words)

    for step in range(steps):
        if step in (steps // 3, 2 * steps // 3):  # which windows of a toxic text are the toxic ones
            parts = np.array_split(every, max(1, len(every) // batch))
            margin = np.concatenate([forward(part)[6] @ (w[:, 1] - w[:, 0]) for part in parts]) + b[1] - b[0]
            best = np.full(len(bags), -np.inf)
            np.maximum.at(best, owner[every], margin)
            sides[1] = every[(margin >= best[owner[every]]) | (margin > 0)]
        chosen = np.concatenate([rng.choice(side, batch // 2) for side in sides])
        n, k, ids, row, inverse, place, means, count = forward(chosen)
        z = means @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(chosen)), target[chosen]] -= 1
        p /= len(chosen)
        d_means = (p @ w.T) / n[:, None]
        d_words = np.stack([np.bincount(inverse, d_means[place, c], count) for c in range(size)], axis=1) / np.maximum(k, 1)[:, None]
        speed = rate * (1 - step / steps)
        for c in range(size):
            de = np.bincount(ids, d_words[row, c], BUCKETS).astype(np.float32)
            ge[:, c] += de * de
            e[:, c] -= speed * de / np.sqrt(ge[:, c])
        dw, db = (means.T @ p).astype(np.float32), p.sum(axis=0).astype(np.float32)
        gw += dw * dw
        gb += db * db
        w -= speed * dw / np.sqrt(gw)
        b -= 0.3 * speed * db / np.sqrt(gb)
    # a text's margin is the best of its windows': a line through the log-odds of whole texts turns it into a probability
    best = np.full(len(bags), -np.inf)
    for part in np.array_split(np.arange(len(windows)), max(1, len(windows) // batch)):
        np.maximum.at(best, owner[part], forward(part)[6] @ (w[:, 1] - w[:, 0]))
    slope, shift = calibrated(best + float(b[1] - b[0]), np.array(labels), prior)
    weights = slope * (e @ (w[:, 1] - w[:, 0])).astype(np.float64)
    seen = np.zeros(BUCKETS, bool)
    seen[flat] = True
    return ToxicityModel(np.where(seen, weights, 0.0), slope * float(b[1] - b[0]) + shift)


def calibrated(margins: np.ndarray, labels: np.ndarray, prior: float, rounds: int = 30) -> tuple[float, float]:
    """Slope and shift of a logistic regression on margins, for a share ``prior`` of label 1; damped Newton steps."""
    ones = max(1, int(labels.sum()))
    zeros = max(1, len(labels) - ones)
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))  # never quite certain
    weight = np.where(labels == 1, prior / ones, (1 - prior) / zeros)
    x, fitted = np.stack([margins, np.ones(len(margins))], axis=1), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ fitted, -500, 500)))
        pull = x.T @ (weight * (target - p)) + 1e-4 * (np.array([1.0, 0.0]) - fitted)
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        fitted = fitted + np.clip(np.linalg.solve(bend, pull), -2, 2)
    return max(float(fitted[0]), 1e-3), float(fitted[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 3000) -> ToxicityModel:
    """Trains on at most ``per_class`` labelled rows of each class, those of the least hash of their id.

    The rows meet in one task: at most 2 * ``per_class`` whole texts, however large the tables are, so it
    needs the memory of that many texts and about 14 bytes for each different character n-gram of theirs. ``labels``
    holds the rows that may be learned from; the class shares are counted over all of it.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    shares = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(shares) < 2:
        return ToxicityModel(np.zeros(BUCKETS), -500.0)
    some = [known.where(F.col("y") == v).orderBy(F.xxhash64("id"), "id").limit(per_class) for v in (0, 1)]
    ids = F.broadcast(some[0].unionByName(some[1]))  # at most 2 * per_class rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(ids, "id").where("text is not null")
    prior = shares[1] / (shares[0] + shares[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = sorted(zip(*pa.Table.from_batches(list(batches), given).to_pydict().values(), strict=True))
        model = train([t for _, t, _ in pairs], [y for _, _, y in pairs], prior)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.astype(np.float64).tobytes()]), pa.array([model.bias])], ["weights", "bias"])

    sample = texts.select(F.col("id").cast("string").alias("id"), "text", F.col("y").cast("long").alias("y"))
    given = pa.schema([("id", pa.string()), ("text", pa.string()), ("y", pa.int64())])
    # one task trains on the sample, whose size is bounded, and only the weights come back
    found = sample.repartition(1).mapInArrow(run, "weights binary, bias double").first()
    if found is None:  # no text has a label
        return ToxicityModel(np.zeros(BUCKETS), -500.0)
    return ToxicityModel(np.frombuffer(bytes(found["weights"]), np.float64), found["bias"])


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted for every row; no shuffle."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))  # 256 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        here, words = ToxicityModel(weights, bias), WordScores(weights.tolist())
        for batch in batches:
            scores = np.fromiter(here.scores(batch.column(1).to_pylist(), words), np.float64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return narrow.mapInArrow(run, f"doc_id {dict(narrow.dtypes)['doc_id']}, score double, predicted int")


def without_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))  # 256 KB
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        here, words = ToxicityModel(weights, bias), WordScores(weights.tolist())
        for batch in batches:
            clean = [x < threshold for x in here.scores(batch.column(at).to_pylist(), words)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
