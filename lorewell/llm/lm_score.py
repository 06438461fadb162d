"""Masked pseudo-likelihood: every token predicted from both sides; the log-probabilities are summed.

All counts cover the whole corpus. The frequent words are output units of their own, all other words
share units by their last two letters; how many of both there are follows the number of different words.
A network reads the units of two words on either side (embeddings by position, one hidden layer), leaves
the word itself out, and predicts its unit by a softmax in two levels, a group of units and the unit within it:
log p(word | context) = log p(group | context) + log p(unit | group, context) + log p(word | unit). The last is the word's own
count over its unit's: tasks hold the most frequent words, and every other word meets the table of counts in a join.

Texts become rows of units once. Every position of every text is a target once: documents are dealt to
rounds and, by a hash of id and words, to tasks; in a round every task trains a copy of the network
in numpy, and copies are averaged by tokens with an aggregation that combines before its shuffle. The
number of tasks follows the number of tokens, so another layout of the files gives the same network.

Defined results: null texts and texts without words have 0 tokens, log-probability 0 and a null mean and
perplexity; repeated rows score the same; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm.scratch import Scratch

WORD = re.compile(r"[^\W_]+")
SIDES = (-2, -1, 1, 2)
#: positions that are scored at once
CHUNK = 1 << 14
#: characters of pieces that a task holds, about
CHARACTERS = 1 << 26
#: rows of which all units of a group are held at once, few enough for a core's cache
BLOCK = 1 << 9
#: tokens of which a task holds the units at once (a longer text is held whole)
HELD = 1 << 18
FAR = -30.0


@dataclass
class Units:
    """Output units, for the most frequent words log p(word | unit), and the tokens of each unit."""

    top: dict[str, int]
    classes: int
    inside: dict[str, float] = field(default_factory=dict)
    #: tokens of each unit
    tokens: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @property
    def size(self) -> int:
        return len(self.top) + self.classes

    def unit(self, word: str) -> int:
        own = self.top.get(word)
        return own if own is not None else len(self.top) + zlib.crc32(word[-2:].encode("utf-8", "replace")) % self.classes


class Lookup(dict):
    """Numbers of words seen; by number the word, its unit, log p(word | unit), and whether the word's count is still to be joined. Emptied between groups when full.

    For a word whose count is joined, the log of the count is still to be added.
    """

    def __init__(self, units: Units, limit: int = 300_000) -> None:
        super().__init__()
        self.units, self.limit = units, limit
        self.alone = -np.log(np.maximum(units.tokens, 1))
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.words, self.unit, self.inside, self.rare = np.zeros(0, object), np.zeros(0, np.int32), np.zeros(0), np.zeros(0, bool)

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        self.new.append(word)
        return i

    def settle(self) -> None:
        new, top = self.new, self.units.top
        unit = np.fromiter(map(self.units.unit, new), np.int32, len(new))
        known = np.fromiter(map(self.units.inside.get, new, repeat(np.nan)), float, len(new))
        known[unit < len(top)] = 0.0
        rare = np.isnan(known)
        known[rare] = self.alone[unit[rare]]
        words = np.empty(len(new), object)
        words[:] = new
        grown = (self.words, words), (self.unit, unit), (self.inside, known), (self.rare, rare)
        self.words, self.unit, self.inside, self.rare = map(np.concatenate, grown)
        self.new = []

    def trim(self) -> None:
        if len(self) > self.limit:
            self._empty()


class Network:
    """Bidirectional window network with a softmax over groups of units and one within each group; all parameters lie in one vector.

    Unit u is member u % ``per`` of group u // ``per``; a group has about twice the root of the number of units.
    """

    def __init__(self, size: int, width: int = 16, seed: int = 5) -> None:
        self.size, self.width = size, width
        self.per = ceil(2 * size**0.5)
        self.groups = -(-size // self.per)
        rng = np.random.default_rng(seed)
        # embeddings of a unit lie side by side; the last number of a weight is its bias
        shapes = [(size + 1, len(SIDES) * width), (width,), (self.groups, width + 1), (self.groups, self.per, width + 1)]
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        self.cuts = [(int(e - np.prod(s)), int(e), s) for e, s in zip(ends, shapes, strict=True)]
        self.vector = rng.normal(0, 0.1, ends[-1]).astype(np.float32)
        self.parts(self.vector)[1][:] = 0
        self.start(np.ones(size))

    def blocks(self, vector: np.ndarray) -> list[np.ndarray]:
        """Embeddings, their bias, and weights of groups and of units."""
        return [vector[a:b].reshape(s) for a, b, s in self.cuts]

    def parts(self, vector: np.ndarray) -> list[np.ndarray]:
        """Embeddings by side, their bias, and weights and biases of groups and of units."""
        e, b, w, v = self.blocks(vector)
        return [e.reshape(len(e), len(SIDES), self.width).transpose(1, 0, 2), b, w[:, :-1], w[:, -1], v[:, :, :-1], v[:, :, -1]]

    def start(self, tokens: np.ndarray) -> None:
        """Biases with which the network gives the share of each unit."""
        mass = np.concatenate([np.maximum(tokens, 0.5), np.zeros(self.groups * self.per - self.size)]).reshape(self.groups, self.per)
        parts = self.parts(self.vector)
        parts[3][:] = np.log(mass.sum(axis=1))
        with np.errstate(divide="ignore"):
            parts[5][:] = np.maximum(np.log(mass / mass.sum(axis=1, keepdims=True)), FAR)  # no unit there

    def hidden(self, context: np.ndarray) -> np.ndarray:
        """The hidden layer for each row, and a one that meets the biases."""
        e, b = self.blocks(self.vector)[:2]
        e, first = e.reshape(-1, self.width), context * len(SIDES)
        h = np.ones((len(context), self.width + 1), self.vector.dtype)
        total = b + e.take(first[:, 0], axis=0)
        for k in range(1, len(SIDES)):
            total += e.take(first[:, k] + k, axis=0)
        np.maximum(total, 0, out=h[:, :-1])
        return h

    def _by_group(self, target: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Each group among ascending targets, and where its rows begin and end, ``BLOCK`` at most."""
        edges = np.searchsorted(target, np.arange(self.groups + 1) * self.per).tolist()
        for g, (first, last) in enumerate(zip(edges, edges[1:], strict=False)):
            for a in range(first, last, BLOCK):
                yield g, a, min(a + BLOCK, last)

    def _softmax(self, h: np.ndarray, target: np.ndarray) -> Iterator[tuple]:
        """For rows in the order of their targets, by block: the group (None: the choice among groups), where the block begins and ends, exp(z - shift), its sum for each row, and the shift.

        Rows are shifted only where a sum would leave what floats hold. The next block overwrites the array.
        """
        _, _, w, v = self.blocks(self.vector)
        held = np.empty(BLOCK * max(self.groups, self.per), h.dtype)
        ones = np.ones(max(self.groups, self.per), h.dtype)
        for g, a, b in [*((None, a, min(a + BLOCK, len(h))) for a in range(0, len(h), BLOCK)), *self._by_group(target)]:
            weights = w if g is None else v[g]
            z = held[: (b - a) * len(weights)].reshape(b - a, len(weights))
            np.exp(np.matmul(h[a:b], weights.T, out=z), out=z)
            total, shift = z @ ones[: len(weights)], 0.0
            if not (total.min() > 1e-20 and total.max() < 1e20):
                np.matmul(h[a:b], weights.T, out=z)
                shift = z.max(axis=1)
                z -= shift[:, None]
                total = np.exp(z, out=z).sum(axis=1)
            yield g, a, b, z, total, shift

    def log_probs(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        _, _, w, v = self.blocks(self.vector)
        order = np.argsort(target)
        target = target[order]
        h = self.hidden(context[order])
        own = np.einsum("ij,ij->i", h, w.take(target // self.per, axis=0) + v.reshape(-1, self.width + 1).take(target, axis=0))
        with np.errstate(over="ignore"):
            for _, a, b, _, total, shift in self._softmax(h, target):
                own[a:b] -= np.log(total) + shift
        out = np.empty_like(own)
        out[order] = own
        return out

    def pulls(self, h: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | slice, np.ndarray]:
        """Gradient of the mean negative log-probability for rows in the order of their targets: of the sums below the hidden layer, of the weights of groups, and, for the groups that occur, of those of units."""
        _, _, w, v = self.blocks(self.vector)
        n, wide = len(target), self.width + 1
        # what the targets themselves do
        own, first = np.unique(target, return_index=True)
        sums = np.add.reduceat(h, first) / -n
        group = own // self.per
        some, begin = np.unique(group, return_index=True)
        gw, gv = np.zeros_like(w), np.zeros((len(some), *v.shape[1:]), v.dtype)
        gw[some] = np.add.reduceat(sums, begin)
        gv.reshape(-1, wide)[np.searchsorted(some, group) * self.per + own % self.per] = sums
        back = (w.take(target // self.per, axis=0) + v.reshape(-1, wide).take(target, axis=0)) / -n
        # and what all units do
        place = {g: i for i, g in enumerate(some.tolist())}
        with np.errstate(over="ignore"):
            for g, a, b, e, total, _ in self._softmax(h, target):
                weights, moved = (w, gw) if g is None else (v[g], gv[place[g]])
                share = (1 / (n * total))[:, None]
                moved += e.T @ (h[a:b] * share)
                back[a:b] += (e @ weights) * share
        return back[:, :-1] * (h[:, :-1] > 0), gw, slice(None) if len(some) == self.groups else some, gv

    def gradient(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of the mean negative log-probability."""
        out, order = np.zeros_like(self.vector), np.argsort(target)
        e, b, w, v = self.blocks(out)
        back, w[:], some, moved = self.pulls(self.hidden(context[order]), target[order])
        v[some], b[:] = moved, back.sum(axis=0)
        for k in range(len(SIDES)):
            np.add.at(self.parts(out)[0][k], context[order, k], back)
        return out

    def descend(self, past: np.ndarray, row: np.ndarray, at: np.ndarray, rate: float) -> None:
        """A step for the places ``at`` of a row of units; ``past``: squares of all gradients so far."""
        at = at[np.argsort(row[at])]
        target = row[at]
        back, gw, some, gv = self.pulls(self.hidden(row[at[:, None] + np.array(SIDES)]), target)
        by_place, moved = np.zeros((len(row), self.width), back.dtype), np.zeros((len(row), len(SIDES), self.width), back.dtype)
        by_place[at] = back
        for k, s in enumerate(SIDES):  # a unit moves by what its neighbour at that side asks for
            moved[max(s, 0) : len(row) + min(s, 0), k] = by_place[max(-s, 0) : len(row) - max(s, 0)]
        ids, ge = _by_row(row, moved.reshape(len(row), -1))
        every = slice(None)
        steps = [(ids, ge), (every, back.sum(axis=0)), (every, gw), (some, gv)]
        for block, old, (rows, g) in zip(self.blocks(self.vector), self.blocks(past), steps, strict=True):
            squares = old[rows]  # of all rows a view
            squares += g * g
            old[rows] = squares
            g *= rate
            g /= np.sqrt(squares)
            block[rows] -= g


def _by_row(ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different ids, and the sums of their values."""
    order = np.argsort(ids)
    some, first = np.unique(ids.take(order), return_index=True)
    return some, np.add.reduceat(values.take(order, axis=0), first)


class Windows:
    """Units of texts that lie one after another, with two marks for what is outside around each."""

    def __init__(self, units: np.ndarray, lengths: np.ndarray, outside: int) -> None:
        self.at = np.arange(len(units)) + 2 * (np.repeat(np.arange(len(lengths)), lengths) + 1)
        self.row = np.full(len(units) + 2 * (len(lengths) + 1), outside, np.int32)
        self.row[self.at] = units

    def chunks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Units at the four places around every token, and its own."""
        for i in range(0, len(self.at), CHUNK):
            at = self.at[i : i + CHUNK]
            yield np.stack([self.row[at + s] for s in SIDES], axis=1), self.row[at]

    def stretches(self, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pieces of the row with ``size`` tokens and what is around them, and where these tokens lie."""
        for i in range(0, len(self.at), size):
            at = self.at[i : i + size]
            yield self.row[at[0] - 2 : at[-1] + 3], at - (at[0] - 2)


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: every word of every text (column text), cut as the model cuts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, taken = Counter(), 0  # pieces between spaces: a word never goes across one
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for text in batch.column(0).slice(at, 256).to_pylist():
                    seen.update(text.lower().split() if text else ())
                    taken += len(text or "")
                if len(seen) > 300_000 or taken > CHARACTERS:
                    yield from _counted(seen)
                    seen, taken = Counter(), 0
        yield from _counted(seen)

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _counted(seen: Counter) -> Iterator[pa.RecordBatch]:
    """Words of the pieces, with their counts."""
    cut: dict[str, int] = {}
    for piece, k in seen.items():
        for word in WORD.findall(piece):
            cut[word] = cut.get(word, 0) + k
    words, n = list(cut), list(cut.values())
    for at in range(0, len(words), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 50_000], pa.string()), pa.array(n[at : at + 50_000], pa.int64())], ["word", "n"])


def corpus_units(docs: DataFrame, top: int = 64, classes: int = 32, vocabulary: int = 20_000) -> tuple[Units, DataFrame]:
    """Units, and the count of every word of every text (column text) as a table.

    Eight times the root of the number of different words are units of their own, twice the root is the
    number of classes; ``top`` and ``classes`` are the least. The driver gets ``vocabulary`` words (or one a unit) and a row per unit.
    """
    counts = Scratch(docs.sparkSession, "words").keep(word_counts(docs), "counts")
    root = counts.count() ** 0.5
    top, classes = max(top, ceil(8 * root)), max(classes, ceil(2 * root))
    best = [(r["word"], r["n"]) for r in counts.orderBy(F.desc("n"), "word").limit(max(vocabulary, top)).collect()]
    units = Units({w: i for i, (w, _) in enumerate(best[:top])}, classes)
    spread = F.crc32(F.substring("word", -2, 2).cast("binary")) % classes
    per = counts.groupBy(spread.alias("c")).agg(F.sum("n").alias("n")).collect()
    own = len(units.top)
    units.tokens = np.zeros(units.size)
    for r in per:
        units.tokens[own + r["c"]] = r["n"]
    for i, (w, n) in enumerate(best[:top]):
        units.tokens[i] = n
        units.tokens[own + zlib.crc32(w[-2:].encode("utf-8", "replace")) % classes] -= n
    units.inside = {w: float(np.log(n / units.tokens[units.unit(w)])) for w, n in best[top:]}
    return units, counts


def encoded(docs: DataFrame, units: Units) -> DataFrame:
    """doc_id, units of the text's words in order, inside (sum of log p(word | unit)), and the words whose counts are to be joined."""
    shared = docs.sparkSession.sparkContext.broadcast(units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                texts = [WORD.findall(t.lower()) if t else [] for t in some.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, texts)])
                numbers = np.fromiter(map(lookup.__getitem__, chain.from_iterable(texts)), np.int64, ends[-1])
                lookup.settle()
                rare = lookup.rare[numbers]
                logs = lookup.inside[numbers]
                inside = [float(logs[a:b].sum()) for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
                rare_ends = np.concatenate([[0], np.cumsum(rare)])[ends]
                units_of = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(lookup.unit[numbers]))
                others = pa.ListArray.from_arrays(pa.array(rare_ends, pa.int32()), pa.array(lookup.words[numbers[rare]], pa.string()))
                columns = [some.column(0), units_of, pa.array(inside, pa.float64()), others]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "units", "inside", "rare"])
                lookup.trim()

    narrow = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {dict(narrow.dtypes)['doc_id']}, units array<int>, inside double, rare array<string>")


def _groups(column: pa.ListArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows a to b of a column of units, of about ``HELD`` tokens together, their units and lengths."""
    lengths = np.diff(column.offsets.to_numpy())
    cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // HELD, prepend=0)) if len(lengths) else []
    edges = sorted({0, *(int(c) + 1 for c in cuts), len(lengths)})
    values, first = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for a, b in zip(edges, edges[1:], strict=False):
        yield a, b, values[first[a] : first[b]], lengths[a:b]


def train(texts: DataFrame, units: Units, rounds: int = 2, rate: float = 0.1, batch: int = 8192, per_task: int = 4_000_000) -> Network:
    """Trains on every position of ``texts`` (doc_id, units) once, in ``rounds`` of training in every task and averaging.

    ``per_task``: tokens a task trains on in a round, about.
    """
    net = Network(units.size)
    net.start(units.tokens)
    parts = max(1, ceil(float(units.tokens.sum()) / rounds / per_task))
    keyed = texts.select(F.xxhash64("doc_id", "units").alias("key"), "units").where(F.size("units") > 0)
    for turn in range(rounds):
        shared = texts.sparkSession.sparkContext.broadcast(net)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = Network(shared.value.size)
            own.vector[:] = shared.value.vector
            past, seen = np.full_like(own.vector, 1e-6), 0
            for some in batches:
                for _, _, u, lengths in _groups(some.column(0)):
                    for row, at in Windows(u, lengths, own.size).stretches(batch):
                        own.descend(past, row, at, rate)
                    seen += len(u)
            if seen:
                rows = _rows(own.vector, own.width)
                columns = [pa.array(np.full(len(rows), seen), pa.int64()), pa.array(np.arange(len(rows)), pa.int64()), *[pa.array(x) for x in np.ascontiguousarray(rows.T)]]
                yield pa.RecordBatch.from_arrays(columns, ["n", "i", *names])

        names = [f"x{j}" for j in range(net.width)]
        dealt = keyed.where(F.pmod("key", F.lit(rounds)) == turn).repartition(parts, "key")
        # as many copies as ``per_task`` asks for, even where a cluster shuffles into more parts
        dealt = dealt.coalesce(parts).sortWithinPartitions("key").select("units")
        copies = dealt.mapInArrow(run, f"n long, i long, {', '.join(f'{x} float' for x in names)}")
        mean = copies.groupBy("i").agg(*[(F.sum(F.col("n") * F.col(x)) / F.sum("n")).alias(x) for x in names])
        rows = _rows(net.vector, net.width)
        for r in mean.collect():  # a row per unit and side
            rows[r["i"]] = r[1:]
        net.vector[:] = rows.reshape(-1)[: len(net.vector)]
        shared.unpersist()
    return net


def _rows(vector: np.ndarray, width: int) -> np.ndarray:
    return np.concatenate([vector, np.zeros(-len(vector) % width, vector.dtype)]).reshape(-1, width)


def score(texts: DataFrame, net: Network, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_prob, mean_log_prob and perplexity of every text of ``texts`` (row, doc_id, units, inside, rare).

    Words that tasks do not hold are joined with ``counts``; one that was not counted is taken to occur once.
    """
    shared = texts.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for some in batches:
            sums, sizes = [np.empty(0)], [np.empty(0, np.int64)]
            for _, _, u, lengths in _groups(some.column(2)):
                logs = [net.log_probs(x, y) for x, y in Windows(u, lengths, net.size).chunks()]
                totals = np.concatenate([[0.0], np.cumsum(np.concatenate([[], *logs]), dtype=np.float64)])
                ends = np.cumsum(lengths)
                sums.append(totals[ends] - totals[ends - lengths])
                sizes.append(lengths)
            logs = np.concatenate(sums) + some.column(3).to_numpy(zero_copy_only=False)
            columns = [some.column(0), some.column(1), pa.array(np.concatenate(sizes), pa.int64()), pa.array(logs, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_tokens", "log_prob"])

    kind = dict(texts.dtypes)["doc_id"]
    rows = texts.select("row", "doc_id", "units", "inside").mapInArrow(run, f"row long, doc_id {kind}, n_tokens long, log_prob double")
    inside = texts.select("row", F.explode("rare").alias("word")).join(counts.select("word", F.log("n").alias("log_prob")), "word", "left")
    inside = inside.select("row", F.lit(None).cast(kind).alias("doc_id"), F.lit(0).cast("long").alias("n_tokens"), F.coalesce("log_prob", F.lit(0.0)).alias("log_prob"))
    both = rows.unionByName(inside).groupBy("row")
    out = both.agg(F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("log_prob").alias("log_prob")).drop("row")
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
    return out.withColumns({"mean_log_prob": mean, "perplexity": F.exp(-mean)})


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2) -> DataFrame:
    """Counts, trains and scores over all of ``docs``."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    units, counts = corpus_units(narrow)
    texts = encoded(narrow, units).withColumn("row", F.monotonically_increasing_id())
    texts = Scratch(docs.sparkSession, "encoded").keep(texts, "texts")
    return score(texts, train(texts, units, rounds), counts)
