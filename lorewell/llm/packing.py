"""Token ids packed into fixed-length rows by best-fit-decreasing, as binary columns.

Documents are tokenised with a public vocabulary; each ends with the end-of-text id. Longer ones
than a row are cut into pieces without losing a token. Every task packs the segments of its own
rows, some million tokens at a time: longest first, each into the fullest row that still has room.
A segment tree over free capacities finds that row in logarithmic time. Nothing is shuffled,
memory is bounded by the tokens held at a time, and a lost task is simply run again.

Rows of the result: ``input_ids`` and ``position_ids`` are little-endian matrices' rows
(uint16, or uint32 for larger vocabularies; positions uint32 only for rows over 65,536),
``cu_seqlens`` the cumulative segment lengths with 0 first, where positions start again at 0.

Defined results: null and empty texts have no tokens and no segment; repeated rows are packed
again; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-tokenisation pattern that belongs to the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class CapacityTree:
    """Open rows by free capacity; finds the least capacity of at least a given size."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, free: int, row: int) -> None:
        self.open[free].append(row)
        node = free + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(free, row) of the best fit, which is removed; None if no row has room."""
        node = size + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):  # up to the first full subtree on the right
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        free = node - self.leaves
        row = self.open[free].pop()
        while node:
            self.count[node] -= 1
            node >>= 1
        return free, row


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Rows of segment numbers; sizes are at most ``capacity``. Ties keep their order."""
    tree, rows = CapacityTree(capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = tree.take(sizes[i])
        free, row = found if found else (capacity, len(rows))
        if not found:
            rows.append([])
        rows[row].append(i)
        if free > sizes[i]:
            tree.put(free - sizes[i], row)
    return rows


def load_vocabulary(path: str) -> dict[bytes, int]:
    """Ranks of a byte-level vocabulary file: a base64 token and its id a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 50256, hold: int = 2_000_000) -> DataFrame:
    """Packed rows: pack_id, n_tokens, n_segments, doc_ids, pieces, cu_seqlens, input_ids, position_ids.

    ``vocabulary`` is a path on the driver. At most ``hold`` tokens and one document wait in a task.
    Padding after the last segment is ``end_id`` and belongs to no segment.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(narrow.dtypes)["doc_id"]
    ranks = load_vocabulary(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # the vocabulary: its size is fixed
    ids_type = np.dtype("<u2") if max(end_id, max(ranks.values(), default=0)) < 1 << 16 else np.dtype("<u4")
    place_type = np.dtype("<u2") if length <= 1 << 16 else np.dtype("<u4")

    def rows_of(held: list[tuple], first: int, ids_kind: pa.DataType) -> pa.RecordBatch:
        packed = best_fit_decreasing([len(x[2]) for x in held], length)
        order = [i for row in packed for i in row]
        lens = [np.array([0] + [len(held[i][2]) for i in row], np.int32) for row in packed]
        ids, places = np.full((len(packed), length), end_id, ids_type), np.zeros((len(packed), length), place_type)
        for r, row in enumerate(packed):
            at = 0
            for i in row:
                n = len(held[i][2])
                ids[r, at : at + n] = held[i][2]
                places[r, at : at + n] = np.arange(n)
                at += n
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(row) for row in packed])]), pa.int32())
        nested = lambda x, t: pa.ListArray.from_arrays(offsets, pa.array(x, t))
        sums = [np.cumsum(x, dtype=np.int32) for x in lens]
        part = TaskContext.get().partitionId()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([(part << 40) + first + r for r in range(len(packed))], pa.int64()),
                pa.array([int(x[-1]) for x in sums], pa.int32()),
                pa.array([len(row) for row in packed], pa.int32()),
                nested([held[i][0] for i in order], ids_kind),
                nested([held[i][1] for i in order], pa.int32()),
                pa.array(sums, pa.list_(pa.int32())),
                pa.array([x.tobytes() for x in ids], pa.binary()),
                pa.array([x.tobytes() for x in places], pa.binary()),
            ],
            ["pack_id", "n_tokens", "n_segments", "doc_ids", "pieces", "cu_seqlens", "input_ids", "position_ids"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        held, tokens, made, ids_kind = [], 0, 0, pa.int64()
        for batch in batches:
            ids_kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 256):  # so that few texts are in memory twice
                some = batch.slice(at, 256)
                for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    if not text:
                        continue
                    ids = np.array(encoding.encode_ordinary(text) + [end_id], ids_type)
                    for piece, start in enumerate(range(0, len(ids), length)):
                        held.append((doc, piece, ids[start : start + length]))
                    tokens += len(ids)
                    if tokens >= hold:
                        out = rows_of(held, made, ids_kind)
                        made, held, tokens = made + out.num_rows, [], 0
                        yield out
        if held:
            yield rows_of(held, made, ids_kind)

    return narrow.mapInArrow(
        run, f"pack_id long, n_tokens int, n_segments int, doc_ids array<{kind}>, pieces array<int>, cu_seqlens array<int>, input_ids binary, position_ids binary"
    )
