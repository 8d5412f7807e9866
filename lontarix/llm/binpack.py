"""Packed token matrices: best-fit decreasing with a segment tree over remaining capacities.

Each task tokenises its documents, cuts overlong ones without loss, and packs the pieces of a bounded window: longest first,
each into the open row whose remaining capacity is the smallest that holds it. A segment tree over the capacities 0 ..
``capacity`` finds it in logarithmic time. Full rows leave; the pieces of the others go on to the next window, unless they hold
more than half of it: then all rows leave, so that a window always has room. Gaps are thus left in a task's last window, and
in windows of which more than half would stay. The output has, for each row, the id matrix' row (padded), cumulative segment lengths, and
positions that start again at 0 in each segment.

Defined cases: a null or empty text is the end id alone. Repeated rows are packed each. An empty table gives no rows. Extra
columns are left out. A row's segments name their document, its row's number, piece and start, so documents can be put together
again whatever ids repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of
from .tokens import rank_bpe

#: Tokens that a task packs at a time.
WINDOW = 2 << 20


class CapacityTree:
    """Counts of open rows by remaining capacity; finds the smallest capacity of at least ``need`` that has a row."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, row: int, left: int) -> None:
        self.rows[left].append(row)
        self._change(left, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """A row and its remaining capacity, removed; None if no row has room."""
        if not need:
            return None
        # Climb until a subtree to the right has a row, then go down to its leftmost.
        count, node = self.count, need + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not count[node]:
                    node += 1
        left = node - self.leaves
        self._change(left, -1)
        return self.rows[left].pop(), left

    def _change(self, left: int, by: int) -> None:
        node = left + self.leaves
        while node:
            self.count[node] += by
            node >>= 1


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Rows of item numbers; ties in length keep the items' order."""
    tree, rows = CapacityTree(capacity), []
    size = lengths.tolist()
    for item in np.argsort(-lengths, kind="stable").tolist():
        n = size[item]
        if not 0 < n <= capacity:
            raise ValueError(f"an item of {n} does not fit {capacity}")
        found = tree.take(n)
        if found is None:
            found = len(rows), capacity
            rows.append([])
        row, left = found
        rows[row].append(item)
        if left > n:
            tree.add(row, left - n)
    return rows


def pack_matrix(docs: DataFrame, vocab: str = "byte_bpe_multi_50k", capacity: int = 2048, end_id: int = 50256, pad_id: int = 50256, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row a packed sequence.

    ``ids`` and ``positions``: little-endian unsigned 32-bit, ``capacity`` of each, padded with ``pad_id`` and 0.
    ``cu_seqlens``: 0 and the end of each segment. ``docs``, ``rows``, ``pieces``, ``starts``: the segments' origin. All pieces of a
    row are packed by one task, so the row's number means the same in all of them.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["n_tokens", "ids", "positions", "cu_seqlens", "docs", "rows", "pieces", "starts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = rank_bpe(vocab)
        # A piece: document, row, number, start, ids.
        pool: list[tuple] = []
        held = 0
        doc_type = None

        def emit(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal pool, held
            lengths = np.array([len(p[4]) for p in pool], np.int64)
            out, rest = [], []
            for row in best_fit_decreasing(lengths, capacity):
                (out if last or int(lengths[row].sum()) == capacity else rest).append(row)
            if not last and sum(int(lengths[r].sum()) for r in rest) > window // 2:
                out, rest = out + rest, []
            for a in range(0, len(out), 256):
                yield matrix([[pool[i] for i in row] for row in out[a : a + 256]])
            pool = [pool[i] for row in rest for i in row]
            held = sum(len(p[4]) for p in pool)

        def matrix(rows: list[list[tuple]]) -> pa.RecordBatch:
            made: dict[str, list] = {n: [] for n in names}
            for own in rows:
                ends = np.cumsum([len(p[4]) for p in own])
                ids, at = np.full(capacity, pad_id, "<u4"), np.zeros(capacity, "<u4")
                ids[: ends[-1]] = np.concatenate([p[4] for p in own])
                begins = np.concatenate([[0], ends[:-1]])
                at[: ends[-1]] = np.arange(ends[-1]) - np.repeat(begins, np.diff(np.append(begins, ends[-1])))
                for n, v in zip(names, (int(ends[-1]), ids.tobytes(), at.tobytes(), [0, *ends.tolist()], *([p[k] for p in own] for k in range(4))), strict=True):
                    made[n].append(v)
            types = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(doc_type), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(made[n], t) for n, t in zip(names, types, strict=True)], names)

        for batch in batches:
            doc_type = batch.schema.field(0).type
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = encode(text.as_py() or "")
                ids.append(end_id)
                whole = np.array(ids, "<u4")
                for k, a in enumerate(range(0, len(whole), capacity)):
                    pool.append((doc, row, k, a, whole[a : a + capacity]))
                held += len(whole)
                if held >= window:
                    yield from emit(False)
        if pool:
            yield from emit(True)

    schema = f"n_tokens long, ids binary, positions binary, cu_seqlens array<int>, docs array<{kind}>, rows array<long>, pieces array<int>, starts array<long>"
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(batches_of(run), schema)


def write_matrix(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet, each under a number of its own."""
    packed.select(F.monotonically_increasing_id().alias("sequence_id"), "*").write.option("compression", "zstd").parquet(path)


def unpack(packed: DataFrame) -> DataFrame:
    """(doc_id, row, ids): every row's ids again, put together from its segments."""
    one = packed.select("ids", "cu_seqlens", F.posexplode("docs").alias("n", "doc_id"), "rows", "starts")
    nth = F.col("n") + 1
    begin, stop = F.element_at("cu_seqlens", nth), F.element_at("cu_seqlens", nth + 1)
    part = F.struct(F.element_at("starts", nth).alias("start"), F.substring("ids", begin * 4 + 1, (stop - begin) * 4).alias("part"))
    parts = one.select("doc_id", F.element_at("rows", nth).alias("row"), part.alias("part")).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list("part")).alias("parts"))
    joined = F.unhex(F.concat_ws("", F.transform("parts", lambda p: F.hex(p["part"]))))
    return parts.select("doc_id", "row", joined.alias("ids"))
