"""Best-fit packing by exact-complement hashing.

Documents become token sequences closed by an end id; longer ones than a sequence are cut into full pieces, the first of
which may be shorter. The packing is solved on the histogram of piece lengths, which has at most ``capacity`` entries
however many pieces there are: an index of the sums that one, two or three available lengths can make finds combinations
that exactly fill the gap beside the longest open piece; each is consumed as often as the counts allow. Where nothing fits
exactly, the longest length that fits is added (best fit) and the smaller gap is looked up again. Pieces then take the
places of their length in order of rank, which is computed with salted windows, so a length that a third of all pieces
share is spread over many tasks.

Defined cases: a null text is an empty document, that is the end id alone. Repeated rows are packed as documents of their
own. An empty table gives no rows. Extra columns are left out by ``tokenize_pieces`` and kept by ``place``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, cut
from .tokens import byte_bpe


def tokenize_pieces(docs: DataFrame, vocab: str = "byte_bpe_50k", capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document: id, ``piece``, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(vocab)
        for batch in batches:
            rows, piece, start, length, data, held = [], [], [], [], [], 0
            for n, text in enumerate(batch.column(1)):
                ids = encode(text.as_py() or "")
                ids.append(end_id)
                raw = np.array(ids, "<u4").tobytes()
                size = len(ids)
                cuts = [0, *range(size % capacity or capacity, size, capacity), size] if size > capacity else [0, size]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    rows.append(n)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    data.append(raw[4 * a : 4 * b])
                held += 4 * size
                if held > 16 << 20:
                    yield made(batch, rows, piece, start, length, data)
                    rows, piece, start, length, data, held = [], [], [], [], [], 0
            yield made(batch, rows, piece, start, length, data)

    def made(batch: pa.RecordBatch, rows: list, piece: list, start: list, length: list, data: list) -> pa.RecordBatch:
        own = batch.column(0).take(pa.array(rows, pa.int64()))
        return pa.RecordBatch.from_arrays([own, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(data, pa.binary())], [id_col, "piece", "start", "length", "ids"])

    return docs.select(id_col, text_col).mapInArrow(batches_of(run), f"`{id_col}` {kind}, piece int, start long, length long, ids binary")


class _Sums:
    """Which sums one, two and three available lengths make: sets of bits, and the lengths that make a sum."""

    def __init__(self, counts: np.ndarray, capacity: int) -> None:
        self.counts, self.capacity, self.mask = counts, capacity, (1 << (capacity + 1)) - 1
        self.refresh()

    def refresh(self) -> None:
        self.lengths = np.flatnonzero(self.counts).tolist()
        self.one = sum(1 << x for x in self.lengths)
        self.two = self.three = 0
        for x in self.lengths:
            self.two |= self.one << x
        self.two &= self.mask
        for x in self.lengths:
            self.three |= self.two << x
        self.three &= self.mask

    def exact(self, gap: int, used: dict[int, int]) -> list[int] | None:
        """One to three available lengths, longest first, that sum to ``gap`` beside those in ``used``."""

        def free(*take: int) -> bool:
            return all(self.counts[x] - used.get(x, 0) >= take.count(x) for x in take)

        if self.one >> gap & 1 and free(gap):
            return [gap]
        if self.two >> gap & 1:
            for a in range(gap - 1, (gap - 1) // 2, -1):
                if self.one >> a & 1 and self.one >> (gap - a) & 1 and free(a, gap - a):
                    return [a, gap - a]
        if self.three >> gap & 1:
            for a in range(gap - 2, (gap - 1) // 3, -1):
                if self.one >> a & 1 and self.two >> (gap - a) & 1:
                    rest = gap - a
                    for b in range(min(a, rest - 1), (rest - 1) // 2, -1):
                        if self.one >> b & 1 and self.one >> (rest - b) & 1 and free(a, b, rest - b):
                            return [a, b, rest - b]
        return None

    def longest(self, gap: int, used: dict[int, int]) -> int:
        bits = self.one & ((1 << (gap + 1)) - 1)
        while bits:
            x = bits.bit_length() - 1
            if self.counts[x] - used.get(x, 0) > 0:
                return x
            bits ^= 1 << x
        return 0


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths of one sequence) and how many sequences have each. Every length is used as often as it occurs."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit {capacity}")
        counts[length] += n
    sums, out = _Sums(counts, capacity), []
    top = capacity
    while True:
        while top and not counts[top]:
            top -= 1
        if not top:
            return out
        pattern, gap, used = [top], capacity - top, {top: 1}
        while gap:
            more = sums.exact(gap, used) or [x for x in [sums.longest(gap, used)] if x]
            if not more:
                break
            for x in more:
                pattern.append(x)
                used[x] = used.get(x, 0) + 1
                gap -= x
        times = int(min(counts[x] // n for x, n in used.items()))
        for x, n in used.items():
            counts[x] -= n * times
        if any(not counts[x] for x in used):
            sums.refresh()
        out.append((pattern, times))


class _Places:
    """Where the piece of a given length and rank goes: ranges of ranks, searched by halving."""

    def __init__(self, patterns: list[tuple[list[int], int]]) -> None:
        taken: dict[int, int] = {}
        key, rows, base = [], [], 0
        for pattern, times in patterns:
            at = 0
            for x in dict.fromkeys(pattern):
                n = pattern.count(x)
                key.append((x, taken.get(x, 0)))
                rows.append((n, base, at, taken.get(x, 0)))
                taken[x] = taken.get(x, 0) + n * times
                at += n * x
            base += times
        order = sorted(range(len(key)), key=key.__getitem__)
        self.length = np.array([key[i][0] for i in order], np.int64)
        self.start = np.array([key[i][1] for i in order], np.int64)
        self.n, self.base, self.at, self.first = (np.array([rows[i][k] for i in order], np.int64) for k in range(4))
        self.begin = {int(x): int(i) for x, i in zip(*np.unique(self.length, return_index=True), strict=True)}
        self.sequences = base

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for x in np.unique(length):
            mine = np.flatnonzero(length == x)
            a = self.begin[int(x)]
            b = int(np.searchsorted(self.length, x, "right"))
            i = a + np.searchsorted(self.start[a:b], rank[mine], "right") - 1
            k = rank[mine] - self.first[i]
            sequence[mine] = self.base[i] + k // self.n[i]
            offset[mine] = self.at[i] + k % self.n[i] * x
        return sequence, offset


def place(pieces: DataFrame, capacity: int = 2048, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` (with ``length``) with ``sequence_id`` and ``offset``; other columns pass through.

    Pieces are first written to the shared folder, so counts and ranks come from the same rows even if executors are lost.
    """
    table = cut(pieces, "pieces")
    histogram = {r["length"]: r["count"] for r in table.groupBy("length").count().collect()}
    where = _Places(plan(histogram, capacity))
    salts = max(1, int(sum(histogram.values()) ** 0.5))
    salted = table.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    counts = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = F.expr("sum(__n) OVER (PARTITION BY length ORDER BY __salt) - __n")
    starts = counts.select("length", "__salt", before.alias("__before"))
    rank = F.expr(f"row_number() OVER (PARTITION BY length, __salt ORDER BY {', '.join(order)})")
    ranked = salted.withColumn("__rank", rank).join(starts, ["length", "__salt"])
    ranked = ranked.withColumn("__rank", F.col("__rank") - 1 + F.col("__before")).drop("__before", "__salt")
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    ranked = ranked.select(*(F.col(f"`{c}`") for c in kept), "__rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "__rank"))
            sequence, offset = where.find(length, rank)
            own = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    fields = {f.name: f.dataType.simpleString() for f in pieces.schema.fields}
    return ranked.mapInArrow(batches_of(run), ", ".join(f"`{c}` {fields[c]}" for c in kept) + ", sequence_id long, offset long")


def pack(docs: DataFrame, vocab: str = "byte_bpe_50k", capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of ``docs`` with their ids and their places."""
    return place(tokenize_pieces(docs, vocab, capacity, end_id, id_col, text_col), capacity, (id_col, "piece"))
