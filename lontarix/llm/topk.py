"""Exact top-k inner products over a bit-sliced index.

Components are integers, ``floor(scale * x)``. A block of the index holds, for each component, one bitmap a bit: bit r of
slice b says whether row r has that bit of its value. Only the ``slices`` most significant bits are kept as bitmaps. For a
query, slices are multiplied by its weights (signed-digit shifts) and added with carry-save bitmap arithmetic, which gives
the coarse score of all rows at once as slices again. Selection goes from the most significant slice of that sum downward
to the k-th largest coarse score; every row whose coarse score could still reach it, given what the bits left out can add,
is a boundary row and is resolved with exact integers.

The index is built once, a row for each block of rows, and written to the shared folder. Its blocks and blocks of queries then
meet in a grid of bounded tasks: a cell holds at most about ``row_block`` rows and ``query_block`` queries. Each gives its best k
a query, and those are merged with partial aggregation.

Vectors with a component of ``LIMIT`` or more in size (or of more than ``WIDEST`` components) can't be scored in 64 bits. They stay
outside the slices, and their scores are exact integers of any size, one pair at a time.

Defined cases: a null vector, or one with a null, NaN or infinite component or another length than the query's, takes no part.
A null id takes no part. Every query row is a query of its own, also where ids repeat. Rows with the same id are no candidates of
a query of that id; otherwise repeated rows are candidates each. Ties go to the smaller id. With fewer candidates than k, all are
returned. Scores beyond 64 bits are ranked exactly and returned as the nearest 64-bit number. Extra columns are left out; empty
tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, working

LIMIT, WIDEST = 1 << 25, 4096
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def takes_part(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def quantised(vector: Column, scale: float) -> Column:
    """Integers floor(scale * x), or null where a component is too large for them."""
    small = F.forall(vector, lambda x: F.abs(F.lit(scale) * x.cast("double")) < LIMIT) & (F.size(vector) <= WIDEST)
    return F.when(small, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("int")))


def exact(vector: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as Python integers, which have no upper end."""
    near = [scale * x for x in vector.tolist()]
    return np.array([math.floor(y) if abs(y) < 1 << 52 else math.floor(Fraction(x) * Fraction(scale)) for x, y in zip(vector.tolist(), near, strict=True)], object)


class SlicedBlock:
    """Slices of up to some 10,000 rows; ``values`` (rows, components) are the exact integers."""

    def __init__(self, values: np.ndarray, slices: int = 6) -> None:
        self.values = values
        u = (values - values.min(0)).astype(np.int64)
        wide = max(1, int(u.max()).bit_length())
        self.shift = max(0, wide - slices)
        self.bits = wide - self.shift
        pad = -len(u) % 64
        u = np.pad(u >> self.shift, ((0, pad), (0, 0)))
        self.words = len(u) // 64
        planes = np.stack([(u >> b & 1).astype(np.uint8) for b in range(self.bits)])
        packed = np.packbits(planes.transpose(2, 0, 1), axis=2, bitorder="little")
        self.slices = np.ascontiguousarray(packed).view(np.uint64)  # component, bit, word
        self.valid = np.packbits(np.arange(len(u)) < len(values), bitorder="little").view(np.uint64)

    def dump(self) -> dict[str, object]:
        return {"shift": self.shift, "bits": self.bits, "values": self.values.astype(np.int32).tobytes(), "slices": self.slices.tobytes(), "valid": self.valid.tobytes()}

    @classmethod
    def load(cls, row: dict, size: int) -> SlicedBlock:
        made = cls.__new__(cls)
        made.shift, made.bits = int(row["shift"]), int(row["bits"])
        made.values = np.frombuffer(row["values"], np.int32).reshape(-1, size)
        made.valid = np.frombuffer(row["valid"], np.uint64)
        made.words = len(made.valid)
        made.slices = np.frombuffer(row["slices"], np.uint64).reshape(size, made.bits, made.words)
        return made

    @staticmethod
    def _digits(w: int) -> list[tuple[int, bool]]:
        """Signed binary digits of w > 0: (power, negative), no two neighbours set."""
        out, p = [], 0
        while w:
            if w & 1:
                minus = w & 3 == 3
                out.append((p, minus))
                w += 1 if minus else -1
            w >>= 1
            p += 1
        return out

    def coarse(self, query: np.ndarray) -> tuple[list[np.ndarray], int, int]:
        """Slices of T, a constant, and a bound E: (T + constant) << shift <= score - query.low <= that + E."""
        levels: dict[int, list[tuple[int, int, bool]]] = {}
        constant = 0
        top = (1 << self.bits) - 1
        for j, q in enumerate(query.tolist()):
            for p, minus in self._digits(abs(q)):
                flip = minus != (q < 0)
                for b in range(self.bits):
                    levels.setdefault(p + b, []).append((j, b, flip))
                # A negative digit takes the complement: -x = (top - x) - top.
                constant -= (top << p) if flip else 0
        out: list[np.ndarray] = []
        carry = np.zeros((0, self.words), np.uint64)
        level = 0
        while levels or len(carry):
            own = levels.pop(level, [])
            parts = [carry]
            for want in (False, True):
                at = [(j, b) for j, b, flip in own if flip == want]
                if at:
                    x = self.slices[[j for j, _ in at], [b for _, b in at]]
                    parts.append(~x if want else x)
            x = np.concatenate(parts)
            up = []
            while len(x) > 1:
                n = len(x) // 3
                if n:
                    a, b, c = x[:n], x[n : 2 * n], x[2 * n : 3 * n]
                    half = a ^ b
                    up.append((a & b) | (half & c))
                    x = np.concatenate([half ^ c, x[3 * n :]])
                else:
                    up.append(x[:1] & x[1:])
                    x = x[:1] ^ x[1:]
            out.append(x[0] if len(x) else np.zeros(self.words, np.uint64))
            carry = np.concatenate(up) if up else np.zeros((0, self.words), np.uint64)
            level += 1
        most = int((1 << self.shift) - 1)
        plus = int(query[query > 0].sum()) * most
        minus = int(query[query < 0].sum()) * most
        return out, constant, plus - minus

    def top(self, query: np.ndarray, k: int, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers that may be among the k best (all k best are), and their exact scores. ``skip``: rows left out."""
        planes, _, error = self.coarse(query)
        allowed = self.valid.copy()
        for r in skip:
            allowed[r >> 6] &= ~np.uint64(1 << int(r & 63))
        # Coarse scores of rows differ from exact ones by less than ``error`` after the shift.
        slack = -(-error >> self.shift) if self.shift else 0
        equal, above, value = allowed, np.zeros_like(allowed), 0
        for b in range(len(planes) - 1, -1, -1):
            more = equal & planes[b]
            if int(np.bitwise_count(above | more).sum()) >= k:
                equal, value = more, value | 1 << b
            else:
                above, equal = above | more, equal & ~planes[b]
        floor = max(0, value - slack)
        rows = np.flatnonzero(np.unpackbits(self._at_least(planes, floor, allowed).view(np.uint8), bitorder="little"))
        return rows, self.values[rows].astype(np.int64) @ query.astype(np.int64)

    @staticmethod
    def _at_least(planes: list[np.ndarray], value: int, allowed: np.ndarray) -> np.ndarray:
        above, equal = np.zeros_like(allowed), allowed
        for b in range(len(planes) - 1, -1, -1):
            if value >> b & 1:
                equal = equal & planes[b]
            else:
                above, equal = above | (equal & planes[b]), equal & ~planes[b]
        return above | equal


_INDEX = "rg int, size int, ids binary, shift int, bits int, values binary, slices binary, valid binary, wide_ids binary, wide binary"


def index(table: DataFrame, slices: int) -> DataFrame:
    """A row for each block and length of vectors: ids and slices, and the ids and components of vectors outside the slices. ``table``: (rg, id, v, w)."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        sizes = part["w"].map(len).to_numpy()
        out = []
        for size in np.unique(sizes[sizes > 0]):
            own = part[sizes == size]
            fits = own["v"].notna()
            near, wide = own[fits], own[~fits]
            row = SlicedBlock(np.stack(near["v"].to_numpy()).astype(np.int64), slices).dump() if len(near) else {"shift": 0, "bits": 0, "values": b"", "slices": b"", "valid": b""}
            far = np.stack(wide["w"].to_numpy()).astype(np.float64).tobytes() if len(wide) else b""
            out.append({"rg": part["rg"].iloc[0], "size": size, "ids": near["id"].to_numpy(np.int64).tobytes(), **row, "wide_ids": wide["id"].to_numpy(np.int64).tobytes(), "wide": far})
        return pd.DataFrame(out, columns=[c.split()[0] for c in _INDEX.split(", ")])

    return table.groupBy("rg").applyInPandas(build, _INDEX)


class _Block:
    """A row of the index, opened: sliced rows, and wide rows as exact integers."""

    def __init__(self, row: dict, scale: float) -> None:
        size = int(row["size"])
        self.ids, self.wide_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["wide_ids"], np.int64)
        self.order = np.argsort(self.ids, kind="stable")
        self.block = SlicedBlock.load(row, size) if len(self.ids) else None
        self.wide = [exact(x, scale) for x in np.frombuffer(row["wide"], np.float64).reshape(-1, size)]
        self.scale = scale

    def best(self, query_id: int, v: np.ndarray | None, w: np.ndarray, k: int) -> Iterator[tuple[int, int]]:
        """(id, score) of the k best rows."""
        found: list[tuple[int, int]] = []
        q = exact(w, self.scale) if v is None or self.wide else None
        if self.block is not None and v is not None:
            a, b = np.searchsorted(self.ids, [query_id, query_id + 1], sorter=self.order)
            at, score = self.block.top(np.asarray(v, np.int64), k, self.order[a:b])
            ids = self.ids[at]
            first = np.lexsort((ids, -score))[:k]
            found = list(zip(ids[first].tolist(), score[first].tolist(), strict=True))
        elif self.block is not None:
            found = [(i, int(x @ q)) for i, x in zip(self.ids.tolist(), self.block.values.astype(object), strict=True) if i != query_id]
        found += [(i, int(x @ q)) for i, x in zip(self.wide_ids.tolist(), self.wide, strict=True) if i != query_id]
        return iter(sorted(found, key=lambda x: (-x[1], x[0]))[:k])


def _beyond(score: int) -> str:
    """For scores that 64 bits don't hold: text that sorts like them among those cut to the same number. Doubles give less than 2 ** 2200."""
    return f"{score + (1 << 2200):0551x}" if score <= _LEAST or score >= _MOST else ""


def top_k(
    rows: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    row_block: int = 8192,
    query_block: int = 4096,
    slices: int = 6,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows for every row for which ``is_query`` holds."""
    v = F.col(vector_col)
    ints = rows.select(F.col(id_col).cast("long").alias("id"), quantised(v, scale).alias("v"), v.cast("array<double>").alias("w"), F.coalesce(is_query, F.lit(False)).alias("q"), takes_part(v).alias("ok"))
    with working(rows.sparkSession):
        # Numbers are written with the rows: all copies of a row below must go by the same one.
        table = cut(ints.where("id IS NOT NULL AND ok").drop("ok").withColumn("number", F.monotonically_increasing_id()), "vectors")
        n, n_queries = table.agg(F.count("*"), F.count_if("q")).first()
        row_groups, query_groups = max(1, -(-n // row_block)), max(1, -(-n_queries // query_block))
        # Blocks are dealt by running number, not by a value: no key of the data can make one block large.
        number = F.col("number")
        blocks = cut(index(table.select(F.pmod(F.xxhash64(number), F.lit(row_groups)).cast("int").alias("rg"), "id", "v", "w"), slices), "sliced-index", keep=True)
        asked = cut(table.where("q").select("number", "id", "v", "w", F.pmod(F.xxhash64(number, F.lit(1)), F.lit(query_groups)).cast("int").alias("qg")), "queries", keep=True)

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int, int, str]] = []
        sizes = right["w"].map(len).to_numpy() if len(right) else np.zeros(0, int)
        for row in left.to_dict("records"):
            mine = right[sizes == row["size"]]
            block = _Block(row, scale) if len(mine) else None
            for at, qid, v, w in zip(mine["number"].tolist(), mine["id"].tolist(), mine["v"], mine["w"], strict=True):
                for i, score in block.best(qid, v, w, k):
                    found.append((at, qid, i, min(max(score, _LEAST), _MOST), _beyond(score)))
        return pd.DataFrame(found, columns=["number", "query_id", "vec_id", "score", "beyond"]).astype({c: "int64" for c in ("number", "query_id", "vec_id", "score")})

    cells = blocks.withColumn("qg", F.explode(F.sequence(F.lit(0), F.lit(query_groups - 1))))
    asked = asked.withColumn("rg", F.explode(F.sequence(F.lit(0), F.lit(row_groups - 1))))
    near = cells.groupBy("rg", "qg").cogroup(asked.groupBy("rg", "qg")).applyInPandas(search, "number long, query_id long, vec_id long, score long, beyond string")
    rank = F.expr("row_number() OVER (PARTITION BY number ORDER BY score DESC, beyond DESC, vec_id)")
    return near.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
