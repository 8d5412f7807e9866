"""Reversible line dedup: sharded cuckoo filters in front of exact reference-count tables.

State is two tables in the shared folder: ``refs`` (128-bit key hash, number of documents that hold the line) and
``filters`` (one cuckoo filter a shard, of the keys found in at least ``min_docs`` documents). ``insert`` adds the
documents of a batch, ``delete`` takes documents away again; counts are exact, so deleting what was inserted restores the
former state. ``apply`` asks the filters first and lets the exact table confirm what they report.

Defined cases: a null or empty text is one empty line. Each row counts as a document, repeated rows as several. A line
counts once a document however often it repeats there. Empty keys are never dropped. Extra columns of the input pass
through ``apply``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_arrow, numbered, slices, utf8, working
from .cuckoo import CuckooFilter
from .words import LOWER, words

#: Keys that are asked of a filter at a time, on average.
PART_KEYS = 1 << 18
#: Keys a filter shard holds on average.
SHARD_KEYS = 1 << 15


def line_keys(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[list[int], list[bytes]]]:
    """For each text its line ends (byte positions) and each line's 16-byte key hash, b"" for a line without a key."""
    starts, ends, _ = words(buf, off)
    low = LOWER[buf].tobytes()
    breaks = np.flatnonzero(buf == 10)
    cuts = np.searchsorted(breaks, off)
    for i in range(len(off) - 1):
        stop = np.append(breaks[cuts[i] : cuts[i + 1]], off[i + 1])
        begin = np.append(off[i], stop[:-1] + 1)
        a, b = np.searchsorted(starts, begin), np.searchsorted(starts, stop) - 1
        keys = [xxhash.xxh3_128_digest(low[starts[x] : ends[y]]) if x <= y else b"" for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        yield stop.tolist(), keys


def _longs(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    two = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return two[:, 0], two[:, 1]


def count_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, g, refs): in how many documents each key is. Summed within a batch before anything is shuffled."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        buf, off = utf8(batch.column(0))
        for i, j in slices(off):
            seen: dict[bytes, int] = {}
            for _, keys in line_keys(buf[off[i] : off[j]], off[i : j + 1] - off[i]):
                for k in set(keys):
                    seen[k] = seen.get(k, 0) + 1
            seen.pop(b"", None)
            h, g = _longs(list(seen))
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), pa.array(list(seen.values()), pa.int64())], ["h", "g", "refs"])

    part = map_arrow(docs.select(F.col(text_col).alias("text")), run, "h long, g long, refs long")
    return part.groupBy("h", "g").agg(F.sum("refs").alias("refs"))


class LineDedup:
    """See the module's docstring. ``refs`` and ``filters`` are tables in the shared folder; every change writes new ones."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, refs: DataFrame | None = None) -> None:
        self.spark, self.min_docs = spark, min_docs
        self.refs = spark.createDataFrame([], "h long, g long, refs long") if refs is None else refs
        self.filters: DataFrame | None = None
        self.n_shards = 1
        self._known: DataFrame | None = None

    def insert(self, docs: DataFrame, text_col: str = "text") -> LineDedup:
        return self._change(count_lines(docs, text_col))

    def delete(self, docs: DataFrame, text_col: str = "text") -> LineDedup:
        """Take away documents inserted before; a key that no document holds any more leaves the table."""
        return self._change(count_lines(docs, text_col).withColumn("refs", -F.col("refs")))

    def _change(self, counts: DataFrame) -> LineDedup:
        before = self.frequent()
        total = self.refs.unionByName(counts).groupBy("h", "g").agg(F.sum("refs").alias("refs")).where("refs > 0")
        self.refs = cut(total, "line-refs", keep=True)
        now = self.frequent()
        if self.filters is None or not self._updated(before, now):
            self._rebuild(now)
        self._known = now
        return self

    def frequent(self) -> DataFrame:
        """Keys to drop, from the exact table."""
        return self.refs.where(F.col("refs") >= self.min_docs).select("h", "g")

    def _shard(self) -> F.Column:
        return F.expr(f"h & {self.n_shards - 1}")

    def _rebuild(self, frequent: DataFrame) -> None:
        self.n_shards = 1 << max(0, (frequent.count() - 1).bit_length() - SHARD_KEYS.bit_length() + 1)

        def build(keys: pd.DataFrame) -> pd.DataFrame:
            made = CuckooFilter.build(keys["g"].to_numpy().view(np.uint64))
            return pd.DataFrame({"shard": [keys["shard"].iloc[0]], "filter": [made.dump()], "full": [False]})

        shards = frequent.withColumn("shard", self._shard()).groupBy("shard")
        self.filters = cut(shards.applyInPandas(build, "shard long, filter binary, full boolean"), "line-filters", keep=True)

    def _updated(self, before: DataFrame, now: DataFrame) -> bool:
        """Insert and delete what crossed the limit; False if a shard has run full and all must be built anew."""
        moved = now.join(before, ["h", "g"], "left_anti").withColumn("to", F.lit(1)).unionByName(before.join(now, ["h", "g"], "left_anti").withColumn("to", F.lit(0)))

        def change(held: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            shard = (held if len(held) else keys)["shard"].iloc[0]
            f = CuckooFilter.load(held["filter"].iloc[0]) if len(held) else CuckooFilter.build(np.zeros(0, np.uint64))
            g, to = keys["g"].to_numpy().view(np.uint64), keys["to"].to_numpy()
            for x in g[to == 0]:
                f.delete(x)
            full = not f.insert_all(g[to == 1])
            return pd.DataFrame({"shard": [shard], "filter": [f.dump()], "full": [full]})

        moved = moved.withColumn("shard", self._shard())
        made = cut(self.filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(change, "shard long, filter binary, full boolean"), "line-filters", keep=True)
        if made.where("full").limit(1).count():
            return False
        self.filters = made
        return True

    def apply(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``docs`` with the frequent lines gone from ``text_col``, and ``n_lines`` (before) and ``n_dropped``.

        Columns named n_lines or n_dropped in the input are replaced.
        """
        rows = numbered(docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped"))), "__row", "line-texts")
        with working(self.spark):
            lines = cut(_line_rows(rows.select("__row", F.col(text_col).alias("text"))), "lines")
            known = self.frequent().withColumnsRenamed({"h": "kh", "g": "kg"})
            asked = self._suspects(lines)
            # Written first, so that the join with all lines can split a line that very many rows share.
            hot = cut(asked.join(known, (asked.h == known.kh) & (asked.g == known.kg), "left_semi"), "hot-lines")
            sure = lines.join(hot, ["h", "g"], "left_semi")
            drops = sure.groupBy("row").agg(F.collect_set(F.struct("h", "g")).alias("__drop")).withColumnRenamed("row", "__at")
            drops = cut(drops, "drops", keep=True)
        rest = [c for c in rows.columns if c not in (text_col, "__row")]
        joined = rows.select("__row", *(F.col(f"`{c}`") for c in rest), F.col(text_col).alias("__text"))
        # Sorted and merged at every size, so that the plan of a small run is that of a large one.
        joined = joined.join(drops.hint("merge"), F.col("__row") == F.col("__at"), "left").select(*(F.col(f"`{c}`") for c in rest), "__text", "__drop")
        fields = [f for f in docs.schema.fields if f.name in rest]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        schema += ("," if fields else "") + f" `{text_col}` string, n_lines long, n_dropped long"

        def strip(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            at = {c: i for i, c in enumerate(batch.schema.names)}
            drop = batch.column(at["__drop"])
            _, off = utf8(batch.column(at["__text"]))
            for i, j in slices(off):
                part = batch.slice(i, j - i)
                texts, n_lines, n_dropped = _without(part.column(at["__text"]), drop.slice(i, j - i))
                kept = [part.column(at[c]) for c in rest]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*rest, text_col, "n_lines", "n_dropped"])

        return map_arrow(joined, strip, schema)

    def _suspects(self, lines: DataFrame) -> DataFrame:
        """(h, g) of the keys that the filters report; each distinct key is asked once, whatever number of rows shares it.

        Keys go to their shard's filter at every size: those of a shard are dealt over parts of at most about ``PART_KEYS`` keys, and
        each part gets a copy of the filter.
        """
        if self.filters is None:
            return lines.where("false").select("h", "g")
        parts = -(-lines.count() // (PART_KEYS * self.n_shards)) or 1
        keys = lines.select("h", "g").distinct().select("h", "g", self._shard().alias("shard"), F.pmod(F.xxhash64("g"), F.lit(parts)).alias("part"))
        filters = self.filters.select("shard", "filter", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))

        def ask(held: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            yes = np.zeros(len(own), bool)
            if len(held) and len(own):
                yes = CuckooFilter.load(held["filter"].iloc[0]).contains(own["g"].to_numpy().view(np.uint64))
            return own.loc[yes, ["h", "g"]]

        return filters.groupBy("shard", "part").cogroup(keys.groupBy("shard", "part")).applyInPandas(ask, "h long, g long")


def _line_rows(docs: DataFrame) -> DataFrame:
    """(row, h, g): the key hashes of each row's lines, once a row. ``docs``: (number, text)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        buf, off = utf8(batch.column(1))
        number = batch.column(0).to_numpy()
        for i, j in slices(off):
            at: list[int] = []
            digests: list[bytes] = []
            for n, (_, keys) in enumerate(line_keys(buf[off[i] : off[j]], off[i : j + 1] - off[i]), i):
                own = set(keys) - {b""}
                at += [n] * len(own)
                digests += own
            h, g = _longs(digests)
            yield pa.RecordBatch.from_arrays([pa.array(number[np.array(at, np.int64)]), pa.array(h), pa.array(g)], ["row", "h", "g"])

    return map_arrow(docs, run, "row long, h long, g long")


def _without(column: pa.Array, drop: pa.Array) -> tuple[list[str], list[int], list[int]]:
    """Texts without the lines whose keys their ``drop`` list names, and the counts of lines before and dropped."""
    buf, off = utf8(column)
    raw = buf.tobytes()
    texts, n_lines, n_dropped = [], [], []
    for n, (stops, keys) in enumerate(line_keys(buf, off)):
        gone = drop[n].as_py()
        out = {np.array([x["h"], x["g"]], np.int64).tobytes() for x in gone} if gone else ()
        begins = [int(off[n]), *(s + 1 for s in stops[:-1])]
        kept = [raw[b:s] for b, s, k in zip(begins, stops, keys, strict=True) if k not in out] if out else [raw[off[n] : off[n + 1]]]
        texts.append(b"\n".join(kept).decode())
        n_lines.append(len(stops))
        n_dropped.append(len(stops) - len(kept) if out else 0)
    return texts, n_lines, n_dropped
