"""Quality rules: counts of a text, and cross-document line frequency within a host.

Normalised lines (stripped of ASCII white space, A-Z lower-cased) are hashed. For each host the distinct
documents that hold a line are counted; identical texts of a host count as one document, so that a page copied many times
does not make its own lines look like boilerplate. Lines in more than ``max(min_docs, max_share * documents of the host)``
documents are removed, and a document left with less than ``min_left`` of its words is rejected as depleted.

Defined cases: a null or empty text has no words and fails the base rules. A null host is a host of its own. Repeated rows
are judged alike, each on its own row, whatever ids repeat or are null. An empty table gives an empty result. Extra columns
stay out of ``judge``'s result and pass through ``clean``; ``clean`` gives an empty text for a null one, if the rules keep it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, numbered, slices, utf8, working
from .words import LOWER, words

#: The symbols counted by the base rules.
SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_SCHEMA = "row long, id {id}, host string, sha binary, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, hashes array<long>, counts array<int>"


def _repeat_words(raw: bytes, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, codes: dict[bytes, int]) -> np.ndarray:
    """Per text, its words inside 3-word windows that the text holds at least twice. Words are compared whole, not by hash."""
    code = np.array([codes.setdefault(raw[a:b], len(codes)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
    out = np.zeros(len(first) - 1, np.int64)
    for n in range(len(out)):
        c = code[first[n] : first[n + 1]]
        if len(c) < 4:
            continue
        _, c = np.unique(c, return_inverse=True)
        size = int(c.max()) + 1
        if size < 1 << 20:
            w = (c[:-2] * size + c[1:-1]) * size + c[2:]
        else:
            _, w = np.unique(c[:-2] * size + c[1:-1], return_inverse=True)
            w = w * size + c[2:]
        _, back, times = np.unique(w, return_inverse=True, return_counts=True)
        twice = times[back] > 1
        if twice.any():
            hit = np.zeros(len(c), bool)
            hit[:-2] |= twice
            hit[1:-1] |= twice
            hit[2:] |= twice
            out[n] = hit.sum()
    return out


def _sums(x: np.ndarray) -> np.ndarray:
    """0 and the running sums; 32 bits hold those of a text, which has less than 2 GB."""
    out = np.zeros(len(x) + 1, np.int32)
    np.cumsum(x, out=out[1:])
    return out


def _measure(buf: np.ndarray, off: np.ndarray) -> dict[str, list]:
    starts, ends, first = words(buf, off)
    raw, low = buf.tobytes(), LOWER[buf].tobytes()
    points, symbols = _sums((buf & 0xC0) != 0x80), _sums(_IS_SYMBOL[buf])
    inside = _sums(points[ends] - points[starts])
    out: dict[str, list] = {
        "n_words": np.diff(first).tolist(),
        "word_chars": np.diff(inside[first]).tolist(),
        "n_symbols": np.diff(symbols[off]).tolist(),
        "n_repeat_words": _repeat_words(raw, starts, ends, first, {}).tolist(),
    }
    out |= {k: [] for k in ("sha", "n_dup_lines", "hashes", "counts")}
    breaks = np.flatnonzero(buf == 10)
    cuts = np.searchsorted(breaks, off)
    for n in range(len(off) - 1):
        out["sha"].append(hashlib.sha256(raw[off[n] : off[n + 1]]).digest())
        stop = np.append(breaks[cuts[n] : cuts[n + 1]], off[n + 1])
        begin = np.append(off[n], stop[:-1] + 1)
        a, b = np.searchsorted(starts, begin), np.searchsorted(starts, stop)
        seen: set[bytes] = set()
        weight: dict[int, int] = {}
        dup = 0
        for x, y, s, t in zip(a.tolist(), b.tolist(), begin.tolist(), stop.tolist(), strict=True):
            if x < y:
                line = raw[s:t]
                dup += line in seen
                seen.add(line)
                h = _key(low[starts[x] : ends[y - 1]])
                weight[h] = weight.get(h, 0) + y - x
        out["n_dup_lines"].append(dup)
        out["hashes"].append(list(weight))
        out["counts"].append(list(weight.values()))
    return out


def _key(low: bytes) -> int:
    """Hash of a stripped, lower-cased line."""
    return xxhash.xxh3_64_intdigest(low) - (1 << 63)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", row: Column | None = None) -> DataFrame:
    """One narrow row a document: its counts, the hashes of its distinct normalised lines and their words. ``row``: its number."""
    kind = docs.schema[id_col].dataType.simpleString()
    number = F.monotonically_increasing_id() if row is None else row
    rows = docs.select(number.alias("row"), F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).alias("text"))
    types = [pa.binary(), *[pa.int64()] * 5, pa.list_(pa.int64()), pa.list_(pa.int32())]
    names = ["sha", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "hashes", "counts"]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        buf, off = utf8(batch.column(3))
        for i, j in slices(off):
            got = _measure(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            kept = [batch.column(k).slice(i, j - i) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(got[n], t) for n, t in zip(names, types, strict=True))], ["row", "id", "host", *names])

    return map_arrow(rows, run, _SCHEMA.format(id=kind))


def _frequent(table: DataFrame, min_docs: int, max_share: float) -> DataFrame:
    """(hot_host, hot): lines above the limits of their host."""
    # One row for each distinct text of a host stands for its copies; counts are summed per task before the shuffle.
    texts = table.groupBy("host", "sha").agg(F.min("row").alias("row"))
    single = table.select("row", "host", "hashes").join(texts.select("row"), "row", "left_semi")
    hosts = texts.groupBy("host").agg(F.count("*").alias("docs"))
    lines = single.select("host", F.explode("hashes").alias("h")).groupBy("host", "h").agg(F.count("*").alias("n"))
    lines = lines.where(F.col("n") > min_docs)
    over = lines.join(hosts.withColumnRenamed("host", "in_host"), F.col("host").eqNullSafe(F.col("in_host"))).where(F.col("n") > max_share * F.col("docs")).select(F.col("host").alias("hot_host"), F.col("h").alias("hot"))
    # Written first, so that the join can split a line that very many documents share.
    over = cut(over, "frequent-lines")
    return over


def _hot_lines(table: DataFrame, over: DataFrame) -> DataFrame:
    """(row, h, words): the lines above the limits, once a row, and how many words they have there."""
    own = table.select("row", "host", F.explode(F.arrays_zip("hashes", "counts")).alias("l")).select("row", "host", F.col("l.hashes").alias("h"), F.col("l.counts").alias("words"))
    return own.join(over, F.col("host").eqNullSafe(F.col("hot_host")) & (F.col("h") == F.col("hot"))).select("row", "h", "words")


def _verdicts(table: DataFrame, gone: DataFrame, min_words: int, max_repeat_pct: int, min_left: float) -> DataFrame:
    """``table`` with ``n_left``, ``base_failed`` and ``kept``; ``gone``: (row, gone) words in removed lines."""
    out = table.drop("sha", "hashes", "counts").join(gone, "row", "left")
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    out = out.withColumn("n_left", left).withColumn("base_failed", failed)
    return out.withColumn("kept", ~failed & (left >= min_left * F.col("n_words"))).drop("gone")


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 50,
    max_repeat_pct: int = 50,
    min_docs: int = 20,
    max_share: float = 0.02,
    min_left: float = 0.2,
) -> DataFrame:
    """Counts and verdict of every row: the counts, ``base_failed``, ``n_left`` (words outside removed lines) and ``kept``."""
    with working(docs.sparkSession):
        table = cut(measure(docs, id_col, text_col, host_col), "line-stats", keep=True)
        over = _frequent(table, min_docs, max_share)
        gone = cut(_hot_lines(table, over).groupBy("row").agg(F.sum("words").alias("gone")), "hot-words", keep=True)
    return _verdicts(table, gone, min_words, max_repeat_pct, min_left).withColumnRenamed("id", id_col)


def clean(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 50,
    max_repeat_pct: int = 50,
    min_docs: int = 20,
    max_share: float = 0.02,
    min_left: float = 0.2,
) -> DataFrame:
    """The rows that ``judge`` keeps, without the lines above the limits in their text; other columns stay as they are."""
    rows = numbered(docs, "__row", "quality-texts")
    with working(docs.sparkSession):
        table = cut(measure(rows, id_col, text_col, host_col, F.col("__row")), "line-stats")
        hot = _hot_lines(table, _frequent(table, min_docs, max_share)).groupBy("row").agg(F.sum("words").alias("gone"), F.collect_set("h").alias("__drop"))
        hot = cut(hot, "hot-lines")
        kept = _verdicts(table, hot.select("row", "gone"), min_words, max_repeat_pct, min_left).where("kept").select("row")
        side = cut(kept.join(hot.select("row", "__drop"), "row", "left").withColumnRenamed("row", "__kept"), "kept-rows", keep=True)
    rest = [c for c in docs.columns if c != text_col]
    # Sorted and merged at every size, so that the plan of a small run is that of a large one.
    rows = rows.join(side.hint("merge"), F.col("__row") == F.col("__kept")).select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{text_col}`").alias("__text"), "__drop")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def strip(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = {c: i for i, c in enumerate(batch.schema.names)}
        _, off = utf8(batch.column(at["__text"]))
        for i, j in slices(off):
            part = batch.slice(i, j - i)
            text, drop = part.column(at["__text"]).fill_null(""), part.column(at["__drop"])
            if drop.null_count < len(drop):
                text = pa.array([_without(t, d) if d.is_valid else t.as_py() for t, d in zip(text, drop, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*(part.column(at[c]) for c in rest), text], [*rest, text_col])

    made = map_arrow(rows, strip, ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), f"`{text_col}` string"]))
    return made.select(*(F.col(f"`{c}`") for c in docs.columns))


def _without(text: pa.Scalar, drop: pa.Scalar) -> str:
    """The text without the lines whose hashes ``drop`` holds."""
    gone = set(drop.as_py())
    return b"\n".join(x for x in text.as_buffer().to_pybytes().split(b"\n") if not (k := x.strip(b" \t\n\v\f\r").lower()) or _key(k) not in gone).decode()
