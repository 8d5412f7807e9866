"""Spelling variants: words that differ by one inserted, deleted or replaced code point, grouped under their frequent form.

Two words of m and m or m + 1 code points that differ by one edit at position i share the first i code points and the last
m - i - 1 (replaced) or m - i (inserted). In a set of words sorted forward the first condition is an interval, sorted by their
reversed text the second is one too, and the words of both are the points of a rectangle, reported by a wavelet matrix.

Words are dealt out so that near words meet: once for edits in the first half of the positions, keyed by what they share behind
it, and once for edits in the second half, keyed by what they share before it. A key's words of more than ``MOST`` code points are split
again by halving the positions, until a half is one position, where a key can have no more words than there are letters; so no
key is one large task. A task holds the complete keys that fall to it and indexes all its words of one length together.

Defined cases: null and empty texts have no words. A null id counts as an empty text in the hash that picks a run's deleted code
point. Texts and words of any length are taken whole. Rows that repeat an id count each. An empty table gives no rows. Extra
columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, cut, working
from .wavelet import WaveletMatrix

#: Letters of a word, and the code points of a key's words that are split again.
RUN, MOST = r"[A-Za-zÀ-ÿ]+", 1 << 22
#: Rows and code points of a task at most, but for single longer keys; rectangles looked up at once.
TASK_ROWS, TASK_CHARS, AT_ONCE = 50_000, 4_000_000, 1 << 18
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, least: int = 5, min_n: int = 3, every: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of at least ``least`` code points and ``min_n`` occurrences. Of runs whose hash with the id is divisible by ``every`` one code point is deleted."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", _UPPER, _LOWER).alias("run")).where(F.length("run") >= least)
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(h, F.length("run").cast("long")).cast("int")
    dropped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(h % every == 0, dropped).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_n)


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with the text that near words share outside the positions lo .. hi - 1."""
    before = F.substring("word", F.lit(1), F.col("lo"))
    behind = F.right("word", F.greatest(F.col("m") - F.col("hi"), F.lit(0)))
    return rows.withColumn("key", F.concat(before, F.lit("\0"), behind))


def _blocks(words: DataFrame, least: int, most: int) -> DataFrame:
    """(word, n, m, lo, hi, key): every word with those it may be near, as one of the shorter (m is its length) or longer ones."""
    size = F.length("word")
    half = lambda m: F.call_function("div", m + 1, F.lit(2)).cast("int")
    parts = [F.struct(m.alias("m"), lo.alias("lo"), hi.alias("hi")) for m in (size, size - 1) for lo, hi in ((F.lit(0), half(m)), (half(m), m + 1))]
    rows = words.select("word", "n", F.explode(F.array(*parts)).alias("x")).select("word", "n", "x.*").where(F.col("m") >= least)
    rows = _keyed(rows)
    while True:
        large = rows.groupBy("m", "lo", "hi", "key").agg(F.sum(F.length("word")).alias("size")).where((F.col("size") > most) & (F.col("hi") - F.col("lo") > 1))
        large = cut(large.drop("size"), "large-keys")
        if not large.limit(1).count():
            return rows
        on = ["m", "lo", "hi", "key"]
        middle = half(F.col("lo") + F.col("hi") - 1)
        two = F.array(*(F.struct(a.alias("lo"), b.alias("hi")) for a, b in ((F.col("lo"), middle), (middle, F.col("hi")))))
        split = rows.join(large, on, "left_semi").select("word", "n", "m", F.explode(two).alias("x")).select("word", "n", "m", "x.*")
        rows = cut(rows.join(large, on, "left_anti").unionByName(_keyed(split)), "keys")


def _spans(common: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each rank the interval of its order in which neighbours share at least ``k`` code points; common[r] is what r shares with r - 1."""
    cuts = np.flatnonzero(common < k)
    at = np.searchsorted(cuts, rank, "right")
    return cuts[at - 1], np.append(cuts, len(common))[at]


def _ordered(words: list[str], size: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points (a row a word, zeros behind), ranks in sorted order, and what each in that order shares with the one before."""
    grid = np.zeros((len(words), m + 1), np.uint32)
    grid[np.arange(m + 1)[None, :] < size[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    common = np.full(len(words), -1, np.int64)
    step = max(1, AT_ONCE * 8 // (m + 1))
    for i in range(1, len(words), step):
        other = grid[order[i : i + step]] != grid[order[i - 1 : i - 1 + len(order[i : i + step])]]
        common[i : i + step] = np.where(other.any(1), other.argmax(1), m + 1)
    return grid, rank, common


def near_in(words: list[str], m: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in ``words`` (distinct, of m or m + 1 code points): all that differ by one edit at a position in lo .. hi - 1, in both directions, once each."""
    size = np.array([len(w) for w in words], np.int64)
    grid, front, same_front = _ordered(words, size, m)
    _, back, same_back = _ordered([w[::-1] for w in words], size, m)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    shorter = np.flatnonzero(size == m)
    for grown in (0, 1):
        # The points are the words of m + grown code points, by their places among these in either order.
        chosen = np.flatnonzero(size == m + grown)
        if not len(chosen) or not len(shorter):
            continue
        here = [np.concatenate([[0], np.cumsum(np.bincount(r[chosen], minlength=len(words)))]) for r in (front, back)]
        by_front, by_back = (chosen[np.argsort(r[chosen])] for r in (front, back))
        points = WaveletMatrix(here[1][back[by_front]])
        asked: list[tuple[np.ndarray, ...]] = []

        def look(asked: list[tuple[np.ndarray, ...]], points: WaveletMatrix = points, by_back: np.ndarray = by_back, grown: int = grown) -> None:
            who, at, a, b, c, d = (np.concatenate(x) for x in zip(*asked, strict=True))
            q, value = points.report(a, b, c, d)
            x, y, i = who[q], by_back[value], at[q]
            # An inserted letter can stand anywhere in a run of its like: only the last place counts. A word is not near itself.
            real = grid[x, i] != grid[y, i]
            found.append((x[real], y[real]))
            if grown:
                found.append((y[real], x[real]))

        n = 0
        for i in range(lo, min(hi, m + grown)):
            a, b = _spans(same_front, front[shorter], i)
            c, d = _spans(same_back, back[shorter], m - i - 1 + grown)
            a, b, c, d = here[0][a], here[0][b], here[1][c], here[1][d]
            live = np.flatnonzero((b - a > 1 - grown) & (d - c > 1 - grown))
            asked.append((shorter[live], np.full(len(live), i), a[live], b[live], c[live], d[live]))
            n += len(live)
            if n > AT_ONCE:
                look(asked)
                asked, n = [], 0
        if n:
            look(asked)
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none)


def near_words(words: DataFrame, least: int = 5, most: int = MOST) -> DataFrame:
    """(word, near, near_n): all near pairs of ``words`` (word, n), in both directions, once each."""
    spark = words.sparkSession
    total = words.agg(F.count("*").alias("n"), F.sum(F.length("word")).alias("chars")).first()
    tasks = max(4 * total.n // TASK_ROWS, 4 * (total.chars or 0) // TASK_CHARS, int(spark.conf.get("spark.sql.shuffle.partitions"))) + 1
    dealt = _blocks(words, least, most).repartition(tasks, "m", "lo", "hi", "key").select("word", "n", "m", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        lo, hi, m = (rows.column(c).to_numpy() for c in ("lo", "hi", "m"))
        order = np.lexsort((hi, lo, m))
        starts = np.flatnonzero(np.append(True, (np.diff(m[order]) != 0) | (np.diff(lo[order]) != 0) | (np.diff(hi[order]) != 0)))
        for a, b in zip(starts, np.append(starts[1:], len(order)), strict=True):
            part = rows.select(["word", "n"]).take(order[a:b])
            text, n = part.column("word"), part.column("n")
            # A word has one key for a range of positions, so no word is here twice.
            x, y = near_in(text.to_pylist(), int(m[order[a]]), int(lo[order[a]]), int(hi[order[a]]))
            for i in range(0, len(x), 1 << 16):
                to = pa.array(y[i : i + (1 << 16)])
                yield from pa.table({"word": text.take(pa.array(x[i : i + (1 << 16)])), "near": text.take(to), "near_n": n.take(to)}).combine_chunks().to_batches()

    return dealt.mapInArrow(batches_of(run), "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word from each ``word`` of (word, form) on. Steps double, so turns grow with the logarithm of the longest chain."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = cut(now.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(docs: DataFrame, least: int = 5, min_n: int = 3, times: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root): a word's form is its most frequent near word (ties: the smallest), if that occurs at least ``times`` times as often."""
    with working(docs.sparkSession):
        words = cut(vocabulary(docs, least, min_n, id_col=id_col, text_col=text_col), "words")
        best = near_words(words, least).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("b"))
        best = best.select("word", "n_near", F.col("b.near").alias("near"), (-F.col("b.n")).alias("near_n"))
        formed = F.col("near_n") >= times * F.col("n")
        all_ = words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n")
        )
        all_ = cut(all_, "forms", keep=True)
        last = cut(roots(all_.where("form IS NOT NULL").select("word", "form")), "word-roots", keep=True)
    return all_.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
