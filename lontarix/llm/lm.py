"""Scoring texts with a log-bilinear model trained by noise-contrastive estimation.

Units of the model are the ``n_top`` most frequent training tokens, the end of a text, and ``n_buckets`` classes that all
other words fall into by their last three bytes. Both grow with the training tokens (``sizes``), without an upper end. Two units
of context have a matrix each: ``s(c, k, u) = (R[c] M + R2[k] M2) . Q[u] + b[u]``, where c is the unit before and k the group of the
unit before that: the ``OWN`` most frequent units alone, the others in ``SHARED`` groups, whose representation is the mean of theirs.

Training sees every training token, twice. First the counts of all pairs of neighbouring units are summed up on the cluster and
gathered in blocks as a sparse table, and each step follows the expected gradient of the contrastive objective over them, block by
block in numpy: that gives R, M, Q and b. Then both matrices are fitted to all tokens by steps over batches, with noise units drawn
for each: the rows are dealt by their hash over fits of some ``FIT_TOKENS`` each, whose matrices are averaged by their tokens.

Scores are normalised over all units by batched matrix products, once a context. A word of a class has the class's probability
times its share there, ``(c + 1) / (n + v + 1)`` with the class's tokens n and words v; the one left over is for words never seen,
so all tokens together sum to 1.

Word counts cover the whole corpus. At most ``HEAD`` of the most frequent words travel to the tasks; all other tokens' counts come
from an exact join.

Defined cases: a null or empty text is one end token. Without any training row all counts are 0 and the model is uniform. A
null id counts as the empty text for the held-out fold. Repeated rows are rows of their own. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, cut, slices, utf8, working
from .words import LOWER, hashes, mix, words

#: Classes of the table of word counts; a model's classes are a power of two, so they divide it.
CLASSES = 1 << 30
#: Cells of the pair table that are gathered, and made dense in training, at a time.
BLOCK = 1 << 21
END = np.uint64(0x656E64206F662061)
#: Words whose counts are sent to the tasks at most, at 16 bytes each.
HEAD = 1 << 20
#: Tokens of a fit of the matrices.
FIT_TOKENS = 1 << 21
#: Groups of the second unit of context: units with one of their own, groups of others, and one for the start of a text.
OWN, SHARED = 24, 7
GROUPS = OWN + SHARED + 1


def sizes(n: int) -> tuple[int, int]:
    """``n_top`` and ``n_buckets`` for n training tokens: units grow as their power 0.4, cells of pairs as 0.8; an eighth to a quarter are classes."""
    units = max(1024, int(1.4 * n**0.4))
    n_buckets = 1 << ((units // 4).bit_length() - 1)
    return units - n_buckets - 1, n_buckets


def held_out(id_col: str, folds: int = 7, fold: int = 2) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(folds)) == fold


def tokens(buf: np.ndarray, off: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words and, after each text, ``END``; their classes; and n + 1 offsets of the texts among them."""
    low = LOWER[buf]
    starts, ends, first = words(low, off)
    n = len(off) - 1
    size = ends - starts
    tail = low[ends - 1].astype(np.uint64)
    for back in (2, 3):
        tail = tail * np.uint64(256) + np.where(size >= back, low[np.maximum(ends - back, 0)], 0).astype(np.uint64)
    at = np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(first))
    h, bucket = np.full(len(starts) + n, END, np.uint64), np.zeros(len(starts) + n, np.int64)
    h[at] = hashes(low, starts, ends)
    bucket[at] = (mix(tail) % np.uint64(n_buckets)).astype(np.int64)
    return h, bucket, first + np.arange(n + 1)


@dataclass
class Model:
    """What the tasks need: units, embeddings, counts of frequent words, and totals."""

    top: np.ndarray
    n_buckets: int
    R: np.ndarray
    M: np.ndarray
    Q: np.ndarray
    b: np.ndarray
    head: np.ndarray
    head_counts: np.ndarray
    bucket_total: np.ndarray
    n: int
    v: int
    M2: np.ndarray | None = None
    R2: np.ndarray | None = None
    group: np.ndarray | None = None
    log_z: np.ndarray | None = None

    @property
    def units(self) -> int:
        return len(self.top) + self.n_buckets

    def unit(self, h: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.top, h), len(self.top) - 1)
        return np.where(self.top[at] == h, at, len(self.top) + bucket)

    def set_groups(self, often: np.ndarray) -> None:
        """Groups of the second unit of context from the units' counts. The matrix of that position starts as 0."""
        self.group = np.full(self.units + 1, GROUPS - 1, np.int64)
        self.group[:-1] = OWN + np.arange(self.units) % SHARED
        first = np.argsort(-often, kind="stable")[:OWN]
        self.group[first] = np.arange(len(first))
        weight = np.append(often, often.sum() or 1) + 1.0
        total = np.bincount(self.group, weight, GROUPS)
        sums = np.stack([np.bincount(self.group, weight * x, GROUPS) for x in self.R.T], 1)
        self.R2 = (sums / np.maximum(total, 1)[:, None]).astype(np.float32)
        self.M2 = np.zeros_like(self.M)

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """What each position adds to the hidden vector."""
        return self.R @ self.M, self.R2 @ self.M2

    def log_sums(self, a: int, z: int) -> np.ndarray:
        """For the contexts whose first unit is in a .. z, by group: the logarithm of the sum over all units."""
        one, two = self.parts()
        hidden = (one[a:z, None, :] + two[None]).reshape(-1, one.shape[1])
        out, step = np.empty(len(hidden), np.float32), max(1, BLOCK // self.units)
        for i in range(0, len(hidden), step):
            s = hidden[i : i + step] @ self.Q.T + self.b
            most = s.max(1)
            out[i : i + step] = most + np.log(np.exp(s - most[:, None]).sum(1))
        return out

    def normalise(self, spark: SparkSession | None = None) -> None:
        """Sets ``log_z``. With a session, blocks of contexts are summed up by its tasks; what comes back has 4 bytes a context."""
        n = self.units + 1
        if spark is None:
            self.log_z = self.log_sums(0, n)
            return
        step = max(1, 16 * BLOCK // (self.units * GROUPS))
        shipped = spark.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([shipped.value.log_sums(a, a + step).tobytes()], pa.binary())], ["a", "sums"])

        blocks = spark.range(0, n, step, -(-n // step)).mapInArrow(batches_of(run), "a long, sums binary").collect()
        self.log_z = np.concatenate([np.frombuffer(r["sums"], np.float32) for r in sorted(blocks)])

    def log10p_of(self, parts: tuple[np.ndarray, np.ndarray], contexts: np.ndarray, before: np.ndarray, unit: np.ndarray, step: int = 1 << 16) -> np.ndarray:
        """Normalised log10 probability of each ``unit`` after its context: the unit ``contexts`` and, before it, the group ``before``."""
        out = np.empty(len(unit))
        for a in range(0, len(unit), step):
            c, k, u = contexts[a : a + step], before[a : a + step], unit[a : a + step]
            out[a : a + step] = np.einsum("ij,ij->i", parts[0][c] + parts[1][k], self.Q[u]) + self.b[u] - self.log_z[c * GROUPS + k]
        return out / np.log(10)

    def log10p(self, contexts: np.ndarray, before: np.ndarray) -> np.ndarray:
        """(contexts, units): normalised log10 probabilities of the next unit."""
        one, two = self.parts()
        s = (one[contexts] + two[before]) @ self.Q.T + self.b
        s -= s.max(1, keepdims=True)
        return (s - np.log(np.exp(s).sum(1, keepdims=True))) / np.log(10)


def context(unit: np.ndarray, begin: np.ndarray, start: int) -> np.ndarray:
    """The unit before each token; ``start`` before a text's first."""
    prev = np.concatenate([[start], unit[:-1]])
    prev[begin[:-1]] = start
    return prev


def contexts(model: Model, unit: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unit before each token, and the group of the one before that."""
    one = context(unit, begin, model.units)
    return one, model.group[context(one, begin, model.units)]


def word_counts(docs: DataFrame, n_buckets: int) -> DataFrame:
    """(h, bucket, c): how often each token is in ``docs`` (text). Summed up within a task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            h, b, c = (np.concatenate(x) for x in zip(*held, strict=True))
            u, one, back = np.unique(h, return_index=True, return_inverse=True)
            held.clear()
            c = np.bincount(back, c, len(u)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(b[one].astype(np.int32)), pa.array(c)], ["h", "bucket", "c"])

        for batch in batches:
            buf, off = utf8(batch.column(0))
            for i, j in slices(off):
                h, b, _ = tokens(buf[off[i] : off[j]], off[i : j + 1] - off[i], n_buckets)
                u, one, c = np.unique(h, return_index=True, return_counts=True)
                held.append((u, b[one], c))
                if sum(len(x[0]) for x in held) > 1 << 20:
                    yield flush()
        if held:
            yield flush()

    part = docs.select("text").mapInArrow(batches_of(run), "h long, bucket int, c long")
    return part.groupBy("h").agg(F.first("bucket").alias("bucket"), F.sum("c").alias("c"))


@dataclass
class Pairs:
    """A sparse (contexts, units) table of counts, by context; slices are dense."""

    first: np.ndarray
    unit: np.ndarray
    count: np.ndarray
    units: int

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.first) - 1, self.units

    def sum(self, axis: int) -> np.ndarray:
        if axis == 0:
            return np.bincount(self.unit, self.count, self.units)
        upto = np.concatenate([[0.0], np.cumsum(self.count, dtype=np.float64)])
        return np.diff(upto[self.first])

    def __getitem__(self, rows: slice) -> np.ndarray:
        a, z, _ = rows.indices(self.shape[0])
        out = np.zeros((z - a, self.units), np.float32)
        i, j = self.first[a], self.first[z]
        out[np.repeat(np.arange(z - a), np.diff(self.first[a : z + 1])), self.unit[i:j]] = self.count[i:j]
        return out


def pair_counts(docs: DataFrame, model: Model) -> Pairs:
    """(units + 1, units): how often each unit follows each context; the last context is the start of a text."""
    units = model.units
    shipped = docs.sparkSession.sparkContext.broadcast((model.top, model.n_buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, n_buckets = shipped.value
        own = Model(top, n_buckets, *[None] * 8, 0)  # type: ignore[list-item]
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            cell, n = (np.concatenate(x) for x in zip(*held, strict=True))
            one, back = np.unique(cell, return_inverse=True)
            return one, np.bincount(back, n, len(one)).astype(np.int64)

        for batch in batches:
            buf, off = utf8(batch.column(0))
            for i, j in slices(off):
                h, b, begin = tokens(buf[off[i] : off[j]], off[i : j + 1] - off[i], n_buckets)
                unit = own.unit(h, b)
                held.append(np.unique(context(unit, begin, units) * units + unit, return_counts=True))
                if sum(len(x[0]) for x in held) > 1 << 21:
                    held[:] = [merged()]
                    if len(held[0][0]) > 1 << 20:
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, held.pop())), ["cell", "n"])
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, merged())), ["cell", "n"])

    table = cut(docs.select("text").mapInArrow(batches_of(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), "pair-counts")
    row, unit, count, step = [], [], [], max(1, BLOCK // units)
    for a in range(0, units + 1, step):
        part = table.where(F.col("cell").between(a * units, (a + step) * units - 1)).toArrow()
        cell, n = part["cell"].to_numpy(), part["n"].to_numpy()
        order = np.argsort(cell)
        row.append(np.bincount(cell // units - a, minlength=min(step, units + 1 - a)))
        unit.append((cell[order] % units).astype(np.int32))
        count.append(n[order].astype(np.float32))
    first = np.concatenate([[0], np.cumsum(np.concatenate(row))]).astype(np.int64)
    return Pairs(first, np.concatenate(unit), np.concatenate(count), units)


def train(pairs: np.ndarray | Pairs, dim: int = 24, noise: float = 8.0, steps: int = 240, rate: float = 0.05, seed: int = 7, prior: float = 100.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """R, M, Q, b by noise-contrastive estimation with the unigram distribution as noise. Blocks of contexts add up to each step.

    ``pairs`` weighs every (context, unit); the expected number of noise samples of a context is ``noise`` times its count. ``prior``
    is the precision of a normal prior of the representations: it keeps rare units near the unigram distribution, and the more
    tokens there are, the less it weighs.
    """
    n_ctx, units = pairs.shape
    often = pairs.sum(0)
    total = often.sum()
    q = (often + 0.5) / (total + 0.5 * units)
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 0.1, (n_ctx, dim)), np.eye(dim), rng.normal(0, 0.1, (units, dim)), np.log(q)]
    p = [x.astype(np.float32) for x in p]
    if not total:
        return tuple(p)  # type: ignore[return-value]
    fakes = (noise * pairs.sum(1) / total)[:, None].astype(np.float32)
    q32, rows, decay = q.astype(np.float32)[None, :], max(1, BLOCK // units), np.float32(prior / total)
    shift = np.log(noise * q).astype(np.float32)
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    for t in range(1, steps + 1):
        R, M, Q, b = p
        grads = [np.zeros_like(x) for x in p]
        for a in range(0, n_ctx, rows):
            own = slice(a, a + rows)
            hidden = R[own] @ M
            sure = 1 / (1 + np.exp(-np.clip(hidden @ Q.T + (b - shift), -30, 30)))
            data = pairs[own] / np.float32(total)
            g = data - (data + fakes[own] * q32) * sure
            back = g @ Q
            for d, part in zip(grads[1:], (R[own].T @ back, g.T @ hidden, g.sum(0)), strict=True):
                d += part
            grads[0][own] = back @ M.T
        grads[0] -= decay * p[0]
        grads[2] -= decay * p[2]
        step = rate * min(1.0, 2 * (1 - t / (steps + 1)))
        for i, d in enumerate(grads):
            m[i] += 0.1 * (d - m[i])
            v[i] += 0.01 * (d * d - v[i])
            p[i] = p[i] + step * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-9)
    return tuple(p)  # type: ignore[return-value]


class _Positions:
    """Both matrices, fitted by steps over batches of tokens; what is kept in the end is a running mean of them."""

    def __init__(self, model: Model, q: np.ndarray, seed: int, noise: float = 8.0, samples: int = 128, rate: float = 0.01) -> None:
        self.model, self.noise, self.samples, self.rate = model, noise, samples, rate
        self.rng = np.random.default_rng([11, seed])
        self.upto, self.shift = np.cumsum(q), np.log(noise * q).astype(np.float32)
        self.p = np.stack([model.M, model.M2]).astype(np.float32)
        self.mean, self.m, self.v, self.t, self.tokens = self.p.copy(), np.zeros_like(self.p), np.zeros_like(self.p), 0, 0

    def step(self, c: np.ndarray, k: np.ndarray, u: np.ndarray) -> None:
        own = self.model
        x, y, right = own.R[c], own.R2[k], own.Q[u]
        hidden = x @ self.p[0] + y @ self.p[1]
        drawn = np.minimum(np.searchsorted(self.upto, self.rng.random(self.samples) * self.upto[-1], "right"), own.units - 1)
        left = own.Q[drawn]
        sure = 1 / (1 + np.exp(-np.clip(np.einsum("ij,ij->i", hidden, right) + own.b[u] - self.shift[u], -30, 30)))
        fake = 1 / (1 + np.exp(-np.clip(hidden @ left.T + (own.b - self.shift)[drawn], -30, 30)))
        back = (1 - sure)[:, None] * right - (self.noise / self.samples) * (fake @ left)
        d = np.stack([x.T @ back, y.T @ back]) / len(u)
        self.t += 1
        self.tokens += len(u)
        self.m += 0.1 * (d - self.m)
        self.v += 0.01 * (d * d - self.v)
        self.p += self.rate / (1 + self.t / 100) ** 0.5 * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)
        self.mean += max(0.02, 1 / self.t) * (self.p - self.mean)


def position_matrices(docs: DataFrame, model: Model, batch_tokens: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """M and M2 after one pass over all training tokens: the steps of fits of about ``FIT_TOKENS`` each, averaged by their tokens. ``docs``: (text).

    A row's hash says which fit it is in and where, so the matrices depend on the rows alone, not on how files split them, and copies
    of a text under ids of their own are spread over the fits.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    shape = model.M.shape
    fits = max(1, round(model.n / FIT_TOKENS))
    dealt = docs.select("text", F.xxhash64(*docs.columns).alias("h")).withColumn("fit", F.pmod("h", F.lit(fits)).cast("int"))
    dealt = dealt.repartitionById(fits, F.col("fit")).sortWithinPartitions("fit", "h").select("text", "fit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = shipped.value
        q = np.exp(own.b.astype(np.float64) - own.b.max())
        q /= q.sum()
        fitted: _Positions | None = None
        held: list[tuple[np.ndarray, ...]] = []

        def flush(least: int) -> None:
            c, k, u = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            for a in range(0, len(u), batch_tokens):
                if len(u) - a < least:
                    held.append((c[a:], k[a:], u[a:]))
                else:
                    fitted.step(*(x[a : a + batch_tokens] for x in (c, k, u)))

        def ended() -> Iterator[pa.RecordBatch]:
            if held:
                flush(1)
            if fitted and fitted.tokens:
                yield pa.RecordBatch.from_arrays([pa.array([fitted.tokens]), pa.array([fitted.mean.astype(np.float64).ravel().tolist()])], ["tokens", "p"])

        now = -1
        for batch in batches:
            number = batch.column(1).to_numpy()
            starts = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(number) else []
            for a, z in zip(starts, [*starts[1:], len(number)], strict=True):
                if number[a] != now:
                    yield from ended()
                    now = int(number[a])
                    fitted = _Positions(own, q, now)
                buf, off = utf8(batch.column(0).slice(a, z - a))
                for i, j in slices(off):
                    h, b, begin = tokens(buf[off[i] : off[j]], off[i : j + 1] - off[i], own.n_buckets)
                    unit = own.unit(h, b)
                    held.append((*contexts(own, unit, begin), unit))
                    flush(batch_tokens)
        yield from ended()

    made = dealt.mapInArrow(batches_of(run), "tokens long, p array<double>")
    # One sum for each number of the matrices, added up within tasks: nothing grows with the number of tasks at the driver.
    sums = made.select("tokens", F.posexplode("p").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x") * F.col("tokens")).alias("x"), F.sum("tokens").alias("n")).collect()
    if not sums:
        return model.M, model.M2
    p = np.zeros(2 * shape[0] * shape[1], np.float32)
    for r in sums:
        p[r["i"]] = r["x"] / r["n"]
    return p.reshape(2, *shape)[0], p.reshape(2, *shape)[1]


def fit(docs: DataFrame, n_top: int | None = None, n_buckets: int | None = None, head: int = HEAD) -> tuple[Model, DataFrame]:
    """The model and the (h, bucket, c) table of all training tokens. ``docs``: (text), perhaps with an id, of the training rows; ``n_buckets``: a power of two."""
    counts = cut(word_counts(docs, CLASSES), "word-counts", keep=True)
    totals = counts.agg(F.sum("c"), F.count("*")).first()
    grown = sizes(totals[0] or 0)
    n_top, n_buckets = n_top or grown[0], n_buckets or grown[1]
    if CLASSES % n_buckets:
        raise ValueError(f"{n_buckets} classes: not a power of two")
    end = np.array([END]).view(np.int64)[0].item()
    top = counts.where(F.col("h") != end).orderBy(F.desc("c"), "h").limit(n_top).toArrow()
    top_h = np.sort(np.append(top["h"].to_numpy(), end).astype(np.int64).view(np.uint64))
    # Words by count in steps of a 16th of a power of two: some thousand steps at most, however large counts are.
    step = F.floor(16 * F.log2("c")).cast("int")
    least, held = 1 << 30, 0
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        if held + r["count"] > head:
            break
        least, held = r["step"], held + r["count"]
    often = counts.where(step >= least).select("h", "c").toArrow()
    h, c = often["h"].to_numpy().view(np.uint64), often["c"].to_numpy()
    order = np.argsort(h)
    own_units = docs.sparkSession.createDataFrame(pa.table({"h": top_h.view(np.int64)}))
    rest = counts.join(own_units, "h", "left_anti").groupBy((F.col("bucket") % n_buckets).alias("bucket")).agg((F.sum("c") + F.count("*")).alias("size")).collect()
    size = np.ones(n_buckets)
    for r in rest:
        size[r["bucket"]] += r["size"]
    model = Model(top_h, n_buckets, *[None] * 4, h[order], c[order], size, totals[0] or 0, totals[1])  # type: ignore[list-item]
    pairs = pair_counts(docs, model)
    model.R, model.M, model.Q, model.b = train(pairs)
    model.set_groups(pairs.sum(0))
    del pairs
    model.M, model.M2 = position_matrices(docs, model)
    model.normalise(docs.sparkSession)
    return model, counts


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2, **sizes: int) -> DataFrame:
    """Per row: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col, folds, fold).alias("held_out"), F.col(text_col).alias("text"))
    with working(docs.sparkSession):
        model, counts = fit(rows.where("NOT held_out").select("id", "text"), **sizes)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, rest array<long>, times array<int>, shared array<boolean>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = shipped.value
        parts = own.parts()
        share = np.log10(own.bucket_total)
        is_top = np.arange(own.units) < len(own.top)
        for batch in batches:
            buf, off = utf8(batch.column(2))
            for i, j in slices(off):
                h, bucket, begin = tokens(buf[off[i] : off[j]], off[i : j + 1] - off[i], own.n_buckets)
                u, back = np.unique(h, return_inverse=True)
                at = np.minimum(np.searchsorted(own.head, u), max(len(own.head) - 1, 0))
                known = own.head[at] == u if len(own.head) else np.zeros(len(u), bool)
                log = np.where(known, np.log10(own.head_counts[at] + 1.0), 0.0) if len(own.head) else np.zeros(len(u))
                unit = own.unit(h, bucket)
                word = np.where(is_top[unit], 0.0, log[back] - share[bucket])
                model_log = own.log10p_of(parts, *contexts(own, unit, begin), unit) + word
                n = j - i
                doc = np.repeat(np.arange(n), np.diff(begin))
                base = np.bincount(doc, log[back], n)
                total = np.bincount(doc, model_log, n)
                seen = np.bincount(doc, known[back], n).astype(np.int64)
                far = np.flatnonzero(~known[back])
                pair, times = np.unique(doc[far] * len(u) + back[far], return_counts=True)
                cuts = pa.array(np.searchsorted(pair, np.arange(n + 1) * len(u)).astype(np.int32))
                rest = pa.ListArray.from_arrays(cuts, pa.array(u[pair % len(u)].view(np.int64)))
                times = pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int32)))
                # A unit of its own has its probability already; only words of a class have a share that their count decides.
                shared = np.zeros(len(u), bool)
                shared[back] = ~is_top[unit]
                shared = pa.ListArray.from_arrays(cuts, pa.array(shared[pair % len(u)]))
                kept = [batch.column(k).slice(i, n) for k in range(2)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(begin)), pa.array(seen), pa.array(base), pa.array(total), rest, times, shared], ["id", "held_out", "n_tokens", "n_known", "base", "score", "rest", "times", "shared"])

    numbered = rows.mapInArrow(batches_of(run), schema).withColumn("row", F.monotonically_increasing_id())
    part = cut(numbered, "scores")
    far = part.select("row", F.explode(F.arrays_zip("rest", "times", "shared")).alias("t")).select("row", F.col("t.rest").alias("h"), F.col("t.times").alias("times"), F.col("t.shared").alias("shared"))
    found = far.join(counts.select("h", "c"), "h")
    more = found.groupBy("row").agg(F.sum("times").alias("k"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("log"), F.sum(F.when(F.col("shared"), F.col("times") * F.log10(F.col("c") + 1))).alias("share"))
    out = part.drop("rest", "times", "shared").join(more, "row", "left")
    log, share, k = (F.coalesce(c, F.lit(0.0)) for c in ("log", "share", "k"))
    size = float(np.log10(float(model.n + model.v + 1)))
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + k).cast("long").alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + log - F.col("n_tokens") * size).alias("base_score"),
        (F.col("score") + share).alias("score"),
    )
