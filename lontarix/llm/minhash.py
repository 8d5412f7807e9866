"""Near-duplicate groups by min-max hashing.

Every permutation keeps both its minimum and its maximum over a document's shingles, so ``2 * n_perm`` signature values
cost ``n_perm`` hash evaluations. Values are banded; documents that share a band are candidates, candidates whose
signatures agree too little are set aside, and the rest are confirmed on the full shingle sets.

Documents with equal sets are one class from the start. The members of each bucket are compared with one representative
first, and links are joined into components; then members of *different* components that share a bucket are compared on
their full sets. In a bucket of more than ``SMALL`` members that is done a pair of chunks at a time inside bounded tasks,
which return what joins their members, not the pairs; so no list of a group's pairs is ever made, and no link between
different texts that share a band is lost.

Defined cases: a text without words (or null) has an empty set and is linked with nothing. A text of fewer words than a
shingle is one shingle, its whole sequence. Rows that repeat an id are judged each by its own text. A row with a null id is linked like
any other but never names a component; it is kept only where no linked row has an id. An empty table gives no rows. Extra
columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, map_arrow, numbered, slices, utf8, working
from .graph import components
from .words import LOWER, hashes, mix, whole, windows, words

#: A pair at the threshold is missed by all bands with at most this chance.
MISS = 1e-6
ROWS = 5
#: Buckets up to this size are compared pair by pair, larger ones in pairs of chunks of about ``CHUNK`` members.
SMALL, CHUNK = 32, 256
#: Parts that a bucket's members are dealt over where they are joined with what is known of the bucket, so that no bucket is
#: one task; and members of a large bucket in such a part where its size is known.
SALTS, PART = 64, 1024
#: Up to so many ids of documents in shared buckets, of 8 bytes at most each, are sent to the tasks that read the texts again;
#: beyond it texts and ids are joined by a shuffle.
SENT_IDS = 2_000_000
NUMBERS = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's ``k``-word shingles (A-Z lower-cased), and n + 1 offsets."""
    buf = LOWER[buf]
    starts, ends, first = words(buf, off)
    h = hashes(buf, starts, ends)
    win, begin = windows(h, first, k)
    out = []
    for n in range(len(off) - 1):
        if begin[n] < begin[n + 1]:
            out.append(np.unique(win[begin[n] : begin[n + 1]]))
        elif first[n] < first[n + 1]:
            out.append(whole(h[first[n] : first[n + 1]]).reshape(1))
        else:
            out.append(np.zeros(0, np.uint64))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


class Bands:
    """Number of bands and permutations for a threshold, and the signatures."""

    def __init__(self, threshold: float, rows: int = ROWS) -> None:
        self.rows = rows
        self.bands = math.ceil(math.log(MISS) / math.log(1 - threshold**rows))
        self.n_perm = math.ceil(self.bands * rows / 2)
        rng = np.random.default_rng(20240229)
        self.mul = rng.integers(0, 1 << 63, self.n_perm, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 1 << 63, self.n_perm, dtype=np.uint64)

    def signatures(self, sets: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """(texts, 2 * n_perm) minima and maxima; every set must have a member."""
        out = np.empty((2 * self.n_perm, len(begin) - 1), np.uint64)
        for i in range(self.n_perm):
            v = sets * self.mul[i] + self.add[i]
            np.minimum.reduceat(v, begin[:-1], out=out[2 * i])
            np.maximum.reduceat(v, begin[:-1], out=out[2 * i + 1])
        return out.T

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """(texts, bands): a hash of each band's values; the band's number is part of it."""
        x = np.repeat(np.arange(self.bands, dtype=np.uint64)[None, :], len(signatures), 0)
        for r in range(self.rows):
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + mix(signatures[:, r : self.bands * self.rows : self.rows]))
        return x


def _flat(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(begin), pa.array(values)).cast(pa.list_(pa.int64()))


def _bytes(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    return pa.array([values[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)], pa.binary())


def _digests(sets: np.ndarray, begin: np.ndarray) -> pa.Array:
    """128-bit hashes of whole sets."""
    raw = sets.tobytes()
    return pa.array([xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)], pa.binary())


def signatures(docs: DataFrame, k: int, threshold: float, id_col: str = "doc_id", text_col: str = "text", row: Column | None = None) -> DataFrame:
    """(row, id, n, sha, keys, sig): number, set size, a 128-bit hash of the set, band keys and the values' low 16 bits. One narrow row a document."""
    plan = Bands(threshold)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        buf, off = utf8(batch.column(2))
        for i, j in slices(off):
            sets, begin = shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], k)
            size = np.diff(begin)
            full = np.flatnonzero(size)
            sig = plan.signatures(sets, begin[np.append(full, len(size))] if len(full) else np.zeros(1, np.int64)) if len(full) else np.zeros((0, 2 * plan.n_perm), np.uint64)
            keys = plan.keys(sig).view(np.int64)
            at = np.concatenate([[0], np.cumsum(size > 0)])
            low = np.ascontiguousarray(sig & np.uint64(0xFFFF)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(i, j - i) for c in (0, 1)), pa.array(size, pa.int64()), _digests(sets, begin), _flat(keys.ravel(), at * plan.bands), _bytes(low.ravel(), at * 2 * plan.n_perm)],
                ["row", "id", "n", "sha", "keys", "sig"],
            )

    number = F.monotonically_increasing_id() if row is None else row
    texts = docs.select(number.alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(texts, run, f"row long, id {kind}, n long, sha binary, keys array<long>, sig binary")


def _alike(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose signatures agree in at least ``least`` of their values."""
    left = sigs.select(F.col("v").alias("a"), F.col("sig").alias("sig_a"))
    right = sigs.select(F.col("v").alias("b"), F.col("sig").alias("sig_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (2, 3))
        yes = np.flatnonzero((x == y).mean(1) >= least) if batch.num_rows else np.zeros(0, np.int64)
        return batch.select([0, 1]).take(pa.array(yes))

    return map_arrow(both, run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """Pairs with 100 * |intersection| >= pct * |union| on the full sets."""
    left = sets.select(F.col("v").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("v").alias("b"), F.col("members").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        yes = []
        for n in range(batch.num_rows):
            x, y = (np.frombuffer(batch.column(i)[n].as_buffer(), np.uint64) for i in (2, 3))
            both = len(np.intersect1d(x, y, assume_unique=True))
            yes.append(100 * both >= pct * (len(x) + len(y) - both))
        return batch.select([0, 1]).filter(pa.array(yes, pa.bool_()))

    return map_arrow(both, run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, pct: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id`` (smallest id reachable over links), ``kept`` (it is that id)."""
    with working(docs.sparkSession):
        rows = _grouped(docs, k, pct, id_col, text_col, keep=True)
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    out = rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.col("component_id").isNull()))


def one_of_each(docs: DataFrame, k: int = 5, pct: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: exactly one of each group stays, that of the smallest id (a row without an id
    only where none has one), and of rows that share it the first. Rows without words all stay. Columns stay as they are."""
    texts = numbered(docs, "__row", "dedup-texts")
    with working(docs.sparkSession):
        rows = _grouped(texts, k, pct, id_col, text_col, F.col("__row"))
        first = rows.where("n > 0").groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("m"))
        keep = first.select(F.col("m.row").alias("__kept")).unionByName(rows.where("n = 0").select(F.col("row").alias("__kept")))
        keep = cut(keep, "kept-rows", keep=True)
    # Sorted and merged at every size, so that the plan of a small run is that of a large one.
    return texts.join(keep.hint("merge"), F.col("__row") == F.col("__kept"), "left_semi").drop("__row")


def _grouped(docs: DataFrame, k: int, pct: int, id_col: str, text_col: str, row: Column | None = None, keep: bool = False) -> DataFrame:
    """(row, id, n, label, component): for rows with words the number of their group and the smallest id in it. Its two tables are kept if asked."""
    threshold = pct / 100
    rows = cut(signatures(docs, k, threshold, id_col, text_col, row), "signatures", keep)
    # Equal sets are one class: its vertex is the number of one of its rows.
    classes = cut(rows.where("n > 0").groupBy("sha").agg(F.min("row").alias("v"), F.min("id").alias("least")), "classes")
    nodes = rows.withColumnRenamed("row", "v").join(classes.select("v"), "v", "left_semi")
    member = cut(_in_shared_buckets(nodes.select("v", "keys")), "buckets")
    reps = member.select("v").distinct()
    chosen = cut(nodes.select("v", "id", "sha", "sig").join(reps, "v", "left_semi"), "class-signatures")
    sigs = chosen.select("v", "sig")
    wanted = chosen.select(F.col("id").alias("want")).distinct()
    if isinstance(docs.schema[id_col].dataType, NUMBERS) and wanted.count() <= SENT_IDS:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = texts.join(wanted, F.col("id").eqNullSafe(F.col("want")), "left_semi").select("text")
    sets = cut(_sets(texts, k).join(chosen.select("v", "sha"), "sha").dropDuplicates(["v"]).select("v", "members"), "class-sets")
    least = threshold - 6 * math.sqrt(threshold * (1 - threshold) / (2 * Bands(threshold).n_perm))
    # First every member against the smallest member of its buckets, then all that different components share a bucket with.
    first = member.where("v <> low").groupBy("v").agg(F.min("low").alias("a")).select("a", F.col("v").alias("b"))
    tried = cut(first, "pairs")
    links = cut(_confirmed(_alike(tried, sigs, least), sets, pct), "confirmed")
    small, large = _open_buckets(member, components(links))
    pairs = cut(_pairs(small).join(tried, ["a", "b"], "left_anti"), "pairs")
    rest = _confirmed(_alike(pairs, sigs, least), sets, pct).unionByName(_blocks(large, sets, pct))
    labels = components(cut(links.unionByName(rest), "confirmed")).withColumnRenamed("id", "v")
    named = cut(classes.join(labels, "v", "left").select("sha", "least", F.coalesce("label", "v").alias("label")), "labels")
    names = named.groupBy("label").agg(F.min("least").alias("component"))
    # Written first, so that the join below can split a class that very many rows share.
    named = cut(named.join(names, "label").select("sha", "label", "component"), "components", keep)
    return rows.select("row", "id", "n", "sha").join(named, "sha", "left").drop("sha")


def _in_shared_buckets(nodes: DataFrame) -> DataFrame:
    """(key, v, low, size): bucket membership, only of buckets with two members at least, with their smallest member and size.

    Buckets are summed up within tasks first; what is known of one then goes to those of its ``SALTS`` parts that have members.
    """
    salt = F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int").alias("salt")
    all_ = nodes.select("v", salt, F.explode("keys").alias("key"))
    parts = F.bit_or(F.expr("shiftleft(1L, salt)")).alias("parts")
    shared = all_.groupBy("key").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("size"), parts).where("low <> high")
    used = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.bit_get("parts", i) == 1)
    return all_.join(shared.select("key", "low", "size", F.explode(used).alias("salt")), ["key", "salt"]).select("key", "v", "low", "size")


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """(sha, members) of the texts."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        buf, off = utf8(batch.column(0))
        for i, j in slices(off):
            sets, begin = shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], k)
            yield pa.RecordBatch.from_arrays([_digests(sets, begin), _bytes(sets, begin)], ["sha", "members"])

    return map_arrow(texts, run, "sha binary, members binary")


def _open_buckets(member: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, v, label, size): the members of small and of large buckets that hold several components."""
    labels = labels.withColumnRenamed("id", "v")
    own = cut(member.join(labels, "v", "left").select("key", "v", F.coalesce("label", "v").alias("label"), "size"), "bucket-labels")
    still = own.groupBy("key", "size").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key", "size")
    small = own.where(F.col("size") <= SMALL).join(still.where(F.col("size") <= SMALL).select("key"), "key", "left_semi")
    # A large bucket's members are dealt over parts of about PART members.
    parts = F.ceil(F.col("size") / PART).cast("int")
    many = still.where(F.col("size") > SMALL).select("key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    dealt = own.where(F.col("size") > SMALL).withColumn("part", F.pmod(F.xxhash64("v"), parts).cast("int"))
    return small, dealt.join(many, ["key", "part"], "left_semi").drop("part")


def _pairs(members: DataFrame) -> DataFrame:
    """Each pair of different components in a small bucket, once."""
    other = members.select("key", F.col("v").alias("b"), F.col("label").alias("label_b"))
    both = members.select("key", F.col("v").alias("a"), "label").join(other, "key").where("a < b AND label <> label_b")
    return both.select("a", "b").distinct()


def _blocks(members: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """Links (a, b) that join what large buckets link across components.

    A bucket is cut into chunks of about ``CHUNK`` members, and each pair of chunks is compared in one task on the full sets, by
    a matrix product. A task returns what joins its members, at most a row for each, never the pairs.
    """
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    rows = members.withColumn("chunks", chunks).withColumn("c", F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    rows = rows.select("key", "v", "label", "c", other.alias("o")).withColumn("i", F.least("c", "o")).withColumn("j", F.greatest("c", "o"))
    # A task whose members are all of one component has nothing to find.
    live = rows.groupBy("key", "i", "j").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key", "i", "j")
    rows = rows.join(live, ["key", "i", "j"], "left_semi").join(sets, "v")

    def link(part: pd.DataFrame) -> pd.DataFrame:
        _, label = np.unique(part["label"].to_numpy(), return_inverse=True)
        c = part["c"].to_numpy()
        own = [np.frombuffer(x, np.uint64) for x in part["members"]]
        size = np.array([len(x) for x in own], np.float64)
        _, column, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(own)), size.astype(np.int64))
        # Members of one set only don't count; shared ones go through the product some thousand columns at a time.
        shared = times[column] > 1
        row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((len(own), len(own)), np.float64)
        n_columns = int(column[-1]) + 1 if len(column) else 0
        for a in range(0, n_columns, 4096):
            x, y = np.searchsorted(column, [a, a + 4096])
            dense = np.zeros((len(own), min(4096, n_columns - a)), np.float32)
            dense[row[x:y], column[x:y] - a] = 1
            both += dense @ dense.T
        linked = 100 * both >= pct * (size[:, None] + size[None, :] - both)
        linked &= (label[:, None] != label[None, :]) & ((c[:, None] != c[None, :]) | (part["i"].iloc[0] == part["j"].iloc[0]))
        root = np.arange(len(own))
        while True:
            near = np.minimum(root, np.where(linked, root[None, :], len(own)).min(1))
            near = np.minimum(near, near[near])
            if (near == root).all():
                break
            root = near
        moved = np.flatnonzero(root != np.arange(len(own)))
        ids = part["v"].to_numpy()
        return pd.DataFrame({"a": ids[root[moved]], "b": ids[moved]})

    return rows.groupBy("key", "i", "j").applyInPandas(link, "a long, b long")
