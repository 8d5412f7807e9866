"""N-gram Jaccard join by vertical partitioning.

All shingles that two different sets share stand in one global order, rare ones first. The order is cut into ``FRAGMENTS`` ranges of
about equal weight, and every set into its segments in these. A pair's overlap is counted fragment by fragment and summed: small
buckets' pairs meet a row a fragment, are counted there, and a sum per pair follows; large buckets' members are compared in bounded
blocks, which add up their fragments' counts and stop once no pair can still reach its threshold.

A set of which more than the threshold leaves over are shingles of its own is linked with nothing. These are counted first, on every
``SAMPLE``-th shingle by its hash, which can only count too few: most sets are done with then, and their shingles never move again.

Which pairs meet: sets of a and b shingles at the threshold have i >= pct * (a + b) / (100 + pct) in common, so they share one of the
first ``a - ceil(pct * a / 100) + 1`` shingles of either. Shingles of one set alone come first and join nothing. At the first one that a pair shares, what either has from there on bounds the overlap; pairs below it are left out.

Sets that are equal are one class from the start. Every class is compared with one other of its buckets first, then with the smallest of
each of its buckets that is still in another component; after that a bucket's classes outside its largest component are compared
with all others of the bucket, so every pair of different components that share a bucket is decided, and no list of a group's pairs is made.

Defined cases: a text without words (or null) has an empty set and is linked with nothing. A text of fewer words than a shingle is one
shingle, its whole sequence. Rows that repeat an id are judged each by its own text. A row with a null id is linked like any other but
names no component. An empty table gives no rows. Extra columns are left out. Shingles are 64-bit hashes, sets are told apart by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, slices, utf8, working
from .graph import components
from .minhash import NUMBERS, SENT_IDS, _bytes, _digests, shingle_sets

FRAGMENTS, SAMPLE = 16, 4
#: Members of a bucket whose pairs are listed; members in a chunk of a larger one; parts that a bucket is dealt over.
SMALL, CHUNK, SALTS = 32, 256, 64


def _texts(docs: DataFrame, k: int, made, schema: str) -> DataFrame:
    """What ``made`` makes of the sorted distinct shingles of a run of rows; the text is the last column."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        buf, off = utf8(batch.column(batch.num_columns - 1))
        for i, j in slices(off):
            yield made(batch.slice(i, j - i), *shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], k))

    return map_arrow(docs, run, schema)


def _names(sets: np.ndarray, begin: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """128-bit hashes of whole sets, and 64 bits of each as a number."""
    sha = _digests(sets, begin)
    return sha, np.frombuffer(b"".join(sha.to_pylist()), np.int64)[::2]


def _shingled(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(row, id, n, sha, name): number, set size and hashes of the set."""
    kind = docs.schema[id_col].dataType.simpleString()

    def made(rows: pa.RecordBatch, sets: np.ndarray, begin: np.ndarray) -> pa.RecordBatch:
        sha, name = _names(sets, begin)
        return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.diff(begin)), sha, pa.array(name)], ["row", "id", "n", "sha", "name"])

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return _texts(texts, k, made, f"row long, id {kind}, n long, sha binary, name long")


def _alone(docs: DataFrame, k: int, text_col: str) -> DataFrame:
    """(name, alone): how many of a set's sampled shingles no other set has."""

    def made(rows: pa.RecordBatch, sets: np.ndarray, begin: np.ndarray) -> pa.RecordBatch:
        _, name = _names(sets, begin)
        first = np.zeros(len(name), bool)
        first[np.unique(name, return_index=True)[1]] = True
        owner = np.repeat(np.arange(len(name)), np.diff(begin))
        chosen = first[owner] & ((sets >> np.uint64(7)) % np.uint64(SAMPLE) == 0)
        return pa.RecordBatch.from_arrays([pa.array(name[owner[chosen]]), pa.array(sets[chosen].view(np.int64))], ["name", "token"])

    held = _texts(docs.select(text_col), k, made, "name long, token long").groupBy("token").agg(F.min("name").alias("name"), F.max("name").alias("last"))
    return held.where("name = last").groupBy("name").agg(F.count("*").alias("alone"))


def _sets(docs: DataFrame, k: int, text_col: str) -> DataFrame:
    """(sha, members) of the texts."""

    def made(rows: pa.RecordBatch, sets: np.ndarray, begin: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_digests(sets, begin), _bytes(sets, begin)], ["sha", "members"])

    return _texts(docs.select(text_col), k, made, "sha binary, members binary")


def _exploded(sets: DataFrame) -> DataFrame:
    """(v, n, token), a row a shingle."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        v, members = batch.column(0).to_numpy(), batch.column(1)
        size = np.array([len(x) // 8 for x in members.to_pylist()], np.int64)
        ends = np.cumsum(size)
        i = 0
        while i < len(v):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (1 << 17), "right")))
            tokens = np.frombuffer(b"".join(x.as_py() for x in members[i:j]), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(v[i:j], size[i:j])), pa.array(np.repeat(size[i:j], size[i:j])), pa.array(tokens)], ["v", "n", "token"])
            i = j

    return map_arrow(sets.select("v", "members"), run, "v long, n long, token long")


def _need(a: Column, b: Column, pct: int) -> Column:
    """Shingles that sets of a and b must have in common: pct * (a + b) / (100 + pct), rounded up."""
    return F.ceil(pct * (a + b) / (100 + pct) - 1e-9)


def _nodes(sets: DataFrame, pct: int) -> DataFrame:
    """(v, n, keys): the classes that may be linked, with the shared shingles of each in the global order.

    A key's number is its place in the order: the power of two below the number of sets that have it, then its hash.
    """
    rows = _exploded(sets)
    shared = rows.groupBy("token").agg(F.count("*").alias("held")).where("held > 1")
    power = F.least(F.floor(F.log2("held")), F.lit(31)).cast("long")
    shared = shared.select("token", (F.shiftleft(power, 58) + F.shiftrightunsigned("token", 6)).alias("key"))
    nodes = rows.join(shared, "token").groupBy("v", "n").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    # Shingles of this set alone fill the prefix first.
    first = F.col("n") - F.ceil(pct * F.col("n") / 100 - 1e-9) + 1 - (F.col("n") - F.size("keys"))
    return nodes.withColumn("first", first.cast("int")).where("first > 0")


def _members(nodes: DataFrame) -> DataFrame:
    """(key, v, n, rest, low, size): who holds a shingle in its prefix, of those with two holders at least; rest is what a set has of shared shingles from there on."""
    rows = nodes.select("v", "n", F.size("keys").alias("s"), F.posexplode(F.slice("keys", F.lit(1), F.col("first"))).alias("at", "key"))
    rows = rows.select("key", "v", "n", (F.col("s") - F.col("at")).alias("rest"), F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int").alias("salt"))
    parts = F.bit_or(F.expr("shiftleft(1L, salt)")).alias("parts")
    buckets = rows.groupBy("key").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("size"), parts).where("low <> high")
    used = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.bit_get("parts", i) == 1)
    return rows.join(buckets.select("key", "low", "size", F.explode(used).alias("salt")), ["key", "salt"])


def _counted(pairs: DataFrame, nodes: DataFrame, segments: DataFrame, pct: int) -> DataFrame:
    """The pairs (a, b) that are linked: partial overlaps a fragment, then a sum a pair."""
    known = nodes.select("v", "n", F.size("keys").alias("s"))
    for side in ("a", "b"):
        pairs = pairs.join(known.select(F.col("v").alias(side), F.col("n").alias(f"n_{side}"), F.col("s").alias(f"s_{side}")), side)
    n_a, n_b = F.col("n_a"), F.col("n_b")
    need = _need(n_a, n_b, pct)
    pairs = pairs.where((100 * F.least(n_a, n_b) >= pct * F.greatest(n_a, n_b)) & (F.least("s_a", "s_b") >= need))
    left = segments.select(F.col("v").alias("a"), "fragment", F.col("keys").alias("x"))
    right = segments.select(F.col("v").alias("b"), "fragment", F.col("keys").alias("y"))
    part = pairs.select("a", "b", need.alias("need")).join(left, "a").join(right, ["b", "fragment"])
    part = part.select("a", "b", "need", F.size(F.array_intersect("x", "y")).alias("both"))
    return part.groupBy("a", "b", "need").agg(F.sum("both").alias("both")).where("both >= need").select("a", "b")


def _open(member: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, v, n, rest, low, size, label, major) of the buckets that hold several components; major is the component most of them are in."""
    labels = labels.withColumnRenamed("id", "v")
    own = cut(member.join(labels, "v", "left").withColumn("label", F.coalesce("label", "v")), "bucket-labels")
    tally = own.groupBy("key", "label").agg(F.count("*").alias("n_label"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("parts"))
    most = F.max(F.struct("n_label", "label")).alias("most")
    still = tally.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), most, F.bit_or("parts").alias("parts")).where("x <> y")
    used = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.bit_get("parts", i) == 1)
    return own.join(still.select("key", F.col("most.label").alias("major"), F.explode(used).alias("salt")), ["key", "salt"])


def _listed(rows: DataFrame, pct: int) -> DataFrame:
    """Pairs of small buckets: those outside the largest component against all of other components, where the shared shingle leaves enough."""
    a = rows.where("label <> major").select("key", F.col("v").alias("a"), F.col("n").alias("n_a"), F.col("rest").alias("rest_a"), F.col("label").alias("label_a"))
    b = rows.select("key", F.col("v").alias("b"), F.col("n").alias("n_b"), F.col("rest").alias("rest_b"), "label", "major")
    both = a.join(b, "key").where("label_a <> label AND (label = major OR a < b)")
    both = both.where(F.least("rest_a", "rest_b") >= _need(F.col("n_a"), F.col("n_b"), pct))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def overlaps(left: list[np.ndarray], right: list[np.ndarray], need: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sorted key arrays, a matrix, added up a fragment at a time; it stops where no pair can reach its ``need``."""
    total = np.zeros((len(left), len(right)), np.float32)
    bounds = np.concatenate([[np.iinfo(np.int64).min], cuts, [np.iinfo(np.int64).max]])
    ends = [np.array([np.searchsorted(x, bounds) for x in side]) for side in (left, right)]
    for f in range(len(bounds) - 1):
        flat = [np.concatenate([x[e[f] : e[f + 1]] for x, e in zip(side, end, strict=True)]) for side, end in zip((left, right), ends, strict=True)]
        row = [np.repeat(np.arange(len(side)), end[:, f + 1] - end[:, f]) for side, end in zip((left, right), ends, strict=True)]
        common = np.intersect1d(*flat)
        at = [np.searchsorted(common, x) for x in flat]
        real = [(a < len(common)) & (common[np.minimum(a, len(common) - 1)] == x) if len(common) else np.zeros(len(x), bool) for a, x in zip(at, flat, strict=True)]
        for c in range(0, len(common), 4096):
            dense = []
            for side, r, a, ok in zip((left, right), row, at, real, strict=True):
                here = ok & (a >= c) & (a < c + 4096)
                m = np.zeros((len(side), min(4096, len(common) - c)), np.float32)
                m[r[here], a[here] - c] = 1
                dense.append(m)
            total += dense[0] @ dense[1].T
        rest = np.minimum((ends[0][:, -1] - ends[0][:, f + 1])[:, None], (ends[1][:, -1] - ends[1][:, f + 1])[None, :])
        if not (total + rest >= need).any():
            break
    return total


def _blocks(rows: DataFrame, nodes: DataFrame, cuts: list[int], pct: int) -> DataFrame:
    """Links (a, b) that join what large buckets link across components, by blocks of a chunk outside the largest component and a chunk of all.

    A block returns what joins its members, at most a row for each, never the pairs.
    """
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    rows = rows.select("key", "v", "n", "rest", "label", "major", chunks.alias("chunks"), F.pmod(F.xxhash64("v"), chunks).cast("int").alias("c"))
    # Chunks that have a member outside.
    outside = rows.where("label <> major").select("key", "chunks", F.col("c").alias("i")).distinct()
    on = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    left = rows.where("label <> major").select("key", "v", "n", "rest", "label", F.lit(0).alias("side"), F.col("c").alias("i"), on.alias("j"))
    right = rows.join(outside.select("key", "i"), "key").select("key", "v", "n", "rest", "label", F.lit(1).alias("side"), "i", F.col("c").alias("j"))
    both = left.unionByName(right).join(nodes.select("v", F.col("keys").alias("shingles")), "v")
    borders = np.array(cuts, np.int64)

    def link(part: pd.DataFrame) -> pd.DataFrame:
        sides = [part[part["side"] == s] for s in (0, 1)]
        if not len(sides[0]) or not len(sides[1]):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        n, rest, label, v = ([x[c].to_numpy() for x in sides] for c in ("n", "rest", "label", "v"))
        need = np.ceil(pct * (n[0][:, None] + n[1][None, :]) / (100 + pct) - 1e-9)
        able = (label[0][:, None] != label[1][None, :]) & (np.minimum(rest[0][:, None], rest[1][None, :]) >= need)
        able &= 100 * np.minimum(n[0][:, None], n[1][None, :]) >= pct * np.maximum(n[0][:, None], n[1][None, :])
        need = np.where(able, need, np.inf)
        x, y = np.flatnonzero(able.any(1)), np.flatnonzero(able.any(0))
        if not len(x):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        keys = [[np.asarray(k, np.int64) for k in side["shingles"].iloc[i]] for side, i in zip(sides, (x, y), strict=True)]
        linked = overlaps(*keys, need[np.ix_(x, y)], borders) >= need[np.ix_(x, y)]
        root = [np.arange(len(x)), len(x) + np.arange(len(y))]
        while True:
            down = np.minimum(root[0], np.where(linked, root[1][None, :], len(x) + len(y)).min(1))
            up = np.minimum(root[1], np.where(linked, down[:, None], len(x) + len(y)).min(0))
            if (down == root[0]).all() and (up == root[1]).all():
                break
            root = [down, up]
        ids, root = np.concatenate([v[0][x], v[1][y]]), np.concatenate(root)
        moved = np.flatnonzero((root != np.arange(len(ids))) & (ids[root] != ids))
        return pd.DataFrame({"a": ids[root[moved]], "b": ids[moved]})

    return both.groupBy("key", "i", "j").applyInPandas(link, "a long, b long")


def linked_groups(docs: DataFrame, k: int = 5, pct: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_shingles`` (set size), ``component_id`` (smallest id reachable over links, itself included)."""
    with working(docs.sparkSession):
        rows = cut(_shingled(docs, k, id_col, text_col), "shingle-rows", keep=True)
        classes = rows.where("n > 0").groupBy("sha", "name", "n").agg(F.min(F.struct("row", "id")).alias("m"), F.min("id").alias("least"))
        classes = cut(classes.select("sha", "name", "n", F.col("m.row").alias("v"), F.col("m.id").alias("id"), "least"), "classes")
        left_over = F.col("n") - F.ceil(pct * F.col("n") / 100 - 1e-9)
        able = classes.join(_alone(docs, k, text_col), "name", "left").where(F.coalesce("alone", F.lit(0)) <= left_over)
        able = cut(able.select("sha", "v", "id"), "able")
        wanted = able.select(F.col("id").alias("want")).distinct()
        if isinstance(docs.schema[id_col].dataType, NUMBERS) and wanted.count() <= SENT_IDS:
            wanted = F.broadcast(wanted)
        texts = docs.join(wanted, F.col(id_col).eqNullSafe(F.col("want")), "left_semi")
        sets = cut(_sets(texts, k, text_col).join(able.select("sha", "v"), "sha").dropDuplicates(["v"]).select("v", "members"), "class-sets")
        nodes = cut(_nodes(sets, pct), "class-keys")
        keys = nodes.select(F.explode("keys").alias("key"))
        # The places where the order is cut: a handful of numbers.
        cuts = keys.agg(F.percentile_approx("key", [(i + 1) / FRAGMENTS for i in range(FRAGMENTS - 1)], 1000).alias("c")).first().c
        cuts = sorted(set(cuts or []))
        ranges = list(zip([None, *cuts], [*cuts, None], strict=True))
        inside = lambda lo, hi: lambda x: (F.lit(True) if lo is None else x >= lo) & (F.lit(True) if hi is None else x < hi)
        parts = F.array(*(F.struct(F.lit(i).alias("fragment"), F.filter("keys", inside(*r)).alias("keys")) for i, r in enumerate(ranges)))
        segments = cut(nodes.select("v", F.explode(parts).alias("x")).select("v", "x.*").where(F.size("keys") > 0), "segments")
        member = cut(_members(nodes), "buckets")
        # First one other class each, then the smallest of each bucket that is in another component, then all that is left.
        first = member.where("v <> low").groupBy("v").agg(F.min("low").alias("a")).select("a", F.col("v").alias("b"))
        links = cut(_counted(first, nodes, segments, pct), "links")
        rest = _open(member, components(links))
        lows = rest.where("v = low").select("key", F.col("label").alias("label_low"))
        next_ = rest.where("v <> low").join(lows, "key").where("label <> label_low").select(F.col("low").alias("a"), F.col("v").alias("b")).distinct()
        links = cut(links.unionByName(_counted(next_, nodes, segments, pct)), "links")
        rest = cut(_open(member, components(links)), "open-buckets")
        small = _counted(_listed(rest.where(F.col("size") <= SMALL), pct), nodes, segments, pct)
        large = _blocks(rest.where(F.col("size") > SMALL), nodes, cuts, pct)
        labels = components(cut(links.unionByName(small).unionByName(large), "links")).withColumnRenamed("id", "v")
        named = cut(classes.join(labels, "v", "left").select("sha", "least", F.coalesce("label", "v").alias("label")), "labels")
        names = named.groupBy("label").agg(F.min("least").alias("component"))
        named = cut(named.join(names, "label").select("sha", "component"), "components", keep=True)
    out = rows.join(named, "sha", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))
