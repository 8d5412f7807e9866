"""Write-once content store, published snapshots, and stores that are read back after a write."""

from __future__ import annotations

import contextlib
import json
import re
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def put(rows: DataFrame, path: str, payload: str) -> int:
    """Store payloads under their SHA-256; those that are there already are left alone. Returns how many were new.

    New rows go to a folder with a name of its own, so nothing that is stored is ever written again and two writers don't
    mix; a payload that both bring at once is stored by both, and ``get`` returns it once.
    """
    spark = rows.sparkSession
    new = rows.select(F.sha2(F.col(payload), 256).alias("sha256"), F.col(payload).cast("binary").alias("bytes")).where("bytes IS NOT NULL").groupBy("sha256").agg(F.first("bytes").alias("bytes"))
    new = new.withColumn("size", F.octet_length("bytes").cast("long"))
    if exists(spark, path):
        new = new.join(spark.read.parquet(path).select("sha256"), "sha256", "left_anti")
    part = f"{path}/batch={uuid.uuid4().hex}"
    new.write.option("compression", "zstd").parquet(part)
    return spark.read.parquet(part).count()


def _batched(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return any(s.getPath().getName().startswith("batch=") for s in fs.listStatus(p))


def get(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, bytes, size); a row whose bytes don't have its digest or size stops the job."""
    stored = spark.read.parquet(path).withColumn("batch", F.col("batch").cast("string")) if _batched(spark, path) else spark.read.parquet(path).withColumn("batch", F.lit(""))
    # Payloads that two writers stored at once: few, and found by their digests alone, without moving bytes.
    twice = stored.select("sha256", "batch").groupBy("sha256").agg(F.count("*").alias("n"), F.min("batch").alias("first")).where("n > 1")
    stored = stored.join(twice.select("sha256", "first"), "sha256", "left").where("first IS NULL OR batch = first")
    fine = (F.sha2("bytes", 256) == F.col("sha256")) & (F.octet_length("bytes") == F.col("size"))
    checked = F.when(fine, F.col("bytes")).otherwise(F.raise_error(F.concat(F.lit("damaged blob "), F.col("sha256"))).cast("binary"))
    return stored.select("sha256", checked.alias("bytes"), "size")


def references(held: DataFrame, blobs: DataFrame, live: list[int]) -> DataFrame:
    """(sha256, n_refs, n_live) of every blob: by how many snapshots it is referred to, and by how many of the ``live`` ones.

    ``held``: (snapshot, sha256), a row or more a reference. A blob that no live snapshot refers to may go. ``live`` are snapshots
    that are kept or leased, a handful of numbers.
    """
    once = held.select("snapshot", "sha256").distinct()
    counted = once.groupBy("sha256").agg(F.count("*").alias("n_refs"), F.count_if(F.col("snapshot").isin(live)).alias("n_live"))
    return blobs.select("sha256").distinct().join(counted, "sha256", "left").select("sha256", F.coalesce("n_refs", F.lit(0)).alias("n_refs"), F.coalesce("n_live", F.lit(0)).alias("n_live"))


def collect_blobs(spark: SparkSession, path: str, wanted: DataFrame) -> int:
    """Take all blobs away that ``wanted`` (sha256) doesn't name; returns how many. No ``put`` may run meanwhile.

    A batch of which all is wanted stays as it is. What others keep is written to a new batch first and then they go, so at every
    moment each wanted blob is stored, perhaps twice, and ``get`` returns it once.
    """
    stored = spark.read.parquet(path).withColumn("batch", F.col("batch").cast("string"))
    marked = stored.select("sha256", "batch").join(wanted.select("sha256", F.lit(True).alias("live")).distinct(), "sha256", "left")
    counts = marked.groupBy("batch").agg(F.count_if(F.col("live").isNull()).alias("dead")).where("dead > 0").collect()
    if not counts:
        return 0
    old = [r.batch for r in counts]  # folders, not blobs
    stay = stored.where(F.col("batch").isin(old)).join(wanted.select("sha256").distinct(), "sha256", "left_semi").drop("batch")
    stay.write.option("compression", "zstd").parquet(f"{path}/batch={uuid.uuid4().hex}")
    fs, _ = _fs(spark, path)
    for batch in old:
        fs.delete(_path(spark, f"{path}/batch={batch}"), True)
    return sum(r.dead for r in counts)


def _path(spark: SparkSession, name: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)


def _write(spark: SparkSession, name: str, text: str) -> None:
    fs, p = _fs(spark, name)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read(spark: SparkSession, name: str) -> dict | None:
    """A small JSON file; None where there is none."""
    fs, p = _fs(spark, name)
    if not fs.exists(p):
        return None
    source = fs.open(p)
    try:
        size = fs.getFileStatus(p).getLen()
        return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(source, int(size))).decode())
    finally:
        source.close()


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _fs(spark, folder)
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


def _versions(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(m[1]) for m in (re.fullmatch(r"version-(\d{12})", n) for n in _names(spark, root)) if m)


def _version(root: str, number: int) -> str:
    return f"{root}/version-{number:012d}"


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], expected: int | None = None) -> int:
    """Write a snapshot of several tables and make it the one after ``expected``, or after whatever is active then; returns its number.

    Tables go to a folder of their own name and are read back: the manifest has a receipt (rows) of each. The manifest is laid in a
    folder aside, which is then renamed to ``version-<n>``, n being the predecessor's number and one. Of several writers that follow
    one predecessor exactly one finds no such folder: that rename, in one step, publishes; the others' manifests are not the one they
    find there, and they fail (with ``expected``) or go on to the next number. A writer that is stopped has published all or nothing;
    what it leaves is taken away by ``sweep``. The root needs a file system that renames folders in one step, as HDFS and local ones do.
    """
    me = uuid.uuid4().hex
    fs, base = _fs(spark, root)
    fs.mkdirs(base)
    if expected is not None and (active(spark, root) or 0) != expected:
        raise RuntimeError(f"snapshot {active(spark, root)} has become active")
    receipts = {}
    for name, df in tables.items():
        df.write.option("compression", "zstd").parquet(f"{root}/data-{me}/{name}")
        receipts[name] = spark.read.parquet(f"{root}/data-{me}/{name}").count()
    manifest = {"data": f"data-{me}", "tables": sorted(tables), "receipts": receipts}
    while True:
        number = (active(spark, root) or 0 if expected is None else expected) + 1
        aside = f"{root}/aside-{me}"
        _write(spark, f"{aside}/manifest.json", json.dumps(manifest | {"snapshot": number}))
        fs.rename(_path(spark, aside), _path(spark, _version(root, number)))
        found = _read(spark, f"{_version(root, number)}/manifest.json")
        if found and found["data"] == manifest["data"]:
            return number
        # Another was first; a file system may have moved the folder into that one's.
        for left in (aside, f"{_version(root, number)}/aside-{me}"):
            fs.delete(_path(spark, left), True)
        if expected is not None:
            fs.delete(_path(spark, f"{root}/data-{me}"), True)
            raise RuntimeError(f"snapshot {active(spark, root)} has become active")


def active(spark: SparkSession, root: str) -> int | None:
    """The newest published snapshot."""
    return max(_versions(spark, root), default=None)


def pinned(spark: SparkSession, root: str, snapshot: int | None = None) -> dict[str, DataFrame]:
    """All tables of one snapshot, resolved once; later publications don't change them, a sweep may unless there is a lease (``leased``)."""
    number = active(spark, root) if snapshot is None else snapshot
    found = None if number is None else _read(spark, f"{_version(root, number)}/manifest.json")
    if found is None:
        raise LookupError("no such published snapshot")
    return {name: spark.read.parquet(f"{root}/{found['data']}/{name}") for name in found["tables"]}


def _leases(spark: SparkSession, root: str, now: float) -> set[int]:
    """Snapshots with a lease that hasn't run out."""
    found = (re.fullmatch(r"(\d+)-(\d+)-[0-9a-f]+", n) for n in _names(spark, f"{root}/leases"))
    return {int(m[1]) for m in found if m and int(m[2]) >= 1000 * now}


def renew(spark: SparkSession, root: str, snapshot: int, seconds: float, old: str | None = None) -> str:
    """A lease on a snapshot for so long from now on, instead of the ``old`` one; returns its name."""
    name = f"{root}/leases/{snapshot}-{int(1000 * (time.time() + seconds))}-{uuid.uuid4().hex}"
    _write(spark, name, "")
    if old:
        _fs(spark, old)[0].delete(_path(spark, old), False)
    # Only now is it sure that no sweep has begun to take the snapshot away: one that begins later sees the lease.
    if not exists(spark, f"{_version(root, snapshot)}/manifest.json"):
        _fs(spark, name)[0].delete(_path(spark, name), False)
        raise LookupError("no such published snapshot")
    return name


@contextlib.contextmanager
def leased(spark: SparkSession, root: str, seconds: float, snapshot: int | None = None) -> Iterator[dict[str, DataFrame]]:
    """``pinned`` under a lease: no sweep takes the snapshot away inside, for ``seconds`` at most unless it is renewed."""
    number = active(spark, root) if snapshot is None else snapshot
    if number is None:
        raise LookupError("no such published snapshot")
    name = renew(spark, root, number, seconds)
    try:
        yield pinned(spark, root, number)
    finally:
        _fs(spark, name)[0].delete(_path(spark, name), False)


def sweep(spark: SparkSession, root: str, keep: int = 1, grace: float = 86_400) -> list[int]:
    """Take away all snapshots but the ``keep`` newest and those under a lease; returns their numbers.

    A snapshot is renamed first, so no new lease can be had; one that was had just before is looked for again after that, and the
    snapshot comes back. Leases that have run out, tables without a manifest and manifests never published go once older than ``grace``
    seconds: their writer may be at work till then.
    """
    fs, _ = _fs(spark, root)
    gone = []
    for number in _versions(spark, root)[: -max(1, keep)]:
        if number in _leases(spark, root, time.time()):
            continue
        there, away = _version(root, number), f"{root}/condemned-{number:012d}"
        if not fs.rename(_path(spark, there), _path(spark, away)):
            continue
        if number in _leases(spark, root, time.time()):
            fs.rename(_path(spark, away), _path(spark, there))
            continue
        found = _read(spark, f"{away}/manifest.json")
        if found:
            fs.delete(_path(spark, f"{root}/{found['data']}"), True)
        fs.delete(_path(spark, away), True)
        gone.append(number)
    used = {m["data"] for m in (_read(spark, f"{root}/{n}/manifest.json") for n in _names(spark, root) if n.startswith(("version-", "condemned-"))) if m}
    for folder in (root, f"{root}/leases"):
        for name in _names(spark, folder):
            status = fs.getFileStatus(_path(spark, f"{folder}/{name}"))
            left = name.startswith(("aside-", "data-")) and name not in used if folder == root else True
            expiry = int(name.split("-")[1]) if folder != root else status.getModificationTime()
            if left and expiry < 1000 * (time.time() - grace):
                fs.delete(_path(spark, f"{folder}/{name}"), True)
    return gone
