"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[str] = []
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)
_gathered: ContextVar[list[str] | None] = ContextVar("gathered", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where that is unset in a local session, as in tests, a temporary folder stands in for it; on a cluster that is an error,
    since executors could not read the driver's own folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lontarix-")
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A fresh path in the shared folder. Within ``working`` it is deleted at the end, unless it is to ``keep``."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    for names in ([] if keep else [_scope.get()]) + [_gathered.get()]:
        if names is not None:
            names.append(path)
    return path


def cut(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later plans start from the table.

    A lost executor costs no more than the tasks that read the table again. Within ``working`` the table is deleted at the end,
    unless it is to ``keep``.
    """
    spark = df.sparkSession
    path = scratch(spark, name, keep)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` over all of the session's shuffle partitions.

    Adaptive planning joins partitions up to 64 MB as they are compressed, which for numbers is many times that in memory, sorted and
    grouped; partitions whose number is given stay apart, so a task's memory goes by the rows there are.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def fewer(df: DataFrame, most: int, name: str) -> DataFrame:
    """``df``, written; one of at most ``most`` rows is sent to every task, where what it is joined to needs no shuffle."""
    table = cut(df, name)
    return F.broadcast(table) if table.count() <= most else table


@contextlib.contextmanager
def working(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread writes inside are deleted at the end, but for those it keeps: what is returned may depend on these alone.

    Scopes nest: what an inner scope keeps stays at the end of outer ones too, until ``release``.
    """
    own: list[str] = []
    token = _scope.set(own)
    try:
        yield
    finally:
        _scope.reset(token)
        release(spark, own)


@contextlib.contextmanager
def gathered() -> Iterator[list[str]]:
    """The list of all tables that this thread writes inside, kept ones too, for ``release`` once no result needs them."""
    names: list[str] = []
    token = _gathered.set(names)
    try:
        yield names
    finally:
        _gathered.reset(token)


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete ``paths``, or every table that ``cut`` and ``scratch`` made so far. No result that is still needed may depend on them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in list(_written) if paths is None else paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
    if paths is None:
        _written.clear()
