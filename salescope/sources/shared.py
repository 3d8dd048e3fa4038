"""Tables that are written once to shared storage and read many times.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Written
Parquet survives the loss of executors, unlike a cached or locally checkpointed
frame, and later queries prune its columns and partitions.

Landed tables and other folders made here belong to the application. They are deleted when it ends in
good order, or earlier by :func:`release`, alone or all of those made inside a ``with landing(spark)``.
"""

from __future__ import annotations

import atexit
import logging
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_log = logging.getLogger(__name__)
_landed: dict[str, list[str]] = {}
_local_dirs: dict[str, str] = {}
_published: dict[tuple[str, str, str], tuple[DataFrame, str]] = {}

#: Deletes the shuffle files of a query when it ends, and not when the driver collects its garbage.
NO_LEFTOVERS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors reach, without a trailing slash."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to storage that every executor can reach")
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="salescope-")
        _log.warning("spark.checkpoint.dir is not set; tables are landed in %s", _local_dirs[app])
    return _local_dirs[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has written yet; it is the application's to delete."""
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/salescope/{app}/{name}-{uuid.uuid4().hex[:12]}"
    _landed.setdefault(app, []).append(path)
    return path


def release(spark: SparkSession, *paths: str) -> None:
    """Deletes landed tables and other folders: those at ``paths``, or all of the application.

    Frames that still read them fail from then on.
    """
    app = spark.sparkContext.applicationId
    known = _landed.get(app, [])
    for path in list(paths) or list(known):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        if path in known:
            known.remove(path)
    for key in [k for k, (_, path) in _published.items() if k[0] == app and path not in known]:
        del _published[key]


@contextmanager
def landing(spark: SparkSession) -> Iterator[None]:
    """Releases at its end what was landed inside."""
    app = spark.sparkContext.applicationId
    before = set(_landed.get(app, []))
    try:
        yield
    finally:
        if inside := [p for p in _landed.get(app, []) if p not in before]:
            release(spark, *inside)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session that hold inside; a stream that starts there keeps them."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


@atexit.register
def _release_at_exit() -> None:
    """Deletes what the application has left, if its session can still be reached."""
    context = SparkContext._active_spark_context
    if context is not None and _landed.get(context.applicationId):
        with suppress(Py4JError, OSError):
            release(SparkSession.builder.getOrCreate())


def land(
    df: DataFrame,
    name: str,
    partition_by: str | None = None,
    path: str | None = None,
    rebalance: bool = True,
    compression: str | None = None,
) -> DataFrame:
    """Writes ``df`` to a new table in the shared folder and returns the table.

    A ``path`` of the caller is used as it is and stays the caller's to delete. With
    ``partition_by`` the rows are rebalanced on that column first: AQE merges
    small partitions into few files and splits a partition that holds far more
    rows than the others, so no value is written by one task alone. Without ``rebalance`` the rows
    come like that already. ``compression`` is that of the session by default.
    """
    spark = df.sparkSession
    if path is None:
        path = fresh_path(spark, name)
    rows = df.hint("rebalance", partition_by) if partition_by and rebalance else df
    writer = rows.write.partitionBy(partition_by) if partition_by else rows.write
    with settings(spark, NO_LEFTOVERS):
        writer.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def publish(
    spark: SparkSession,
    name: str,
    source: str,
    build: Callable[[], DataFrame],
    partition_by: str | None = None,
    rebalance: bool = True,
) -> DataFrame:
    """The landed ``build()``; written once per application and ``source``, in few bytes."""
    app = spark.sparkContext.applicationId
    key = (app, name, source)
    if key not in _published:
        df = build()
        _published[key] = land(df, name, partition_by, rebalance=rebalance, compression="zstd"), _landed[app][-1]
    return _published[key][0]
