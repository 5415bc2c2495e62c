"""Session defaults and durable scratch storage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
_WRITTEN: list[str] = []  # paths of intermediate tables, in order


def build_session(app: str = "gapfill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; the cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for name, value in {**defaults, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Only on one machine (master ``local``), where nothing is configured, a temporary folder is set; it goes when
    Python ends. Elsewhere executors would not see each other's files, so a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        folder = tempfile.TemporaryDirectory(prefix="gapfill-")
        atexit.register(folder.cleanup)
        root = folder.name
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables that were written inside, once the plan's result is stored elsewhere."""
    before = len(_WRITTEN)
    try:
        yield
    finally:
        paths = _WRITTEN[before:]
        del _WRITTEN[before:]
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path in paths:
            at = hadoop(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below :func:`scratch_root`."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def materialize(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage and survives lost executors. ``codec`` overrules the session's."""
    path = scratch_path(df.sparkSession, name)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Size of the tables below ``df`` as the planner knows it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def spread(df: DataFrame, bytes_per_task: int = 16 << 20) -> DataFrame:
    """Spread a small input over all cores before CPU-heavy work.

    A single small file is one task however many cores there are. When the tables below ``df`` are
    larger than ``bytes_per_task`` per core, the scan has split them already and ``df`` is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if input_bytes(df) < cores * bytes_per_task else df


def gather(df: DataFrame, rows: int, rows_per_task: int = 2_000) -> DataFrame:
    """Fewer, fuller partitions for a small table that an iterative fit reads many times."""
    wanted = max(1, -(-rows // rows_per_task))
    return df.coalesce(wanted) if wanted < df.sparkSession.sparkContext.defaultParallelism else df


def in_parallel(calls: Sequence[Callable[[], T]], threads: int = 4) -> list[T]:
    """Run independent driver-side steps (such as model fits) side by side, results in order."""
    if len(calls) < 2:
        return [call() for call in calls]
    wrap = inheritable_thread_target(SparkSession.active())
    with ThreadPool(min(threads, len(calls))) as pool:
        return pool.map(lambda call: call(), [wrap(c) for c in calls])
