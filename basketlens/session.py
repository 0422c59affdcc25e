"""Session settings, and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Settings the jobs count on. The last two keep a hot key from pinning its rows to one task:
# an aggregate re-shuffles on all its keys instead of inheriting a join's partitioning, and
# a skewed join is split even when that costs a later shuffle.
SKEW_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.requireAllClusterKeysForDistribution": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def build_session(app: str = "basketlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew-join handling and UTC dates.

    ``master`` and any further settings are left to ``spark-submit`` unless given.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in SKEW_SETTINGS.items():
        builder = builder.config(key, value)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside the block only."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    In one process (master ``local[...]``, as in tests) a scratch folder takes its place where it
    is unset; on a cluster it has to be set.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_KEY, None) or context.getCheckpointDir()
    if not folder:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="basketlens-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


# Tables that the innermost `temporary` block owns.
_OWNED: ContextVar[list[str] | None] = ContextVar("owned", default=None)


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there.

    Losing executors afterwards costs a re-read of the file, never a recomputation. The shuffle
    files of the job go when it ends, since the table takes their place. Inside a ``temporary``
    block the table goes with the block.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    owned = _OWNED.get()
    if owned is not None:
        owned.append(path)  # before writing: a write that fails leaves nothing behind either
    with settings(spark, {CLEANUP_KEY: "true"}):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store holds it; nothing happens where there is none."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that ``written`` makes inside the block when it ends, also by an error.

    Nothing that leaves the block may still read them: collect it there, or use ``settled``.
    """
    paths: list[str] = []
    token = _OWNED.set(paths)
    try:
        yield
    finally:
        _OWNED.reset(token)
        for path in paths:
            remove(spark, path)


def settled(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """The frame that ``build`` makes, written; the tables that were written on the way are removed."""
    outer, inner = _OWNED.get(), None
    with temporary(spark):
        frame = build()
        token = _OWNED.set(outer)
        try:
            inner = written(frame)
        finally:
            _OWNED.reset(token)
    return inner
