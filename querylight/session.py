"""Session helper and table staging."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}
_written: list[str] = []
# What the innermost `scratch` block of this thread has staged.
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def local_session(cores: int | str = "*", app: str = "querylight") -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def stage_root(spark: SparkSession) -> str:
    """The shared folder for staged tables: `spark.checkpoint.dir` when the session names one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="querylight-")
    return _local_roots[context.applicationId]


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the stage root."""
    path = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    if (scope := _scope.get()) is not None:
        scope.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_stages(spark: SparkSession) -> int:
    """Delete the staged tables of this process; call it once the results built on them are written."""
    count = 0
    while _written:
        count += _delete(spark, _written.pop())
    return count


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables staged in the block when it ends, but for those handed to the function it gives.

    What is read after the block must come from kept tables or other sources; a lost executor's work is then
    done again from those. Blocks may be nested: a table kept by an inner one ends with the outer one, unless kept again.
    A block deletes what its own thread staged, so blocks of several threads leave each other's tables alone.
    """
    mine: list[str] = []
    kept: set[str] = set()
    outer = _scope.set(mine)

    def keep(staged: DataFrame) -> DataFrame:
        kept.add(staged._staged_at)
        return staged

    try:
        yield keep
    finally:
        _scope.reset(outer)
        around = _scope.get()
        for path in mine:
            if path in kept:
                if around is not None:
                    around.append(path)
            elif path in _written:
                _written.remove(path)
                _delete(spark, path)


def release(staged: DataFrame) -> None:
    """Delete one staged table; nothing built on it is read any more."""
    _written.remove(staged._staged_at)
    _delete(staged.sparkSession, staged._staged_at)


def stage(df: DataFrame, name: str = "stage", by: str | None = None) -> DataFrame:
    """Write `df` once and continue from the written table, with a folder for each value of its last column when that is `by`.

    The lineage ends at files that outlive a lost executor, a plan that reads the table more than
    once computes it once, and Catalyst sees the true size when it picks join strategies.
    """
    path = stage_path(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged._staged_at = path
    return staged


def by_merge(df: DataFrame) -> DataFrame:
    """The side of a join that is never sent whole to all tasks.

    Spark takes rows that an explode made, or groups of them, for as small as the scan below, and a broadcast of many
    times that size then meets in the driver.
    """
    return df.hint("merge")


# Rows of an Arrow batch that Python works on at a time, so that what it makes of them is small beside the batch itself.
SLICE_ROWS = 256


# Bytes of rows that Spark hands to Python at a time.
ARROW_BYTES = 4 << 20


def small_arrow_batches(spark: SparkSession, size: int = ARROW_BYTES) -> None:
    """From now on the session hands rows to Python in Arrow batches of about `size` bytes, a row at least.

    Spark's own limit lets a task hold 64 MB of rows twice, beside the JVM's heap and in its Python worker.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def spread(scan: DataFrame) -> DataFrame:
    """A scan that yields fewer splits than there are cores, dealt out to all of them.

    For work that costs much CPU per row. A table of many files has splits enough and passes
    through untouched, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def fan_out(df: DataFrame) -> DataFrame:
    """Aggregated rows dealt out to all shuffle partitions.

    Adaptive execution merges shuffle partitions that are small in bytes; rows that cost much CPU
    each would then meet in few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
