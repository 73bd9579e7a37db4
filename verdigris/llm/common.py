"""What the operators of this subpackage share: the shared folder, written tables, batches of texts."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only on one machine (tests) may that be unset; a temporary folder is set then."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not known:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="verdigris-")
        sc.setCheckpointDir(known)
    return known.rstrip("/")


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for the plans that are run inside, and its old value afterwards."""
    old = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to a new table in the shared folder and read it back: cuts the lineage, survives lost executors.

    The shuffle files of the plan go once it is written; ``discard`` deletes a table that is no longer needed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/verdigris/{uuid.uuid4().hex}/{name}"
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that no plan reads any more; other frames are left alone."""
    for t in tables:
        if path := getattr(t, "_written_to", None):
            at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at.getParent(), True)


#: Rows of texts that go to a Python worker at once; a batch, its copy as bytes and its results are what a worker holds.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> contextlib.AbstractContextManager:
    """Bounds the memory of the workers of the plans that are run inside."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: What a worker keeps from task to task, by name, and how to drop it.
_KEPT: dict[str, Callable[[], None]] = {}


def kept(name: str, drop: Callable[[], None]) -> None:
    _KEPT[name] = drop


class trimmed:  # noqa: N801
    """The work of a task on its batches. Its worker first drops what it has kept for other work than ``keeps``; afterwards, as it
    waits for other tasks, it gives unused memory back."""

    def __init__(self, work: Callable[[Iterable], Iterator], keeps: str = "") -> None:
        self.work, self.keeps = work, keeps

    def __call__(self, batches: Iterable) -> Iterator:
        for name, drop in list(_KEPT.items()):
            if name != self.keeps:
                drop()
        try:
            yield from self.work(batches)
        finally:
            pyarrow.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL("libc.so.6").malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: str = "text") -> Column:
    """The text as UTF-8 bytes, null as empty. Python workers then never decode it."""
    return F.coalesce(F.col(column).cast("string").cast("binary"), F.lit("").cast("binary"))


def exact(df: DataFrame) -> DataFrame:
    """df with whole numbers as text: pandas holds a column of them with nulls as floats, which are not exact."""
    return df.withColumns({f.name: F.col(f.name).cast("string") for f in df.schema if isinstance(f.dataType, IntegralType)})


def as_in(df: DataFrame, like: DataFrame) -> DataFrame:
    """df with the columns that it shares with ``like`` in the types they have there."""
    kinds = {f.name: f.dataType for f in like.schema}
    return df.select(*(F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in df.columns))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def chunks(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts with about ``limit`` bytes together; a longer text stands alone."""
    i = size = 0
    for j, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield i, j
            i, size = j, 0
        size += len(t) + 1
    if i < len(texts):
        yield i, len(texts)
