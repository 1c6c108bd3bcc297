"""What the operators of this subpackage share: the shared folder, cut lineage, free column names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_LONG = 2**63 - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A session on one machine (tests) gets a folder of its own where that is unset; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that all of them see")
        base = "file://" + tempfile.mkdtemp(prefix="specloom-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/specloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, by: Iterable[str] = ()) -> DataFrame:
    """Write df to the shared folder (a folder for each value of the columns `by`) and read it back: its lineage ends there, and lost executors lose nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder through the file system that Spark uses for it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def remove_intermediates(spark: SparkSession) -> None:
    """Remove all tables that this application's operators have cut: for the caller, once the results are stored."""
    remove(spark, f"{shared_dir(spark)}/specloom/{spark.sparkContext.applicationId}")


def by_shuffle(df: DataFrame) -> DataFrame:
    """df as a side that is joined by shuffle: for tables that grow with the input. Below spark.sql.autoBroadcastJoinThreshold Spark would build
    their hash table on the driver, and numbers that fill 10 MB of files fill some hundred MB there."""
    return df.hint("merge")


def free_name(taken: Iterable[str], wish: str) -> str:
    """wish, or wish with underscores so that it clashes with no column (names compare without case)."""
    low = {c.lower() for c in taken}
    while wish.lower() in low:
        wish += "_"
    return wish


def order_key(column: str):
    """Ids in ascending order with nulls last, as a long."""
    return F.coalesce(F.col(column).cast("long"), F.lit(MAX_LONG))


def text_of(column: str = "text"):
    """Null counts as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def in_sample(key: str, rows: int, of: int):
    """True for about rows (a fifth more) of `of` keys, by their hashes alone, so that a bounded sample is drawn from few rows."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 30)) <= min(1 << 30, int(1.2 * rows / max(1, of) * (1 << 30)) + 1)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, for mapInArrow, and at the end of each partition what it has freed goes back to the system: Spark reuses its Python
    workers, and allocators keep what the largest partition of any earlier stage took."""

    def tidied(batches: Iterator) -> Iterator:
        import ctypes
        import gc

        import pyarrow as pa

        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return tidied


def slices(batch, column: str, most: int = 2 << 20):
    """Cut an Arrow batch so that each slice holds at most `most` bytes of the column, or one row."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)), dtype=np.int64)
    at = 0
    while at < len(ends):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, upto - at)
        at = upto
