"""Helpers that operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Sides with at most so many rows may be broadcast; a section taxonomy has some thousands.
SMALL_ROWS = 200_000


def small_or_plain(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df with a broadcast hint if a counted look shows it small, else as it is: larger sides join by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def held(df: DataFrame) -> DataFrame:
    """df as it is now: checkpointed in the session's folder for that, so that lost executors lose nothing. For rows whose partition must not
    change between two reads. A session on one machine without such a folder persists; a cluster must name one."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    if spark.sparkContext.getCheckpointDir():
        return df.checkpoint()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that all of them see")
    return df.persist()


def numbered(df: DataFrame, order: list[str], name: str = "_pos") -> DataFrame:
    """df with the positions of its rows in the given order, from 0.

    Rows are dealt by ranges of the order and counted by partition, so no task sees more than its range, whatever the keys."""
    rows = held(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(name, 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = rows.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return joined.withColumn(name, F.col(name).bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")).drop("_part", "_before")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for files of one run, below the session's shared folder; of this machine only where the session runs on one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that all of them see")
        base = "file://" + tempfile.mkdtemp(prefix="specloom-")
    return f"{base.rstrip('/')}/specloom/{name}-{uuid.uuid4().hex}"
