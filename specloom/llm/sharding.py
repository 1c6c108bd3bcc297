"""Contiguous byte-balanced shards from global prefix sums, in DataFrame functions only.

Rows are dealt into ranges of doc_id and sorted within them; the ranges' byte totals (a row per
partition, however large the corpus) are summed up to give each range its starting offset, and a
running sum inside each range gives every row its global byte offset. The axis from 0 to the total
is cut at equal targets: a row belongs to the shard in which its middle byte lies, so shards are
contiguous in doc_id and no shard is off its target by more than one row. Only (doc_id, size,
checksum) rows shuffle; texts never do.

Defined cases: a null text has no bytes, hence size 1; null doc_ids sort last; rows that repeat a
doc_id, and so tie, keep the order in which they were read; a text longer than a shard's target fills
a shard of its own or more than its share, and shards may stay empty beside it; an empty table gives
an empty result; further columns are ignored or, by `write_shards`, carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh_path, free_name, order_key, text_of


def _sized(docs: DataFrame, id_column: str, text_column: str, row_column: str | None) -> DataFrame:
    return docs.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(text_of(text_column)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text_of(text_column), "UTF-8")).alias("text_crc32"),
        order_key(id_column).alias("k"),
        (F.col(row_column) if row_column else F.monotonically_increasing_id()).alias("row"),
    )


def assign_shards(docs: DataFrame, shards: int = 8, id_column: str = "doc_id", text_column: str = "text", row_column: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null under this law), row (row_column, or as read)."""
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = _sized(docs, id_column, text_column, row_column).repartitionByRange(ranges, "k", "row").withColumn("part", F.spark_partition_id())
    dealt = cut(dealt, "shard-ranges")  # fixes which range a row is in
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    # one row per range: this window runs over partitions, not over documents
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte_offset"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row_offset"),
        F.sum("bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    within = Window.partitionBy("part").orderBy("k", "row")
    placed = (
        dealt.withColumn("upto", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(within).cast("long") - 1)
        .join(F.broadcast(offsets), "part")  # at most `ranges` rows
        .withColumn("start", F.col("byte_offset") + F.col("upto") - F.col("size"))
        .withColumn("index", F.col("row_offset") + F.col("nth"))
        .withColumn("shard", F.expr(f"cast(((2 * start + size) * {shards}) div (2 * total) as int)"))
        .select("doc_id", "size", "text_crc32", "shard", "index", "row")
    )
    placed = cut(placed, "shard-placed")
    firsts = placed.groupBy("shard").agg(F.min("index").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(  # at most `shards` rows
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("index") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row"
    )


def write_shards(docs: DataFrame, path: str | None = None, shards: int = 8, id_column: str = "doc_id", text_column: str = "text") -> str:
    """Write the documents as Parquet under path, a folder per shard, in slot order within a file; returns the path.

    The documents are read once and stored with a row number, so rows keep their identity."""
    path = path or fresh_path(docs.sparkSession, "shards")
    row, shard, slot = (free_name(docs.columns, x) for x in ("_row", "shard", "slot"))
    stored = cut(docs.withColumn(row, F.monotonically_increasing_id()), "shard-documents")
    places = assign_shards(stored, shards, id_column, text_column, row).select(F.col("row").alias(row), F.col("shard").alias(shard), F.col("slot").alias(slot))
    tagged = stored.join(places, row).drop(row)
    tagged.repartitionByRange(F.col(shard), F.col(slot)).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
    return path
