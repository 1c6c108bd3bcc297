"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 notes each text's hash as one place in a sparse bitmap: the bitmap is kept in chunks of 2^31
places, a list of four-byte places each, to which every task adds one row a chunk, so what travels is
a few bytes a text and no row of its own. A place that is listed twice may be a repeated hash; the
repeated ones form the second, dense Bloom filter, at most `filter_bits` large and hence fit for a
broadcast. Pass 2 tests each row: a row whose bits are not both set cannot have a copy and passes
straight through; only the others shuffle, to the exact grouping on the full SHA-256.

Capacity follows the rows: above one row in 16 bits, the hash space is cut into slices, each with
filters of its own, and the hashed rows are stored by slice, so each is read once. Hashes so frequent
that a sample of about SAMPLE rows shows them HOT times are marked at once and not listed, so no list
grows with a hot text; the sample has no say in the result.

Defined cases: a null text counts as empty; a null doc_id sorts after every other; rows that
repeat a doc_id with an equal text count as copies, of which one (the first read) stays; long texts
are hashed whole; of ties on doc_id the row read first stays; an empty table gives an empty result;
columns beside doc_id and text are carried, whatever their names. Documents are read once and stored
with their hashes (and, by `exact_dedup`, with all their columns), so rows keep their identity.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import MAX_LONG, by_shuffle, cut, text_of

#: A run of white space other than a single space; replacing these equals replacing every run.
RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
CHUNK_ROWS = 1 << 20  # rows noted in one chunk of the sparse bitmap
SAMPLE, HOT = 20_000, 20


def normalised(column: str = "text") -> Column:
    """The text with each run of spaces and [\\t-\\r] as one space."""
    return F.regexp_replace(text_of(column), RUNS, " ")


def hot_hashes(hashed: DataFrame, rows: int) -> DataFrame:
    """(h): hashes that a bounded sample of the rows shows many times."""
    every = max(1, rows // SAMPLE)
    sample = hashed.where(F.pmod(F.xxhash64("row"), F.lit(every)) == 0) if every > 1 else hashed
    return sample.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {HOT}").select("h")


def sparse_bitmap(hashed: DataFrame, hot: DataFrame, rows: int) -> DataFrame:
    """(chunk, places): the places that the hashes of all rows but the hot ones take, ascending, as often as they are taken."""
    chunks = -(-rows // CHUNK_ROWS)
    noted = hashed.join(F.broadcast(hot), "h", "left_anti")  # at most 2 SAMPLE / HOT hashes
    noted = noted.select(F.expr(f"h % {max(1, chunks)}").alias("chunk"), F.expr(f"cast((h div {max(1, chunks)}) & 2147483647 as int)").alias("place"))
    return noted.groupBy("chunk").agg(F.sort_array(F.collect_list("place")).alias("places"))


def repeated(bitmap: DataFrame) -> DataFrame:
    """(chunk, place) of places taken twice or more."""
    again = F.filter("places", lambda p, i: p == F.get(F.col("places"), i - 1))
    return bitmap.select("chunk", F.explode(F.array_distinct(again)).alias("place"))


def slice_count(rows: int, filter_bits: int) -> int:
    return max(1, -(-bloom.BITS_A_KEY * rows // filter_bits))


class ExactDedup:
    """The two passes over one corpus; `annotate` tells each row's fate, `dedup` (with carry) keeps the rows that stay."""

    def __init__(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", filter_bits: int = bloom.MAX_BITS, carry: bool = False):
        sha = F.sha2(normalised(text_column), 256)
        whole = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")] if carry else []
        hashed = docs.select(F.col(id_column).alias("doc_id"), sha.alias("text_sha256"), F.monotonically_increasing_id().alias("row"), *whole)
        hashed = hashed.withColumn("h", F.expr("cast(conv(substring(text_sha256, 1, 15), 16, 10) as bigint)"))
        self.rows = docs.count()
        slices = slice_count(self.rows, filter_bits)
        hashed = hashed.withColumn("slice", F.expr(f"cast(pmod(xxhash64(h), {slices}L) as int)"))
        self.hashed = cut(hashed, "exact-hashed", by=["slice"] if slices > 1 else [])
        parts = [self._sifted(self.hashed.where(f"slice = {s}"), -(-self.rows // slices), filter_bits) for s in range(slices)]
        self.sure, self.rest = (reduce(DataFrame.unionByName, side) for side in zip(*parts, strict=True))
        first = F.min(F.struct(F.coalesce("doc_id", F.lit(MAX_LONG)).alias("k"), "row", "doc_id"))
        groups = self.rest.groupBy("text_sha256").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
        # written out, so that the join below shuffles both sides plainly and AQE may split a hot group
        self.groups = cut(groups.select("text_sha256", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size"), "exact-groups")

    @staticmethod
    def _sifted(hashed: DataFrame, rows: int, filter_bits: int) -> tuple[DataFrame, DataFrame]:
        """(rows that have no copy, rows that may have one) of one slice."""
        hot = cut(hot_hashes(hashed, rows), "exact-hot")
        chunks = max(1, -(-rows // CHUNK_ROWS))
        place = lambda h: F.expr(f"({h} % {chunks}) * 2147483648 + (({h} div {chunks}) & 2147483647)")
        marks = repeated(cut(sparse_bitmap(hashed, hot, rows), "exact-bitmap")).select(F.expr("chunk * 2147483648 + place").alias("place"))
        marks = cut(marks.unionByName(hot.select(place("h").alias("place"))), "exact-repeated")
        sure, maybe = bloom.split(hashed.withColumn("place", place("h")), "place", marks, filter_bits)
        return sure, maybe

    def annotate(self) -> DataFrame:
        """doc_id, keep_id, group_size, kept, text_sha256, row: one row per document, dropped ones too."""
        alone = self.sure.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "row")
        grouped = self._judged().select(
            "doc_id",
            F.expr("if(keep_row is null, doc_id, keep_id)").alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            F.expr("keep_row is null or row = keep_row").alias("kept"),
            "text_sha256",
            "row",
        )
        return alone.unionByName(grouped)

    def _judged(self) -> DataFrame:
        return self.rest.join(by_shuffle(self.groups), "text_sha256", "left")

    def dedup(self) -> DataFrame:
        """The documents that stay, with all their columns; rows that the filter clears do not shuffle."""
        stay = self._judged().where("keep_row is null or row = keep_row")
        return self.sure.select("doc.*").unionByName(stay.select("doc.*"))


def exact_duplicates(docs: DataFrame, **options) -> DataFrame:
    return ExactDedup(docs, **options).annotate()


def exact_dedup(docs: DataFrame, **options) -> DataFrame:
    return ExactDedup(docs, carry=True, **options).dedup()
