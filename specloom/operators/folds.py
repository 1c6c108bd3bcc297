"""Values of a key in order, as parts of bounded size: folds that gather no whole group in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .common import numbered, small_or_plain

PART = 10_000  # values of a part


def in_parts(rows: DataFrame, keys: list[str], order: list[str], values: list[str], size: int = PART) -> DataFrame:
    """keys, part (from 0), items: structs of the values, in order, at most `size` in a part. Rows with a null key are left out.

    A row's part comes from its position among all rows and that of its key's first row, so the rows of a key that
    has very many are sorted and gathered by many tasks."""
    placed = numbered(rows.select(*keys, *(c for c in [*order, *values] if c not in keys)).dropna(subset=keys), [*keys, *order])
    first = placed.groupBy(*keys).agg(F.min("_pos").alias("_first"))
    dealt = placed.join(small_or_plain(first), keys).withColumn("part", F.expr(f"(_pos - _first) div {size}"))
    gathered = dealt.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct("_pos", *values))).alias("_items"))
    return gathered.select(*keys, "part", F.transform("_items", lambda x: F.struct(*(x[v].alias(v) for v in values))).alias("items"))


def page_list_parts(results: DataFrame, keys: list[str], order: str = "seq", size: int = PART) -> DataFrame:
    """keys, is_primary, part, pages: the lists of classification.page_lists in parts of at most `size` runs."""
    rows = results.withColumn("is_primary", F.coalesce("is_primary", F.lit(False)))
    parts = in_parts(rows, [*keys, "is_primary"], [order], ["start", "end"], size)
    return parts.select(*keys, "is_primary", "part", F.flatten(F.transform("items", lambda r: T.page_range(r["start"], r["end"]))).alias("pages"))


def summary_parts(results: DataFrame, keys: list[str], scalars: list[str], lists: list[str], order: str = "seq", size: int = PART) -> DataFrame:
    """keys, part, scalars and lists: the scalars of the key's first result beside each part of its lists, in order of arrival."""
    parts = in_parts(results, keys, [order], lists, size)
    first = results.dropna(subset=keys).groupBy(*keys).agg(F.min_by(F.struct(*scalars), order).alias("_first"))
    own = lambda c: F.flatten(F.filter(F.transform("items", lambda r: r[c]), lambda x: x.isNotNull())).alias(c)
    return parts.join(first, keys).select(*keys, "part", *(F.col("_first")[c].alias(c) for c in scalars), *map(own, lists))
