"""Merging per-run summaries into one per section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

LISTS = ("key_requirements", "materials", "submittals", "testing", "related_sections")
SCALARS = ("section_title", "overview")


def merge_summaries(results: DataFrame, keys: list[str], order: str = "seq", scalars=SCALARS, lists=LISTS) -> DataFrame:
    """Scalars of the first result, lists and pages of all in order of arrival."""
    scalars, lists = ([c for c in cs if c in results.columns] for cs in (scalars, lists))
    rows = results
    if {"start", "end"} <= set(results.columns):
        rows, lists = rows.withColumn("pages_summarized", T.page_range(F.col("start"), F.col("end"))), [*lists, "pages_summarized"]
    gathered = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *scalars, *lists))).alias("_r"))
    return gathered.select(*keys, *(F.col("_r")[0][c].alias(c) for c in scalars), *(_appended(c).alias(c) for c in lists))


def _appended(column: str) -> Column:
    return F.flatten(F.filter(F.transform("_r", lambda r: r[column]), lambda x: x.isNotNull()))


def pages_to_read(primary: Column, reference: Column) -> Column:
    """The primary pages, or the reference pages where there are none."""
    return F.when(F.size(F.coalesce(primary, F.array().cast("array<int>"))) > 0, primary).otherwise(F.coalesce(reference, F.array().cast("array<int>")))


def not_summarized(sections: DataFrame, summaries: DataFrame, keys: list[str]) -> DataFrame:
    """Sections that have no summary yet: what a summary run may skip the others for."""
    return sections.join(summaries.select(*keys), keys, "left_anti")
