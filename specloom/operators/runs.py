"""From (section, page) pairs to indexes and runs of consecutive pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def section_index(pairs: DataFrame, keys: list[str], page: str = "page") -> DataFrame:
    """keys and pages: the distinct pages of each section, ascending."""
    return pairs.groupBy(*keys).agg(F.sort_array(F.collect_set(page)).alias("pages"))


SPAN = 4096  # pages that are looked at together


def page_runs(pairs: DataFrame, keys: list[str], page: str = "page") -> DataFrame:
    """keys, start, end, length: maximal runs of consecutive distinct pages (gaps and islands)."""
    return _runs(pairs.select(*keys, page, _span(page)).distinct(), keys, page)


def runs_with_repeats(pairs: DataFrame, keys: list[str], page: str = "page") -> DataFrame:
    """As page_runs, but over all rows: a repeated page begins a run of its own."""
    return _runs(pairs.select(*keys, page, _span(page)), keys, page)


def _span(page: str) -> Column:
    """The first page of a page's span."""
    p = F.col(page).cast("bigint")
    return (p - F.pmod(p, F.lit(SPAN))).alias("_span")


def _runs(rows: DataFrame, keys: list[str], page: str) -> DataFrame:
    """Runs within spans, which a section of very many pages has in many tasks; those that touch an edge of their span, at most
    two for each, are then joined to their neighbours."""
    own = Window.partitionBy(*keys, "_span")
    new = F.coalesce(F.lag(page).over(own.orderBy(page)) + 1 != F.col(page), F.lit(True)).cast("int")
    numbered = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(own.orderBy(page).rowsBetween(Window.unboundedPreceding, 0)))
    local = numbered.groupBy(*keys, "_span", "_run").agg(F.min(page).alias("start"), F.max(page).alias("end"), F.count(F.lit(1)).alias("length"))
    first = (F.col("_run") == 1) & (F.col("start") == F.col("_span"))
    last = F.lead("_run").over(own.orderBy("_run")).isNull() & (F.col("end") == F.col("_span") + SPAN - 1)
    local = local.withColumn("_first", F.coalesce(first, F.lit(False))).withColumn("_last", F.coalesce(last, F.lit(False)))
    w = Window.partitionBy(*keys).orderBy("_span", "_run")
    goes_on = F.col("_first") & F.lag("_last").over(w) & (F.lag("_span").over(w) == F.col("_span") - SPAN)
    edges = local.where("_first or _last").withColumn("_goes_on", F.coalesce(goes_on, F.lit(False)))
    joined = edges.withColumn("_run", F.sum((~F.col("_goes_on")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stitched = joined.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("length").alias("length"))
    columns = [*keys, "start", "end", "length"]
    return local.where("not _first and not _last").select(*columns).unionByName(stitched.select(*columns))


def contiguity(pairs: DataFrame, keys: list[str], page: str = "page") -> DataFrame:
    """keys, n_runs and all_contiguous, over all rows."""
    return runs_with_repeats(pairs, keys, page).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_runs")).withColumn("all_contiguous", F.col("n_runs") == 1)


def pages_per_section(runs: DataFrame, keys: list[str]) -> DataFrame:
    return runs.groupBy(*keys).agg(F.sum("length").alias("total_pages"))


def section_counts(pairs: DataFrame, keys: list[str], section: str = "section_number") -> DataFrame:
    """Distinct divisions and sections for each of keys. Sections are made distinct first: counting both at once would double the rows."""
    sections = pairs.select(*keys, section).distinct()
    return sections.groupBy(*keys).agg(F.countDistinct(T.division_of(F.col(section))).alias("total_divisions"), F.count(section).alias("total_sections"))


def single_and_multi(runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, single (pages that stand alone) and multi (page lists of longer runs), ascending."""
    pages = F.sequence("start", "end")
    lists = F.array_sort(F.collect_list(pages))
    return runs.groupBy(*keys).agg(lists.alias("_all")).select(
        *keys,
        F.transform(F.filter("_all", lambda r: F.size(r) == 1), lambda r: r[0]).alias("single"),
        F.filter("_all", lambda r: F.size(r) > 1).alias("multi"),
    )


def nest_by_division(sections: DataFrame, spec: str = "spec_id", section: str = "section_number") -> DataFrame:
    """A row per spec and division with its sections, ordered by number, as structs."""
    rest = [c for c in sections.columns if c not in (spec, section, "division")]
    rows = sections.withColumn("division", T.division_of(F.col(section)))
    return rows.groupBy(spec, "division").agg(F.array_sort(F.collect_list(F.struct(section, *rest))).alias("sections"))


def shard_bounds(pages: DataFrame, workers: int = 6, n: str = "n_pages") -> DataFrame:
    """Even page ranges [start, end) for workers; Spark's own partitions need none."""
    i = F.explode(F.sequence(F.lit(0), F.lit(workers - 1)))
    return pages.select("*", i.alias("worker")).withColumn("start", F.expr(f"{n} * worker div {workers}")).withColumn("end", F.expr(f"{n} * (worker + 1) div {workers}"))
