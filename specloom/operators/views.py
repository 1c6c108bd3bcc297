"""What boards and lists show: searches, statuses, orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered


def project_board(projects: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """runs, complete ones, errors, and whether all are complete (true for none)."""
    done = (F.col("classification_status") == "complete") & (F.col("summary_status") == "complete") & (F.coalesce("errors", F.lit(0)) == 0)
    return projects.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(done).alias("complete"),
        F.coalesce(F.sum(F.coalesce("errors", F.lit(0))), F.lit(0)).alias("errors"),
        F.coalesce(F.bool_and(F.coalesce(done, F.lit(False))), F.lit(True)).alias("all_complete"),
    )


def division_status(sections: DataFrame, keys: list[str]) -> DataFrame:
    """Whether all of a division's sections are through a step, some wait, or some failed."""
    c, s = (F.lower(F.coalesce(x, F.lit(""))) for x in ("classification_status", "summary_status"))
    return sections.groupBy(*keys).agg(
        F.bool_and(c.isin("complete", "failed")).alias("classification_complete"),
        F.bool_or(c.isin("pending", "error")).alias("classification_pending"),
        F.bool_and(s.isin("complete", "failed", "manual")).alias("summary_complete"),
        F.bool_or(s == "pending").alias("summary_pending"),
        F.bool_or(s == "error").alias("summary_error"),
        F.count(F.lit(1)).alias("n_sections"),
    )


def search_sections(sections: DataFrame, query: str = "", status: str = "all") -> DataFrame:
    """Sections whose title or number contains the query and of which any status is the wanted one, by number."""
    q = query.strip().lower()
    has = lambda c: F.coalesce(F.contains(F.lower(F.col(c)), F.lit(q)), F.lit(False))
    out = sections.where(has("section_title") | has("section_number")) if q else sections
    if status != "all":
        norm = lambda c, d: F.lower(F.coalesce(c, F.lit(d)))
        out = out.where((norm("classification_status", "none") == status) | (norm("summary_status", "none") == status) | (norm("lifecycle_status", "pending") == status))
    return out.orderBy("section_number")


def with_primary_pages(sections: DataFrame) -> DataFrame:
    """Sections that have primary pages; those not classified yet are in neither list."""
    return sections.where(F.size("primary_pages") > 0)


def without_primary_pages(sections: DataFrame) -> DataFrame:
    return sections.where(F.size("primary_pages") == 0)


def by_division(sections: DataFrame, fields: list[str]) -> DataFrame:
    """A row per project and division with its sections as structs, ordered by number."""
    rest = [f for f in fields if f != "section_number"]
    return sections.groupBy("spec_id", "division").agg(F.array_sort(F.collect_list(F.struct("section_number", *rest))).alias("sections"))


def section_totals(sections: DataFrame, keys: list[str]) -> DataFrame:
    return sections.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_sections"))


def natural_order(divisions: DataFrame, column: str = "division") -> DataFrame:
    return divisions.orderBy(F.col(column).try_cast("int").asc_nulls_last(), column)


def natural_ranks(divisions: DataFrame, column: str = "division", rank: str = "rank") -> DataFrame:
    """divisions with their place in the natural order, from 0; ranges of the order lie in different tasks."""
    keyed = divisions.withColumn("_number", F.col(column).try_cast("int")).withColumn("_none", F.col("_number").isNull())
    return numbered(keyed, ["_none", "_number", column], rank).drop("_number", "_none")


def comparisons_of(comparisons: DataFrame, ident: int | None = None, section_id: int | None = None, package_id: int | None = None) -> DataFrame:
    """By id, else by section, else those on either side of which a package stands; none of them: nothing."""
    if ident is not None:
        return comparisons.where(F.col("id") == ident)
    if section_id is not None:
        return comparisons.where(F.col("section_id") == section_id)
    if package_id is not None:
        return comparisons.where((F.col("package_id_a") == package_id) | (F.col("package_id_b") == package_id))
    return comparisons.limit(0)


def section_page_order(sections: DataFrame) -> DataFrame:
    """id, position and page: primary pages, then reference pages, each in its order; a section with neither raises."""
    none = F.array().cast("array<int>")
    pages = F.concat(F.coalesce("primary_pages", none), F.coalesce("reference_pages", none))
    checked = F.when(F.size(pages) == 0, F.raise_error(F.concat(F.lit("no pages for section "), F.col("section_number"))).cast("array<int>")).otherwise(pages)
    return sections.select("id", "spec_id", F.posexplode(checked).alias("position", "page"))


def new_files(files: DataFrame, present: DataFrame, name: str = "name") -> DataFrame:
    """PDF files (by type or suffix) whose name is not there yet."""
    pdf = (F.coalesce(F.col("type") == "application/pdf", F.lit(False))) | F.endswith(F.lower(F.col(name)), F.lit(".pdf"))
    return files.where(pdf).join(present.select(name), name, "left_anti")


def best_attempts(attempts: DataFrame, keys: list[str], step: str = "dpi") -> DataFrame:
    """Of several readings of a page: the first that passes, else the one with most words, then most characters, then the lowest step."""
    rank = F.struct((~F.col("passes")).alias("f"), F.when(F.col("passes"), F.col(step)).alias("first"), (-F.col("words")).alias("w"), (-F.col("alnum")).alias("a"), F.col(step).alias("s"))
    rest = [c for c in attempts.columns if c not in keys]
    best = attempts.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_b"))
    return best.select(*keys, *(F.col(f"_b.{c}").alias(c) for c in rest))
