"""Applying classification results to sections: tallies, page lists, retries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .common import held


def with_key(results: DataFrame) -> DataFrame:
    """results with division, section_number, spec_id, start and end read from custom_id, unless they are columns already."""
    if {"section_number", "start", "end"} <= set(results.columns):
        return results
    return results.withColumn("_k", T.parse_composite_id(F.col("custom_id"))).select("*", "_k.*").drop("_k")


def succeeded(results: DataFrame) -> DataFrame:
    """Whatever is not a success counts as failed, with or without content."""
    return results.where(F.coalesce(F.col("type") == "succeeded", F.lit(False)))


def failed(results: DataFrame) -> DataFrame:
    return results.where(~F.coalesce(F.col("type") == "succeeded", F.lit(False)))


def latest_attempt(results: DataFrame, keys: list[str], attempt: str = "attempt") -> DataFrame:
    """One row for each request, the last attempt's, so that no result is applied twice; of equal attempts the one whose contents hash lowest."""
    w = Window.partitionBy(*keys).orderBy(F.col(attempt).desc_nulls_last(), F.xxhash64(*results.columns))
    return results.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def tally(results: DataFrame, keys: list[str], division: str = "division", section: str = "section_number") -> DataFrame:
    """Per key: distinct divisions and sections of successes, runs that are primary and not, failures."""
    ok = F.coalesce(F.col("type") == "succeeded", F.lit(False))
    return results.groupBy(*keys).agg(
        F.countDistinct(F.when(ok, F.col(division))).alias("total_divisions"),
        F.countDistinct(F.when(ok, F.col(section))).alias("total_sections"),
        F.count_if(ok & F.coalesce("is_primary", F.lit(False))).alias("sections_with_primary"),
        F.count_if(ok & ~F.coalesce("is_primary", F.lit(False))).alias("sections_with_reference"),
        F.count_if(~ok).alias("errors"),
    )


def page_lists(results: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Per section the pages of its primary and of its other runs, appended in order of arrival."""
    pages = T.page_range(F.col("start"), F.col("end"))
    of = lambda flag: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(flag, F.struct(F.col(order).alias("o"), pages.alias("p"))))), lambda s: s["p"]))
    primary = F.coalesce("is_primary", F.lit(False))
    return results.groupBy(*keys).agg(of(primary).alias("new_primary"), of(~primary).alias("new_reference"))


def fold_pages(sections: DataFrame, lists: DataFrame, keys: list[str]) -> DataFrame:
    """Sections with the new pages appended (repeats stay) and classification_status by how many there are."""
    none = F.array().cast("array<int>")
    joined = sections.join(lists, keys, "left")
    grown = lambda old, new: F.concat(F.coalesce(old, none), F.coalesce(new, none))
    primary, reference = grown("primary_pages", "new_primary"), grown("reference_pages", "new_reference")
    touched = F.col("new_primary").isNotNull()
    status = F.when(F.size(primary) + F.size(reference) >= F.col("total_pages"), "complete").otherwise("pending")
    return joined.withColumns({"primary_pages": F.when(touched, primary).otherwise(F.col("primary_pages")), "reference_pages": F.when(touched, reference).otherwise(F.col("reference_pages")), "classification_status": F.when(touched, status).otherwise(F.col("classification_status"))}).select(*sections.columns)


def unmatched(results: DataFrame, sections: DataFrame, keys: list[str]) -> DataFrame:
    """Results about sections that do not exist."""
    return results.join(sections.select(*keys), keys, "left_anti")


def sections_without_primary(results: DataFrame, keys: list[str]) -> DataFrame:
    """Sections that were classified but in no run as primary."""
    return results.select(*keys).distinct().join(results.where("is_primary").select(*keys), keys, "left_anti")


def mark_manual(sections: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    marks = sections_without_primary(results, keys).withColumn("_manual", F.lit(True))
    return sections.join(marks, keys, "left").withColumn("summary_status", F.when(F.col("_manual"), "manual").otherwise(F.col("summary_status"))).select(*sections.columns)


def primary_runs(results: DataFrame) -> DataFrame:
    """What the summary step is asked about."""
    return succeeded(results).where("is_primary").select("spec_id", "division", "section_number", "start", "end")


def with_retries(requests: DataFrame, ask, most: int = 3) -> DataFrame:
    """Ask (requests -> results with type), then ask again about what failed, `most` times; the last attempt of each request.

    Every round's results are checkpointed if the session has a folder for that, so no round is asked twice."""
    rounds = [held(ask(requests).withColumn("attempt", F.lit(0)))]
    for attempt in range(1, most + 1):
        again = requests.join(failed(rounds[-1]).select("custom_id"), "custom_id", "left_semi")
        if again.isEmpty():
            break
        rounds.append(held(ask(again).withColumn("attempt", F.lit(attempt))))
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return latest_attempt(out, ["custom_id"])
