"""Submittal packages: their contents, what has been checked, and their compliance runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SHOP_DRAWING
from .snapshots import append


def with_submittals(packages: DataFrame, submittals: DataFrame, key: str = "id", foreign: str = "package_id", child_id: str = "id", fields: list[str] | None = None) -> DataFrame:
    """packages with an array of their submittals ordered by id, empty where there are none."""
    fields = fields or [c for c in submittals.columns if c != foreign]
    child = F.struct(child_id, *[c for c in fields if c != child_id])
    lists = submittals.groupBy(F.col(foreign).alias("_key")).agg(F.array_sort(F.collect_list(child)).alias("submittals"))
    joined = packages.join(lists, packages[key] == F.col("_key"), "left").drop("_key")
    return joined.withColumn("submittals", F.coalesce("submittals", F.array().cast(lists.schema["submittals"].dataType)))


def name_taken(new: DataFrame, packages: DataFrame) -> DataFrame:
    """New packages whose name their section has already."""
    return new.join(packages.select("section_id", "package_name"), ["section_id", "package_name"], "left_semi")


def merged_ids(existing: Column, checked: Column) -> Column:
    """The union of two id lists, ascending; null counts as empty."""
    none = F.array().cast("array<bigint>")
    return F.array_sort(F.array_union(F.coalesce(existing, none), F.coalesce(checked, none)))


def covers(have: Column, wanted: Column) -> Column:
    return F.size(F.array_except(wanted, have)) == 0


def apply_runs(packages: DataFrame, submittals: DataFrame, runs: DataFrame) -> DataFrame:
    """packages after runs (package_id, checked, compliance_result, compliance_score; one per package): ids merge and run_count
    rises with every run; the result is stored only once all submittals of the package have been checked."""
    every = submittals.groupBy("package_id").agg(F.collect_set("id").alias("_every"))
    r = runs.select("package_id", F.col("checked").cast("array<bigint>").alias("_checked"), F.col("compliance_result").alias("_result"), F.col("compliance_score").alias("_score"), F.lit(True).alias("_ran"))
    joined = packages.join(r, packages["id"] == r["package_id"], "left").drop("package_id").join(every, F.col("id") == F.col("package_id"), "left").drop("package_id")
    merged = merged_ids(F.col("checked_submittal_ids"), F.col("_checked"))
    done = F.col("_ran") & covers(merged, F.coalesce("_every", F.array().cast("array<bigint>")))
    return joined.withColumns(
        {
            "compliance_result": F.when(done, F.col("_result")).otherwise(F.col("compliance_result")),
            "compliance_score": F.when(done, F.col("_score")).otherwise(F.col("compliance_score")),
            "run_count": F.when(F.col("_ran"), F.coalesce("run_count", F.lit(0)) + 1).otherwise(F.col("run_count")),
            "checked_submittal_ids": F.when(F.col("_ran"), merged).otherwise(F.col("checked_submittal_ids")),
        }
    ).select(*packages.columns)


def find_runs(runs: DataFrame, package_id: int | None = None, submittal_id: int | None = None, run_type: str | None = None) -> DataFrame:
    """Runs of a package about one submittal alone; else of a type; else all. Newest first."""
    out = runs if package_id is None else runs.where(F.col("package_id") == package_id)
    if submittal_id is not None:
        out = out.where(about_one(F.col("submittal_ids"), F.lit(submittal_id)))
    elif run_type is not None:
        out = out.where(F.col("run_type") == run_type)
    return out.orderBy(F.col("created_at").desc(), F.col("id").desc())


def about_one(ids: Column, submittal: Column) -> Column:
    """The list holds this submittal and no other."""
    return (F.size(ids) == 1) & (F.try_element_at(ids, F.lit(1)) == submittal)


def about_one_json(ids: Column, submittal: Column) -> Column:
    """The same for a list kept as JSON text."""
    return F.coalesce((F.json_array_length(ids) == 1) & (F.get_json_object(ids, "$[0]").try_cast("bigint") == submittal), F.lit(False))


def latest_runs(runs: DataFrame, keys: list[str], time: str = "created_at", tie: str = "id") -> DataFrame:
    """The newest run of each key; the larger id where times tie."""
    w = Window.partitionBy(*keys).orderBy(F.col(time).desc(), F.col(tie).desc())
    return runs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_versions(runs: DataFrame, keys: list[str], time: str = "created_at", tie: str = "id") -> DataFrame:
    """prompt_version counts a key's runs from 1."""
    return runs.withColumn("prompt_version", F.row_number().over(Window.partitionBy(*keys).orderBy(time, tie)))


def record_runs(runs: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Runs after new ones: the latest of the same key takes over the content and its version rises; the rest are added with new ids."""
    latest = latest_runs(runs, keys)
    content = [c for c in new.columns if c not in (*keys, "id", "prompt_version", "created_at")]
    mine = new.select(*keys, *(F.col(c).alias(f"_{c}") for c in content))
    changed = latest.join(mine, keys).withColumns({c: F.col(f"_{c}") for c in content}).withColumn("prompt_version", F.coalesce("prompt_version", F.lit(0)) + 1).select(*runs.columns)
    kept = runs.join(changed.select("id"), "id", "left_anti").select(*runs.columns)
    added = new.join(latest.select(*keys), keys, "left_anti").withColumn("prompt_version", F.lit(1))
    return append(kept.unionByName(changed), added).select(*runs.columns)


def only_drawings(submittals: DataFrame, keys: list[str], kind: str = "submittal_type_id") -> DataFrame:
    """keys and drawings_only: every submittal is a shop drawing (one without a type is not)."""
    return submittals.groupBy(*keys).agg(F.bool_and(F.coalesce(F.col(kind) == SHOP_DRAWING, F.lit(False))).alias("drawings_only"))
