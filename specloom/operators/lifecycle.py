"""Completion of sections, divisions and projects, and the state changes that lead there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import completion
from .common import held
from .keyed import KeyedTables, Layout
from .snapshots import update

#: How sections and what is rolled up from them are kept for changes by key. A project's counts lie together.
LAYOUTS = {
    "sections": Layout(("id",)),
    "section_counts": Layout(("spec_id", "division", "status"), by=("spec_id",)),
    "divisions": Layout(("spec_id", "division"), by=("spec_id",)),
    "projects": Layout(("spec_id",)),
}


def _counts(status: str):
    s = F.col(status)
    return F.count_if(s == "complete").alias("complete"), F.count_if(s != "excluded").alias("total"), F.count_if(s == "excluded").alias("excluded")


def lifecycle_rollup(sections: DataFrame, project: str = "spec_id", division: str = "division", status: str = "lifecycle_status") -> DataFrame:
    """Per project and division, and per project (division null): complete, total (without excluded), excluded, score.

    One pass over grouping sets; the project's score counts its sections, it does not average divisions."""
    rows = sections.groupingSets([[F.col(project), F.col(division)], [F.col(project)]], F.col(project), F.col(division)).agg(*_counts(status), F.grouping(division).alias("_all"))
    return rows.select(project, division, (F.col("_all") == 1).alias("is_project"), "complete", "total", "excluded", completion(F.col("complete"), F.col("total")).alias("score"))


def division_completion(sections: DataFrame) -> DataFrame:
    return sections.groupBy("spec_id", "division").agg(*_counts("lifecycle_status")).withColumn("score", completion(F.col("complete"), F.col("total")))


def project_completion(sections: DataFrame) -> DataFrame:
    return sections.groupBy("spec_id").agg(*_counts("lifecycle_status")).withColumn("score", completion(F.col("complete"), F.col("total")))


def status_counts(sections: DataFrame) -> DataFrame:
    """spec_id, division, status, n: what completion is computed from. A section without a status is counted as `none`."""
    return sections.groupBy("spec_id", "division", F.coalesce("lifecycle_status", F.lit("none")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def count_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """spec_id, division, status, n: by how much counts differ between the same sections before and after a change; unchanged ones cancel out."""
    signed = status_counts(new).unionByName(status_counts(old).withColumn("n", -F.col("n")))
    return signed.groupBy("spec_id", "division", "status").agg(F.sum("n").alias("n")).where("n <> 0")


def add_counts(old: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Counts after signed changes; what falls to nothing goes."""
    both = old.select(*keys, "n").unionByName(changes.select(*keys, "n"))
    return both.groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")


def completion_of_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, complete, total, excluded, score, as division_completion and project_completion compute them from sections."""
    of = lambda condition: F.coalesce(F.sum(F.when(F.expr(condition), F.col("n"))), F.lit(0))
    rows = counts.groupBy(*keys).agg(of("status = 'complete'").alias("complete"), of("status not in ('excluded', 'none')").alias("total"), of("status = 'excluded'").alias("excluded"))
    return rows.withColumn("score", completion(F.col("complete"), F.col("total")))


def store_scores(owners: DataFrame, scores: DataFrame, keys: list[str], column: str) -> DataFrame:
    """owners with their new score; where no section counts, the stored score stays."""
    new = scores.where("total > 0").select(*keys, F.col("score").alias("_score"))
    return owners.join(new, keys, "left").withColumn(column, F.coalesce("_score", column)).select(*owners.columns)


def apply_lifecycle(sections: DataFrame, changes: DataFrame) -> DataFrame:
    """sections after changes (id, and any of lifecycle_status, chosen_packages, override, null for unchanged; one row per id).

    A chosen list makes a section complete, or pending if it is empty, unless the section or the
    change overrides; a status that is given wins."""
    columns = {"lifecycle_status": "string", "chosen_packages": "array<bigint>", "override": "boolean"}
    c = changes.select("id", *((F.col(k) if k in changes.columns else F.lit(None)).cast(t).alias(f"_{k}") for k, t in columns.items()))
    auto = F.col("_chosen_packages").isNotNull() & F.col("_override").isNull() & ~F.coalesce("lifecycle_status_override", F.lit(False))
    status = F.when(F.col("_lifecycle_status").isNotNull(), F.col("_lifecycle_status")).when(auto & (F.size("_chosen_packages") > 0), "complete").when(auto, "pending").otherwise(F.col("lifecycle_status"))
    return (
        sections.join(c, "id", "left")
        .withColumn("lifecycle_status", status)
        .withColumn("chosen_packages", F.coalesce("_chosen_packages", "chosen_packages"))
        .withColumn("lifecycle_status_override", F.coalesce("_override", "lifecycle_status_override"))
        .select(*sections.columns)
    )


def commit_selection(packages: DataFrame, sections: DataFrame, choices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packages, sections) after choices (section_id, chosen: package ids): others of the section are unmarked, the section is complete (pending for none) and overridden."""
    c = choices.select("section_id", F.col("chosen").cast("array<bigint>").alias("_chosen"))
    marked = packages.join(c, "section_id", "left").withColumn("is_chosen", F.when(F.col("_chosen").isNull(), F.col("is_chosen")).otherwise(F.array_contains("_chosen", F.col("id").cast("bigint")))).select(*packages.columns)
    changes = c.select(F.col("section_id").alias("id"), F.when(F.size("_chosen") > 0, "complete").otherwise("pending").alias("lifecycle_status"), F.col("_chosen").alias("chosen_packages"), F.lit(True).alias("override"))
    return marked, apply_lifecycle(sections, changes)


def delete_packages(packages: DataFrame, comparisons: DataFrame, sections: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(packages, comparisons, sections) without the packages in ids (id). Sections that had chosen one of them drop it and are
    complete only if a chosen one remains; roll up completion afterwards, so that scores see the new state."""
    gone = ids.select(F.col("id").cast("bigint").alias("id")).distinct()
    left = packages.join(gone, "id", "left_anti").select(*packages.columns)
    pairs = comparisons
    for side in ("package_id_a", "package_id_b"):
        pairs = pairs.join(gone.select(F.col("id").alias(side)), side, "left_anti")
    hit = packages.join(gone, "id", "left_semi").where("is_chosen").groupBy("section_id").agg(F.collect_set("id").alias("_gone"))
    remaining = F.array_except(F.coalesce("chosen_packages", F.array().cast("array<bigint>")), "_gone")
    changes = sections.join(hit, sections["id"] == hit["section_id"]).select("id", remaining.alias("chosen_packages"), F.when(F.size(remaining) > 0, "complete").otherwise("pending").alias("lifecycle_status"), F.lit(True).alias("override"))
    return left, pairs.select(*comparisons.columns), apply_lifecycle(sections, changes)


def keep_counts(tables: KeyedTables) -> None:
    """Count all sections once and keep the counts as a table, which change_sections() then moves along."""
    tables.create("section_counts", status_counts(tables.read("sections")))


def change_sections(tables: KeyedTables, changes: DataFrame, how=lambda old, changes, _: apply_lifecycle(old, changes)) -> DataFrame:
    """Apply changes (by id) to the stored sections and bring counts and scores up to date, in one commit.

    Read are the files that may hold a changed section and those of the counts, divisions and projects that they belong to:
    counts move by the difference between the sections' old and new rows. Result: the differences."""
    sections = tables.stage("sections", changes, how)
    moved = held(count_changes(sections.old, sections.new))
    changed = sections.new.join(changes.select("id").distinct(), "id", "left_semi")
    counts = tables.stage("section_counts", moved.unionByName(status_counts(changed).withColumn("n", F.lit(0).cast("bigint"))), add_counts)
    staged = [sections, counts]
    own = counts.new.join(changed.select("spec_id").distinct(), "spec_id", "left_semi")  # all counts of these projects lie in the files that were read
    for table, keys, column in (("divisions", ["spec_id", "division"], "division_completion_score"), ("projects", ["spec_id"], "project_completion_score")):
        if tables.store.version(table):
            scores = completion_of_counts(own, keys).where("total > 0").select(*keys, F.col("score").alias(column))
            staged.append(tables.stage(table, scores, update))
    tables.commit(*staged)
    return moved
