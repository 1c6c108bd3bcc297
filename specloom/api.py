"""The engine as one object over a snapshot store: what the services around it call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import classification, compliance, lifecycle, packages, runs, snapshots, summaries, taxonomy, views
from .operators.keyed import KeyedTables, Layout
from .operators.snapshots import Snapshots
from .schemas import AMENDMENT_TYPES, LIFECYCLE, split_by_domain


class Engine:
    """Tables that `layouts` names are kept in buckets by key and change file by file; all others are written as a whole."""

    def __init__(self, spark: SparkSession, root: str, layouts: dict[str, Layout] | None = None):
        self.spark, self.store = spark, Snapshots(spark, root)
        self.keyed = KeyedTables(self.store, layouts or {})

    def table(self, name: str) -> DataFrame:
        return self.keyed.read(name) if name in self.keyed.layouts else self.store.read(name)

    def upsert(self, name: str, changes: DataFrame) -> None:
        if name in self.keyed.layouts:
            self.keyed.merge(name, changes)
        else:
            self.store.upsert(name, changes)

    # projects and sections
    def index_pages(self, pages: DataFrame, codes: DataFrame) -> DataFrame:
        """spec_id, section_number, start, end, length: where the pages' known section codes run."""
        found = taxonomy.validate_codes(taxonomy.extract_codes(pages.select("spec_id", F.col("page_index").alias("page"), "text")), codes)
        return runs.page_runs(found.withColumnRenamed("code", "section_number"), ["spec_id", "section_number"])

    def projects(self) -> DataFrame:
        return self.table("projects")

    def sections(self, spec_id: str) -> DataFrame:
        return self.table("sections").where(F.col("spec_id") == spec_id).orderBy("section_number")

    def sections_with_primary_pages(self, spec_id: str) -> DataFrame:
        return views.with_primary_pages(self.sections(spec_id))

    def search(self, spec_id: str, query: str = "", status: str = "all") -> DataFrame:
        return views.search_sections(self.sections(spec_id), query, status)

    def section_pages(self, section_id: int) -> DataFrame:
        return views.section_page_order(self.store.read("sections").where(F.col("id") == section_id))

    def delete_project(self, spec_id: str, cascade: bool = False) -> None:
        keys = self.spark.createDataFrame([(spec_id,)], "spec_id string")
        if not cascade:
            self.store.change("projects", snapshots.delete, keys)
            return
        names = [t for t in {r[0] for r in snapshots.REFERENCES} | {"projects"} if self.store.version(t)]
        read = {t: self.store.version(t) for t in names}
        self.store.commit(snapshots.cascade({t: self.store.read(t) for t in names}, "projects", keys), read)

    # results
    def apply_classification(self, results: DataFrame) -> None:
        keys = ["spec_id", "section_number"]
        ok = classification.succeeded(classification.with_key(results))
        self.store.change("sections", lambda old: classification.mark_manual(classification.fold_pages(old, classification.page_lists(ok, keys), keys), ok, keys))

    def merge_summaries(self, results: DataFrame) -> DataFrame:
        return summaries.merge_summaries(classification.succeeded(classification.with_key(results)), ["spec_id", "section_number"])

    # lifecycle
    def set_lifecycle(self, changes: DataFrame) -> None:
        bad = split_by_domain(changes.where("lifecycle_status is not null"), "lifecycle_status", LIFECYCLE)[1]
        if not bad.isEmpty():
            raise ValueError(f"lifecycle_status must be one of {', '.join(LIFECYCLE)}")
        if "sections" in self.keyed.layouts:
            if not self.store.version("section_counts"):
                lifecycle.keep_counts(self.keyed)
            lifecycle.change_sections(self.keyed, changes)
        else:
            self.store.change("sections", lifecycle.apply_lifecycle, changes)
            self.roll_up()

    def roll_up(self) -> None:
        """Store division and project scores as the sections now stand."""
        sections = self.store.read("sections")
        if self.store.version("divisions"):
            self.store.change("divisions", lifecycle.store_scores, lifecycle.division_completion(sections), ["spec_id", "division"], "division_completion_score")
        if self.store.version("projects"):
            self.store.change("projects", lifecycle.store_scores, lifecycle.project_completion(sections), ["spec_id"], "project_completion_score")

    def lifecycle_summary(self, spec_id: str) -> DataFrame:
        return lifecycle.lifecycle_rollup(self.table("sections").where(F.col("spec_id") == spec_id))

    # packages
    def packages_of(self, section_id: int) -> DataFrame:
        own = self.store.read("submittal_packages").where(F.col("section_id") == section_id)
        return packages.with_submittals(own, self.store.read("submittals"))

    def apply_runs(self, results: DataFrame) -> None:
        self.store.change("submittal_packages", packages.apply_runs, self.store.read("submittals"), results)

    def compliance_runs(self, package_id: int, submittal_id: int | None = None, run_type: str | None = None) -> DataFrame:
        return packages.find_runs(self.store.read("compliance_runs"), package_id, submittal_id, run_type)

    def score(self, results: DataFrame, strategy: str = "deductions") -> DataFrame:
        return compliance.STRATEGIES[strategy](compliance.count_findings(results))

    def compare(self, scored: DataFrame, wanted: DataFrame | None = None, by: str = "score") -> DataFrame:
        """Head to head: the pairs that wanted names (id_a, id_b), or else each package with the next of its section."""
        pairs = compliance.pairs_of(scored, compliance.next_pairs(scored) if wanted is None else wanted)
        return {"score": compliance.compare_by_score, "severity": compliance.compare_by_severity}[by](pairs)

    def commit_selection(self, choices: DataFrame) -> None:
        names = ("submittal_packages", "sections")
        read = {n: self.store.version(n) for n in names}
        self.store.commit(dict(zip(names, lifecycle.commit_selection(*(self.store.read(n) for n in names), choices), strict=True)), read)
        self.roll_up()

    def delete_packages(self, ids: DataFrame) -> None:
        """Scores are rolled up after the sections have changed."""
        names = ("submittal_packages", "compliance_comparisons", "sections")
        read = {n: self.store.version(n) for n in names}
        self.store.commit(dict(zip(names, lifecycle.delete_packages(*(self.store.read(n) for n in names), ids), strict=True)), read)
        self.roll_up()

    # amendments
    def add_amendments(self, new: DataFrame) -> None:
        if not split_by_domain(new, "type", AMENDMENT_TYPES)[1].isEmpty():
            raise ValueError(f"type must be one of {', '.join(AMENDMENT_TYPES)}")
        self.store.change("amendments", snapshots.append, new)

    def update_amendments(self, changes: DataFrame) -> None:
        self.store.change("amendments", snapshots.update, changes, ["id"], True)

    def as_json(self, df: DataFrame) -> DataFrame:
        return df.select(F.to_json(F.struct("*")).alias("json"))
