"""Tables and records as Spark schemas, and their domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PAGES = "spec_id string, page_index int, text string, image binary"
TAXONOMY = "division string, section_number string, title string"
TABLES = {
    "projects": "spec_id string, project_name string, total_divisions int, total_sections int, sections_with_primary int, sections_with_reference int, errors int, classification_status string, summary_status string, project_completion_score double, created_at timestamp, updated_at timestamp",
    "divisions": "id bigint, spec_id string, division string, division_title string, total_sections int, division_completion_score double, created_at timestamp, updated_at timestamp",
    "sections": "id bigint, spec_id string, division_id bigint, division string, section_number string, section_title string, primary_pages array<int>, reference_pages array<int>, total_pages int, classification_status string, summary_status string, chosen_packages array<bigint>, lifecycle_status string, lifecycle_status_override boolean, created_at timestamp, updated_at timestamp",
    "classification": "id bigint, section_id bigint, custom_id string, is_primary boolean, confidence double, reasoning string, referenced_sections array<string>, pages_analyzed array<int>, created_at timestamp",
    "section_summaries": "id bigint, spec_id string, section_id bigint, section_number string, overview string, key_requirements array<string>, materials array<string>, submittals array<string>, testing array<string>, related_sections array<string>, pages_summarized array<int>, pages_not_summarized array<int>, created_at timestamp, updated_at timestamp",
    "submittal_packages": "id bigint, spec_id string, section_id bigint, package_name string, company_name string, submitted_by string, submitted_date timestamp, compliance_score double, compliance_result string, checked_submittal_ids array<bigint>, run_count int, last_checked_at timestamp, status string, is_chosen boolean, created_at timestamp, updated_at timestamp",
    "submittals": "id bigint, package_id bigint, spec_id string, submittal_title string, s3_key string, page_count int, compliance_score double, submittal_type_id int, submittal_type_name string, submittal_findings string, status string, created_at timestamp, updated_at timestamp",
    "compliance_runs": "id bigint, package_id bigint, spec_id string, section_id bigint, submittal_ids array<bigint>, compliance_result string, compliance_score double, is_compliant boolean, run_type string, pipeline string, model string, prompt_version int, token_count int, created_at timestamp, updated_at timestamp",
    "compliance_comparisons": "id bigint, package_id_a bigint, package_id_b bigint, section_id bigint, section_number string, package_name_a string, package_name_b string, overall_winner string, score_a double, score_b double, score_delta double, executive_summary string, recommendation string, comparison_result string, model_version string, created_at timestamp",
    "amendments": "id bigint, section_id bigint, ref string, type string, note string, created_at timestamp, updated_at timestamp",
}
#: Natural and primary keys that upserts and deletes go by.
KEYS = {
    "projects": ["spec_id"],
    "divisions": ["spec_id", "division"],
    "sections": ["spec_id", "section_number"],
    **{t: ["id"] for t in ("classification", "section_summaries", "submittal_packages", "submittals", "compliance_runs", "compliance_comparisons", "amendments")},
}
#: (child, its column, parent, the parent's column): what a cascading delete follows.
REFERENCES = [
    ("divisions", "spec_id", "projects", "spec_id"),
    ("sections", "spec_id", "projects", "spec_id"),
    ("sections", "division_id", "divisions", "id"),
    ("classification", "section_id", "sections", "id"),
    ("section_summaries", "section_id", "sections", "id"),
    ("submittal_packages", "section_id", "sections", "id"),
    ("submittals", "package_id", "submittal_packages", "id"),
    ("compliance_runs", "package_id", "submittal_packages", "id"),
    ("compliance_comparisons", "package_id_a", "submittal_packages", "id"),
    ("compliance_comparisons", "package_id_b", "submittal_packages", "id"),
    ("amendments", "section_id", "sections", "id"),
]

CLASSIFICATION = "section_title string, is_primary boolean, confidence double, reasoning string, referenced_sections array<string>, pages_analyzed array<int>"
SUMMARY = "section_title string, overview string, key_requirements array<string>, materials array<string>, submittals array<string>, testing array<string>, related_sections array<string>"
COMPLIANCE = "is_compliant boolean, compliance_score double, summary string, requirement_findings array<struct<requirement:string,status:string,evidence:string,spec_reference:string,drawing_reference:string,notes:string,spec_pages:array<int>,submittal_pages:array<int>>>, non_conformances array<struct<description:string,severity:string,spec_reference:string,recommendation:string>>, missing_items array<struct<description:string,spec_reference:string,required:boolean>>, recommendations array<string>, reviewer_notes string"
COMPARISON = "overall_winner string, score_a double, score_b double, score_delta double, confidence string, executive_summary string, dimension_comparisons array<struct<dimension:string,winner:string,a_status:string,b_status:string,rationale:string>>, a_exclusive_strengths array<string>, b_exclusive_strengths array<string>, shared_deficiencies array<string>, a_critical_failures array<string>, b_critical_failures array<string>, recommendation string"
EXTRACTION = "section_number string, project_name string, general_requirements array<struct<title:string,requirements:array<string>,document_pages:array<int>>>, products array<struct<product_name:string,manufacturer:string,material_category:string,csi_division:string,spec_section:string,document_type:string,standards:array<string>,properties:array<struct<name:string,value:string,units:string,context:string>>,notes:string,document_pages:array<int>>>, execution_requirements array<struct<title:string,steps:array<string>,document_pages:array<int>>>, notes string"
BATCH_RESULT = f"custom_id string, type string, error string, attempt int, seq bigint, content struct<{CLASSIFICATION.replace(' string', ':string').replace(' boolean', ':boolean').replace(' double', ':double').replace(' array', ':array')}>"

# Codes, names and domains that stored data carries.
SUBMITTAL_TYPES = {1042: "Shop Drawing", 2187: "Product Data", 3561: "Material Certification", 4823: "Test Report", 5394: "Mix Design", 6718: "Sample", 7265: "Other"}
SHOP_DRAWING = 1042
LIFECYCLE = ("pending", "in_progress", "complete", "excluded")
FINDING_STATUS = ("compliant", "non_compliant", "clarification_needed", "missing", "not_applicable")
SEVERITY = ("critical", "major", "minor", "informational")
AMENDMENT_TYPES = ("waived", "alternate_accepted", "not_applicable", "deferred")
WINNERS = ("A", "B", "tie")
UNDOCUMENTED = "Undocumented Section Number (MSF2020)"


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """Required columns that df lacks."""
    return sorted(set(required) - set(df.columns))


def missing_fields(df: DataFrame, required: list[str]) -> Column:
    """Of each row, the names of required columns that it lacks: absent ones, nulls and blank texts."""
    kinds = dict(df.dtypes)
    absent = lambda c: F.lit(True) if c not in kinds else F.col(c).isNull() | (F.trim(F.col(c)) == "") if kinds[c] == "string" else F.col(c).isNull()
    return F.filter(F.array(*(F.when(absent(c), F.lit(c)) for c in sorted(required))), lambda x: x.isNotNull())


def split_by_domain(df: DataFrame, column: str, domain) -> tuple[DataFrame, DataFrame]:
    """(rows whose value is in the domain, all others, nulls included)."""
    fine: Column = F.coalesce(F.col(column).isin(*domain), F.lit(False))
    return df.where(fine), df.where(~fine)


def decode(df: DataFrame, column: str, ddl: str, raw: str = "raw") -> DataFrame:
    """JSON text to a struct; where it cannot be read the struct is null and the text is kept in column `raw`."""
    parsed = F.from_json(F.col(column), f"{ddl}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    with_it = df.withColumn("_parsed", parsed)
    bad = F.col("_parsed._corrupt").isNotNull() | F.col("_parsed").isNull()
    return with_it.withColumn(raw, F.when(bad, F.col(column))).withColumn(column, F.when(~bad, F.col("_parsed").dropFields("_corrupt"))).drop("_parsed")
