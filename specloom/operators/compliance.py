"""Compliance findings, their scores, and head-to-head comparison of packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S

COUNTS = ("missing_required", "missing_optional", "clarification_needed", "minor", "major", "critical", "requirements")


def count_findings(results: DataFrame, column: str = "compliance_result") -> DataFrame:
    """results with the counts that scores are made of, read from the nested record."""
    r = F.col(column)
    n = lambda arr, test: F.size(F.filter(F.coalesce(arr, F.array().cast(results.select(arr.alias("x")).schema["x"].dataType)), test)).cast("long")
    findings, issues, missing = r["requirement_findings"], r["non_conformances"], r["missing_items"]
    needed = lambda m: F.coalesce(m["required"], F.lit(True))
    return results.withColumns(
        {
            "missing_required": n(missing, needed),
            "missing_optional": n(missing, lambda m: ~needed(m)),
            "clarification_needed": n(findings, lambda f: f["status"] == "clarification_needed"),
            "minor": n(issues, lambda i: F.coalesce(i["severity"], F.lit("minor")) == "minor"),
            "major": n(issues, lambda i: i["severity"] == "major"),
            "critical": n(issues, lambda i: i["severity"] == "critical"),
            "informational": n(issues, lambda i: ~F.coalesce(i["severity"], F.lit("minor")).isin("minor", "major", "critical")),
            "requirements": n(findings, lambda f: f["status"] != "not_applicable"),
        }
    )


def score_by_deductions(counts: DataFrame) -> DataFrame:
    """counts with compliance_score and is_compliant."""
    c = F.col
    score = S.deduction_score(c("missing_required"), c("clarification_needed"), c("minor"), c("major"), c("critical"))
    return counts.withColumn("compliance_score", score).withColumn("is_compliant", S.is_compliant(c("compliance_score"), c("major"), c("critical")))


def score_by_weights(counts: DataFrame) -> DataFrame:
    """The normalised alternative: penalties per requirement; the threshold itself does not pass."""
    c = F.col
    other = c("informational") if "informational" in counts.columns else None
    score = S.weighted_score(c("requirements"), c("missing_required"), c("missing_optional"), c("clarification_needed"), c("minor"), c("major"), c("critical"), other)
    return counts.withColumn("compliance_score", score).withColumn("is_compliant", S.is_compliant_weighted(c("compliance_score"), c("major"), c("critical")))


STRATEGIES = {"deductions": score_by_deductions, "weighted_normalised": score_by_weights}


def pairs_within(packages: DataFrame, key: str = "section_id", ident: str = "id") -> DataFrame:
    """Each pair (a, b) of different packages of a section, once, the smaller id first."""
    a = packages.select(key, *(F.col(c).alias(f"{c}_a") for c in packages.columns if c != key))
    b = packages.select(key, *(F.col(c).alias(f"{c}_b") for c in packages.columns if c != key))
    return a.join(b, key).where(F.col(f"{ident}_a") < F.col(f"{ident}_b"))


def pairs_of(packages: DataFrame, wanted: DataFrame, ident: str = "id") -> DataFrame:
    """The pairs that wanted names (id_a, id_b), with both packages' columns: two joins by id, whatever the sections' sizes."""
    side = lambda s: packages.select(*(F.col(c).alias(f"{c}_{s}") for c in packages.columns))
    both = wanted.where(f"{ident}_a <> {ident}_b").select(f"{ident}_a", f"{ident}_b")
    return both.join(side("a"), f"{ident}_a").join(side("b"), f"{ident}_b")


def next_pairs(packages: DataFrame, key: str = "section_id", ident: str = "id") -> DataFrame:
    """Each package with the next one of its section: (id_a, id_b)."""
    following = F.lead(ident).over(Window.partitionBy(key).orderBy(ident))
    return packages.select(F.col(ident).alias(f"{ident}_a"), following.alias(f"{ident}_b")).where(f"{ident}_b is not null")


def compare_by_score(pairs: DataFrame) -> DataFrame:
    """overall_winner and score_delta: the higher score, a tie within the band."""
    a, b = F.col("compliance_score_a"), F.col("compliance_score_b")
    return pairs.withColumn("overall_winner", S.winner_by_score(a, b)).withColumn("score_delta", F.round(F.abs(a - b), 4))


def compare_by_severity(pairs: DataFrame) -> DataFrame:
    """overall_winner: fewer critical, then major issues, then missing required items, then clarifications."""
    order = ("critical", "major", "missing_required", "clarification_needed")
    return pairs.withColumn("overall_winner", S.winner_by_severity([F.col(f"{c}_a") for c in order], [F.col(f"{c}_b") for c in order]))


def standings_by_score(packages: DataFrame, key: str = "section_id", score: str = "compliance_score", band: float = S.TIE_BAND) -> DataFrame:
    """packages with wins, ties and losses against all others of their section, as compare_by_score would count them, without a pair.

    Packages are first counted by section and score in ten-thousandths (10,001 scores at most); what lies below, within and above
    the band of a score are sums over ranges of those."""
    rows = packages.withColumn("_t", F.round(F.col(score) * 10_000).cast("bigint"))
    counts = rows.groupBy(key, "_t").agg(F.count(F.lit(1)).alias("_n"))
    width = round(band * 10_000)
    w = Window.partitionBy(key).orderBy("_t")
    over = lambda low, high: F.coalesce(F.sum("_n").over(w.rangeBetween(low, high)), F.lit(0))
    counts = counts.select(key, "_t", over(Window.unboundedPreceding, -width - 1).alias("wins"), (over(-width, width) - 1).alias("ties"), over(width + 1, Window.unboundedFollowing).alias("losses"))
    return rows.join(counts, [key, "_t"]).select(*packages.columns, "wins", "ties", "losses")


def standings_by_severity(packages: DataFrame, key: str = "section_id") -> DataFrame:
    """The same for compare_by_severity: ranks among the section's distinct counts, in two steps, so that a section with very many
    of them is ranked by several tasks."""
    grave, light = ["critical", "major"], ["missing_required", "clarification_needed"]
    counts = packages.groupBy(key, *grave, *light).agg(F.count(F.lit(1)).alias("_n"))
    groups = counts.groupBy(key, *grave).agg(F.sum("_n").alias("_g"))
    upto = lambda n, by, order: F.coalesce(F.sum(n).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = groups.withColumn("_before", upto("_g", [key], grave)).withColumn("_all", F.sum("_g").over(Window.partitionBy(key)))
    ranked = counts.join(groups, [key, *grave]).withColumn("losses", F.col("_before") + upto("_n", [key, *grave], light))
    ranked = ranked.select(key, *grave, *light, (F.col("_all") - F.col("losses") - F.col("_n")).alias("wins"), (F.col("_n") - 1).alias("ties"), "losses")
    return packages.join(ranked, [key, *grave, *light]).select(*packages.columns, "wins", "ties", "losses")
