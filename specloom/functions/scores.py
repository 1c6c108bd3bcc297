"""Completion and compliance scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Deductions in hundredths, limits and weights of the two scoring rules.
DEDUCTIONS = {"missing_required": 5, "clarification_needed": 2, "minor": 3, "major": 10, "critical": 20}
COMPLIANT_FROM = 0.85
WEIGHTS = {"critical": 0.75, "major": 0.4, "minor": 0.1, "clarification_needed": 0.1, "missing_required": 0.15, "missing_optional": 0.05}
TIE_BAND = 0.05


def completion(complete: Column, counted: Column) -> Column:
    """complete / counted to four places, 0 where nothing counts."""
    return F.coalesce(F.round(F.try_divide(complete, counted), 4), F.lit(0.0))


def deduction_score(missing_required: Column, clarification: Column, minor: Column, major: Column, critical: Column) -> Column:
    """1 less the deductions, which are summed as whole hundredths, 0 at least."""
    d = DEDUCTIONS
    off = missing_required * d["missing_required"] + clarification * d["clarification_needed"] + minor * d["minor"] + major * d["major"] + critical * d["critical"]
    return F.greatest(F.lit(0), 100 - off) / 100


def is_compliant(score: Column, major: Column, critical: Column) -> Column:
    return (score >= COMPLIANT_FROM) & (major + critical == 0)


def weighted_score(requirements: Column, missing_required: Column, missing_optional: Column, clarification: Column, minor: Column, major: Column, critical: Column, other: Column | None = None) -> Column:
    """1 less the weighted penalties per requirement, to two places; 0 without requirements. Severities that the weights do not name count as minor.

    In whole numbers throughout, halves up: two engines never differ in a last digit."""
    w = {k: round(100 * v) for k, v in WEIGHTS.items()}
    off = critical * w["critical"] + major * w["major"] + minor * w["minor"] + clarification * w["clarification_needed"] + missing_required * w["missing_required"] + missing_optional * w["missing_optional"]
    if other is not None:
        off = off + other * w["minor"]
    left = F.greatest(F.lit(0), 100 * requirements - off)
    return F.coalesce(F.floor(F.try_divide(2 * left + requirements, 2 * requirements)) / 100, F.lit(0.0))


def is_compliant_weighted(score: Column, major: Column, critical: Column) -> Column:
    return (score > COMPLIANT_FROM) & (major + critical == 0)


def winner_by_score(score_a: Column, score_b: Column, band: float = TIE_BAND) -> Column:
    """The higher score; "tie" where they are less than the band apart. Compared in ten-thousandths, so that the band's edge is exact."""
    d = F.round((score_a - score_b) * 10_000).cast("long")
    return F.when(F.abs(d) <= round(band * 10_000), "tie").when(d > 0, "A").otherwise("B")


def winner_by_severity(a: list[Column], b: list[Column]) -> Column:
    """Counts from the gravest down: the first that differs decides for the smaller one."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for x, y in zip(a, b, strict=True):
        out = out.when(x < y, "A").when(x > y, "B")
    return out.otherwise("tie")


def success_rate(succeeded: Column, attempted: Column) -> Column:
    """In percent; 0 without attempts."""
    return F.coalesce(F.try_divide(succeeded, attempted) * 100, F.lit(0.0))
