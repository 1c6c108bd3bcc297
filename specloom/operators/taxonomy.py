"""Candidates in page texts, validated against a taxonomy of section codes (division, section_number, title)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import UNDOCUMENTED
from .common import small_or_plain


def known_codes(taxonomy: DataFrame) -> DataFrame:
    return taxonomy.select("section_number").distinct()


def extract_codes(pages: DataFrame, text: str = "text") -> DataFrame:
    """A row for each candidate on a page (blank pages have none): pages' other columns, raw and code (normalised, null if it cannot be)."""
    return pages.select(*[c for c in pages.columns if c != text], F.explode(T.candidates(F.col(text))).alias("raw")).withColumn("code", T.normalise(F.col("raw")))


def validate_codes(codes: DataFrame, taxonomy: DataFrame, column: str = "code") -> DataFrame:
    """The rows whose code is known, or whose first six characters are where it is longer, or whose first four begin a known code where it is not.

    Three equality joins on small distinct sides take the place of a scan over all known codes per row."""
    known = known_codes(taxonomy)
    flag = lambda keys, name: small_or_plain(keys.select(F.col("key").alias(f"_{name}_key"), F.lit(True).alias(f"_{name}")).distinct())
    exact = flag(known.select(F.col("section_number").alias("key")), "exact")
    base = flag(known.where(F.length("section_number") == 6).select(F.col("section_number").alias("key")), "base")
    prefix = flag(known.select(F.substring("section_number", 1, 4).alias("key")), "prefix")
    c = F.col(column)
    joined = (
        codes.where(c.isNotNull())
        .join(exact, c == F.col("_exact_key"), "left")
        .join(base, F.substring(c, 1, 6) == F.col("_base_key"), "left")
        .join(prefix, F.substring(c, 1, 4) == F.col("_prefix_key"), "left")
    )
    fine = F.col("_exact").isNotNull() | ((F.length(c) > 6) & F.col("_base").isNotNull()) | ((F.length(c) <= 6) & F.col("_prefix").isNotNull())
    return joined.where(fine).select(*codes.columns)


def with_titles(sections: DataFrame, taxonomy: DataFrame, column: str = "section_number", title: str = "section_title") -> DataFrame:
    """sections with the taxonomy's title, or the fixed one for codes it lacks."""
    names = small_or_plain(taxonomy.groupBy(F.col("section_number").alias("_code")).agg(F.min("title").alias("_title")))
    return sections.join(names, F.col(column) == F.col("_code"), "left").withColumn(title, F.coalesce("_title", F.lit(UNDOCUMENTED))).drop("_code", "_title")


def with_division_titles(divisions: DataFrame, taxonomy: DataFrame, column: str = "division") -> DataFrame:
    """divisions with the title of their code {division}0000; divisions without one raise when the result is computed."""
    heads = taxonomy.where(F.expr("section_number = concat(division, '0000')")).groupBy(F.col("division").alias("_division")).agg(F.min("title").alias("_title"))
    joined = divisions.join(small_or_plain(heads), F.col(column) == F.col("_division"), "left")
    message = F.concat(F.lit("no title for division "), F.coalesce(F.col(column), F.lit("null")))
    return joined.withColumn("division_title", F.when(F.col("_title").isNull(), F.raise_error(message).cast("string")).otherwise(F.col("_title"))).drop("_division", "_title")
