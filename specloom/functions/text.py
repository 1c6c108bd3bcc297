"""Column functions over section codes, page texts, composite ids and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import SUBMITTAL_TYPES

# The forms of section codes that texts carry (003132, 00 31 32, 00-31-32, 00.31.32, 003132.12, 003132.12a).
CANDIDATE = r"(?U)(?<![0-9.])(?:(?:0[0-9]|[1-4][0-9]|49)(?:[\s.\-]?\d{2}){2})(?:\.\d{1,2})?[A-Za-z]?(?![0-9])"
CODE_PARTS = r"^(\d{2})\.?(\d{2})\.?(\d{2})(\.\d+)?([a-zA-Z]?)$"
WORD = "[A-Za-z0-9]{2,}"
TOKENS_PER_TEXT_PAGE, TOKENS_PER_IMAGE = 1500, 1000


def candidates(text: Column) -> Column:
    """All section-code candidates of a text, in order, repeats included."""
    return F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))


def normalise(code: Column) -> Column:
    """A code in compact form, or null."""
    clean = F.regexp_replace(code, r"(?U)[\s\-]", "")
    return F.when(clean.rlike(CODE_PARTS), F.regexp_replace(clean, CODE_PARTS, "$1$2$3$4$5"))


def division_of(code: Column) -> Column:
    return F.substring(code, 1, 2)


def alnum_count(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]", ""))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)))


def passes_quality(alnum: Column, words: Column) -> Column:
    return ((alnum >= 50) & (words >= 10)) | (words >= 15)


def has_text(text: Column) -> Column:
    """False for null and blank pages."""
    return F.coalesce(F.length(F.regexp_replace(text, r"(?U)\s", "")) > 0, F.lit(False))


def page_route(text: Column, has_images: Column) -> Column:
    """How a page is converted: read by OCR, kept as text and picture, or kept as text."""
    fine = passes_quality(alnum_count(text), word_count(text))
    return F.when(~fine, "ocr").when(has_images, "text_and_image").otherwise("text")


def optimal_dpi(long_edge_points: Column, max_pixels: int = 1568) -> Column:
    return F.greatest(F.lit(72), F.floor(max_pixels / (long_edge_points / 72)).cast("int"))


def page_key(spec_id: Column, page: Column) -> Column:
    return F.concat(spec_id, F.lit("/original_pages/page_"), F.format_string("%04d", page), F.lit(".pdf"))


def composite_id(division: Column, section: Column, spec_id: Column, start: Column, end: Column) -> Column:
    """The id of a request about pages start to end of a section; one page is named once."""
    pages = F.when(start == end, start.cast("string")).otherwise(F.concat_ws("-", start, end))
    return F.concat_ws("-", division, F.replace(section, F.lit("."), F.lit("_")), spec_id, pages)


def parse_composite_id(custom_id: Column) -> Column:
    """struct(division, section_number, spec_id, start, end); a spec_id is a UUID of five parts."""
    parts = F.split(custom_id, "-")
    run = F.size(parts) == 9
    end = F.element_at(parts, -1).try_cast("int")
    return F.struct(
        F.try_element_at(parts, F.lit(1)).alias("division"),
        F.replace(F.try_element_at(parts, F.lit(2)), F.lit("_"), F.lit(".")).alias("section_number"),
        F.array_join(F.slice(parts, 3, 5), "-").alias("spec_id"),
        F.when(run, F.try_element_at(parts, F.lit(-2)).try_cast("int")).otherwise(end).alias("start"),
        end.alias("end"),
    )


def page_range(start: Column, end: Column) -> Column:
    """The pages from start to end, both included; none where end comes first."""
    return F.when(start <= end, F.sequence(start, end)).otherwise(F.array().cast("array<int>"))


def page_blocks(pages: Column) -> Column:
    """One text of an array of (page_index, text), without blank pages."""
    kept = F.filter(pages, lambda p: has_text(p["text"]))
    return F.array_join(F.transform(kept, lambda p: F.format_string("===== PAGE %d START =====\n%s\n===== PAGE %d END =====\n", p["page_index"], F.trim(p["text"]), p["page_index"])), "")


def prompt(template: str, **values: Column) -> Column:
    """The template with each {name} replaced."""
    out: Column = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def string_array(json: Column) -> Column:
    """A JSON list of strings, or an empty one where it is none."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def without_placeholders(values: Column) -> Column:
    """The strings that do not start with "none", in any case."""
    return F.filter(values, lambda x: ~F.startswith(F.lower(x), F.lit("none")))


def first_names(names: Column, shown: int = 3) -> Column:
    """The first names and how many more there are."""
    more = F.size(names) - shown
    return F.concat(F.array_join(F.slice(names, 1, shown), ", "), F.when(more > 0, F.format_string(" +%d more", more)).otherwise(""))


def submittal_type_name(type_id: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for code, name in SUBMITTAL_TYPES.items():
        out = out.when(type_id == code, name)
    return out


def token_estimate(text: Column, is_jpeg: Column) -> Column:
    return F.when(has_text(text), TOKENS_PER_TEXT_PAGE).otherwise(0) + F.when(is_jpeg, TOKENS_PER_IMAGE).otherwise(0)


def duration_label(seconds: Column) -> Column:
    """Seconds, minutes or hours with two decimals (halves of a last digit go up)."""
    return F.when(seconds < 60, F.format_string("%.2f seconds", seconds)).when(seconds < 3600, F.format_string("%.2f minutes", seconds / 60)).otherwise(F.format_string("%.2f hours", seconds / 3600))


def elapsed_label(seconds: Column) -> Column:
    """Whole seconds as "4s" or "2m 4s"; a dash for null and negative ones."""
    m, s = F.floor(seconds / 60), seconds % 60
    return F.when(seconds.isNull() | (seconds < 0), "—").when(m == 0, F.format_string("%ds", s)).otherwise(F.format_string("%dm %ds", m, s))


def percent_label(score: Column) -> Column:
    return F.when(score < 0.01, F.concat(F.format_string("%.4f", score), F.lit("%"))).otherwise(F.concat(F.floor(score * 100 + 0.5).cast("string"), F.lit("%")))


def band(value: Column, limits: list[tuple[float, str]], lowest: str) -> Column:
    """The name of the first limit that the value reaches, from the highest down; null stays null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for limit, name in limits:
        out = out.when(value >= limit, name)
    return out.otherwise(lowest)


def completion_band(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.5, "middle").when(score > 0, "low").otherwise("none")


def package_band(score: Column) -> Column:
    return band(score, [(0.7, "high"), (0.4, "middle")], "low")


def comparison_band(score: Column) -> Column:
    return band(score * 100, [(75, "high"), (50, "middle")], "low")


def short_id(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", "").otherwise(F.concat(F.left(value, F.lit(8)), F.lit("…"), F.right(value, F.lit(4))))


def is_pdf(name: Column, media_type: Column) -> Column:
    """By both its type and its suffix."""
    return F.coalesce((media_type == "application/pdf") & F.endswith(F.lower(name), F.lit(".pdf")), F.lit(False))


def unquoted(value: Column) -> Column:
    """URL escapes resolved; what is no valid escape stays as it is."""
    return F.coalesce(F.try_url_decode(value), value)


def presented_url(key: Column, prefix: str = "") -> Column:
    """A document block that points at a stored object."""
    return F.struct(F.lit("document").alias("type"), F.struct(F.lit("url").alias("type"), F.concat(F.lit(prefix), key).alias("url")).alias("source"))


def base64_block(data: Column, media_type: str = "application/pdf") -> Column:
    return F.struct(F.lit("document").alias("type"), F.struct(F.lit("base64").alias("type"), F.lit(media_type).alias("media_type"), F.base64(data).alias("data")).alias("source"))
