"""Registered queries over the driver tables, each with the SQL that must give the same rows.

The driver tables stand in for the engine's: orders for sections, lineitem for submittals, events
for results. Every query runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..operators import classification as C
from ..operators import compliance, folds, lifecycle, packages, runs, scoring, snapshots, summaries, taxonomy, views
from ..schemas import SHOP_DRAWING, SUBMITTAL_TYPES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Values that the stand-ins use on both sides.
LIFECYCLE_OF = "CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'P' THEN 'excluded' ELSE 'pending' END"
DAY = "CAST(datediff(CAST(ts AS DATE), DATE '2024-01-01') AS INT)"
DAY_SQL = "CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as sections: one per order, division by priority."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("spec_id"), F.col("o_orderpriority").alias("division"), F.col("o_orderkey").alias("id"), F.expr(LIFECYCLE_OF).alias("lifecycle_status"))


def _day_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as (section, page): the user and the day."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("section"), F.expr(DAY).alias("page"), "event_type", "event_id")


# ---- lifecycle -------------------------------------------------------------------------------


@query(f"""
WITH s AS (SELECT o_orderpriority AS division, {LIFECYCLE_OF} AS st FROM orders)
SELECT division, grouping(division) = 1 AS is_project,
       count(*) FILTER (st = 'complete') AS complete, count(*) FILTER (st <> 'excluded') AS total,
       count(*) FILTER (st = 'excluded') AS excluded,
       coalesce(round(count(*) FILTER (st = 'complete') / nullif(count(*) FILTER (st <> 'excluded'), 0), 4), 0.0) AS score
FROM s GROUP BY GROUPING SETS ((division), ())
""")
def lifecycle_rollup(spark, sf_dir):
    one = _sections(spark, sf_dir).withColumn("spec_id", F.lit("all"))
    return lifecycle.lifecycle_rollup(one).drop("spec_id")


@query(f"""
SELECT o_custkey AS spec_id, o_orderpriority AS division,
       count(*) FILTER ({LIFECYCLE_OF} = 'complete') AS complete, count(*) FILTER ({LIFECYCLE_OF} <> 'excluded') AS total,
       count(*) FILTER ({LIFECYCLE_OF} = 'excluded') AS excluded,
       coalesce(round(count(*) FILTER ({LIFECYCLE_OF} = 'complete') / nullif(count(*) FILTER ({LIFECYCLE_OF} <> 'excluded'), 0), 4), 0.0) AS score
FROM orders GROUP BY 1, 2
""")
def division_completion(spark, sf_dir):
    return lifecycle.division_completion(_sections(spark, sf_dir))


@query(f"""
SELECT o_custkey AS spec_id,
       count(*) FILTER ({LIFECYCLE_OF} = 'complete') AS complete, count(*) FILTER ({LIFECYCLE_OF} <> 'excluded') AS total,
       count(*) FILTER ({LIFECYCLE_OF} = 'excluded') AS excluded,
       coalesce(round(count(*) FILTER ({LIFECYCLE_OF} = 'complete') / nullif(count(*) FILTER ({LIFECYCLE_OF} <> 'excluded'), 0), 4), 0.0) AS score
FROM orders GROUP BY 1
""")
def project_completion(spark, sf_dir):
    return lifecycle.project_completion(_sections(spark, sf_dir))


@query(f"""
WITH sc AS (
  SELECT o_custkey, count(*) FILTER ({LIFECYCLE_OF} = 'complete') AS c, count(*) FILTER ({LIFECYCLE_OF} <> 'excluded') AS t FROM orders GROUP BY 1
)
SELECT c_custkey AS spec_id, CASE WHEN t > 0 THEN round(c / t, 4) ELSE c_acctbal END AS project_completion_score
FROM customer LEFT JOIN sc ON c_custkey = o_custkey
""")
def stored_scores(spark, sf_dir):
    owners = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("spec_id"), F.col("c_acctbal").alias("project_completion_score"))
    return lifecycle.store_scores(owners, lifecycle.project_completion(_sections(spark, sf_dir)), ["spec_id"], "project_completion_score")


@query(f"""
SELECT o_orderkey AS id,
       CASE WHEN o_orderkey % 7 = 0 THEN 'in_progress'
            WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 AND o_custkey % 2 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'complete' ELSE 'pending' END
            ELSE {LIFECYCLE_OF} END AS lifecycle_status,
       CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END ELSE 0 END AS n_chosen,
       CASE WHEN o_orderkey % 5 = 0 THEN true ELSE o_custkey % 2 = 1 END AS lifecycle_status_override
FROM orders
""")
def lifecycle_changes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    empty = F.array().cast("array<bigint>")
    sections = orders.select(F.col("o_orderkey").alias("id"), F.expr(LIFECYCLE_OF).alias("lifecycle_status"), empty.alias("chosen_packages"), (F.col("o_custkey") % 2 == 1).alias("lifecycle_status_override"))
    changes = orders.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderkey") % 7 == 0, "in_progress").alias("lifecycle_status"),
        F.when(F.col("o_orderkey") % 3 == 0, F.when(F.col("o_orderkey") % 2 == 0, F.array("o_orderkey")).otherwise(empty)).alias("chosen_packages"),
        F.when(F.col("o_orderkey") % 5 == 0, True).alias("override"),
    )
    out = lifecycle.apply_lifecycle(sections, changes)
    return out.select("id", "lifecycle_status", F.size("chosen_packages").alias("n_chosen"), "lifecycle_status_override")


@query("""
WITH ch AS (
  SELECT o_orderkey AS section_id, o_orderkey % 2 = 0 AS any_chosen FROM orders WHERE o_orderkey % 3 = 0
)
SELECT l_orderkey AS section_id, l_linenumber AS id,
       CASE WHEN section_id IS NULL THEN l_returnflag = 'R' ELSE any_chosen AND l_linenumber IN (1, 2) END AS is_chosen
FROM lineitem LEFT JOIN ch ON l_orderkey = section_id
""")
def commit_selection(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("section_id"), F.col("l_linenumber").alias("id"), (F.col("l_returnflag") == "R").alias("is_chosen"))
    orders = table(spark, sf_dir, "orders")
    sections = orders.select(F.col("o_orderkey").alias("id"), F.lit("pending").alias("lifecycle_status"), F.array().cast("array<bigint>").alias("chosen_packages"), F.lit(False).alias("lifecycle_status_override"))
    chosen = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array().cast("array<int>"))
    choices = orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("section_id"), chosen.alias("chosen"))
    return lifecycle.commit_selection(li, sections, choices)[0]


@query("""
WITH gone AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 10 = 0)
SELECT o_custkey AS id, count(*) AS n_hit FROM orders WHERE o_orderkey IN (SELECT id FROM gone) AND o_orderstatus = 'F' GROUP BY 1
""")
def deleted_packages(spark, sf_dir):
    """Sections (customers) that lose a chosen package (order), and how many."""
    orders = table(spark, sf_dir, "orders")
    own = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("section_id"), (F.col("o_orderstatus") == "F").alias("is_chosen"))
    chosen = own.where("is_chosen").groupBy("section_id").agg(F.collect_set("id").alias("chosen_packages"))
    sections = chosen.select(F.col("section_id").alias("id"), F.lit("complete").alias("lifecycle_status"), "chosen_packages", F.lit(False).alias("lifecycle_status_override"))
    pairs = orders.select(F.col("o_orderkey").alias("package_id_a"), (F.col("o_orderkey") + 1).alias("package_id_b"))
    ids = orders.where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("id"))
    after = lifecycle.delete_packages(own, pairs, sections, ids)[2]
    both = sections.select("id", F.size("chosen_packages").alias("a")).join(after.select("id", F.size("chosen_packages").alias("b"), "lifecycle_status_override"), "id")
    return both.where("lifecycle_status_override").select("id", (F.col("a") - F.col("b")).cast("bigint").alias("n_hit"))


# ---- pages and runs --------------------------------------------------------------------------


@query(f"""
WITH p AS (SELECT DISTINCT user_id AS section, {DAY_SQL} AS page FROM events),
     r AS (SELECT *, page - row_number() OVER (PARTITION BY section ORDER BY page) AS k FROM p)
SELECT section, min(page) AS start, max(page) AS "end", count(*) AS length FROM r GROUP BY section, k
""")
def section_runs(spark, sf_dir):
    return runs.page_runs(_day_pages(spark, sf_dir), ["section"])


@query(f"""
WITH p AS (SELECT user_id AS section, {DAY_SQL} AS page FROM events),
     f AS (SELECT *, CASE WHEN lag(page) OVER (PARTITION BY section ORDER BY page) + 1 = page THEN 0 ELSE 1 END AS new FROM p)
SELECT section, sum(new)::BIGINT AS n_runs, sum(new) = 1 AS all_contiguous FROM f GROUP BY 1
""")
def run_contiguity(spark, sf_dir):
    return runs.contiguity(_day_pages(spark, sf_dir), ["section"])


@query(f"SELECT user_id AS section, count(DISTINCT {DAY_SQL}) AS total_pages FROM events GROUP BY 1")
def pages_per_section(spark, sf_dir):
    return runs.pages_per_section(runs.page_runs(_day_pages(spark, sf_dir), ["section"]), ["section"])


@query(f"""
SELECT user_id AS section, string_agg(DISTINCT {DAY_SQL}::VARCHAR, ',' ORDER BY {DAY_SQL}::VARCHAR) AS pages FROM events GROUP BY 1
""")
def section_index(spark, sf_dir):
    found = runs.section_index(_day_pages(spark, sf_dir), ["section"])
    return found.select("section", F.array_join(F.array_sort(F.col("pages").cast("array<string>")), ",").alias("pages"))


@query(f"""
WITH p AS (SELECT DISTINCT user_id AS section, {DAY_SQL} AS page FROM events),
     r AS (SELECT *, page - row_number() OVER (PARTITION BY section ORDER BY page) AS k FROM p),
     u AS (SELECT section, min(page) AS a, count(*) AS n FROM r GROUP BY section, k)
SELECT section, coalesce(string_agg(a::VARCHAR, ',' ORDER BY a) FILTER (n = 1), '') AS single, count(*) FILTER (n > 1) AS n_multi FROM u GROUP BY 1
""")
def single_and_multi(spark, sf_dir):
    found = runs.single_and_multi(runs.page_runs(_day_pages(spark, sf_dir), ["section"]), ["section"])
    return found.select("section", F.array_join(F.col("single").cast("array<string>"), ",").alias("single"), F.size("multi").cast("bigint").alias("n_multi"))


@query("""
WITH c AS (SELECT l_orderkey, lpad(l_partkey::VARCHAR, 6, '0') AS code FROM lineitem)
SELECT l_orderkey, count(DISTINCT substr(code, 1, 2)) AS total_divisions, count(DISTINCT code) AS total_sections FROM c GROUP BY 1
""")
def section_counts(spark, sf_dir):
    codes = table(spark, sf_dir, "lineitem").select("l_orderkey", F.lpad(F.col("l_partkey").cast("string"), 6, "0").alias("section_number"))
    return runs.section_counts(codes, ["l_orderkey"])


@query("""
WITH c AS (SELECT DISTINCT o_custkey AS spec_id, lpad((o_orderkey % 500000)::VARCHAR, 6, '0') AS section_number FROM orders)
SELECT spec_id, substr(section_number, 1, 2) AS division, string_agg(section_number, ',' ORDER BY section_number) AS sections FROM c GROUP BY 1, 2
""")
def nested_sections(spark, sf_dir):
    codes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("spec_id"), F.lpad((F.col("o_orderkey") % 500000).cast("string"), 6, "0").alias("section_number")).distinct()
    return runs.nest_by_division(codes).select("spec_id", "division", F.array_join(F.transform("sections", lambda s: s["section_number"]), ",").alias("sections"))


@query("""
SELECT c_custkey, i AS worker, c_custkey * i // 6 AS start, c_custkey * (i + 1) // 6 AS "end" FROM customer, range(6) t(i)
""")
def shard_bounds(spark, sf_dir):
    pages = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("n_pages"))
    return runs.shard_bounds(pages).select("c_custkey", F.col("worker").cast("bigint").alias("worker"), "start", "end")


# ---- codes -----------------------------------------------------------------------------------

# Each line item carries its part key as a code, spelled in one of four ways.
SPELLED = "CASE l_linenumber % 4 WHEN 0 THEN c WHEN 1 THEN substr(c,1,2)||' '||substr(c,3,2)||' '||substr(c,5,2) WHEN 2 THEN substr(c,1,2)||'-'||substr(c,3,2)||'-'||substr(c,5,2) ELSE c||'.12a' END"


def _spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lpad((F.col("l_partkey") * 37 % 600000).cast("string"), 6, "0").alias("c"))
    return li.select("l_orderkey", "l_linenumber", F.concat(F.lit("see "), F.expr(SPELLED), F.lit(" for it")).alias("text"))


@query(f"""
WITH t AS (SELECT l_orderkey, l_linenumber, lpad((l_partkey * 37 % 600000)::VARCHAR, 6, '0') AS c FROM lineitem),
     x AS (SELECT l_orderkey, l_linenumber, c, {SPELLED} AS raw FROM t)
SELECT l_orderkey, l_linenumber, raw, CASE WHEN l_linenumber % 4 = 3 THEN c || '.12a' ELSE c END AS code
FROM x WHERE substr(c, 1, 1) IN ('0', '1', '2', '3', '4')
""")
def code_extract(spark, sf_dir):
    return taxonomy.extract_codes(_spelled(spark, sf_dir))


def _codes_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.lpad((F.col("p_partkey") * 37 % 600000).cast("string"), 6, "0").alias("section_number"), F.col("p_name").alias("title"))


@query("""
WITH k AS (SELECT DISTINCT lpad((p_partkey * 37 % 600000)::VARCHAR, 6, '0') AS s FROM part WHERE p_partkey % 3 = 0),
     t AS (SELECT l_orderkey, l_linenumber, lpad((l_partkey * 37 % 600000)::VARCHAR, 6, '0') || CASE WHEN l_linenumber % 4 = 3 THEN '.12a' ELSE '' END AS code FROM lineitem)
SELECT l_orderkey, l_linenumber, code FROM t
WHERE code IN (SELECT s FROM k) OR (length(code) > 6 AND substr(code, 1, 6) IN (SELECT s FROM k))
   OR (length(code) <= 6 AND substr(code, 1, 4) IN (SELECT substr(s, 1, 4) FROM k))
""")
def code_validate(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    suffix = F.when(F.col("l_linenumber") % 4 == 3, ".12a").otherwise("")
    codes = li.select("l_orderkey", "l_linenumber", F.concat(F.lpad((F.col("l_partkey") * 37 % 600000).cast("string"), 6, "0"), suffix).alias("code"))
    return taxonomy.validate_codes(codes, _codes_taxonomy(spark, sf_dir))


@query("""
WITH k AS (SELECT lpad((p_partkey * 37 % 600000)::VARCHAR, 6, '0') AS s, min(p_name) AS title FROM part WHERE p_partkey % 3 = 0 GROUP BY 1)
SELECT l_orderkey, l_linenumber, coalesce(title, 'Undocumented Section Number (MSF2020)') AS section_title
FROM lineitem LEFT JOIN k ON lpad((l_partkey * 37 % 600000)::VARCHAR, 6, '0') = s
""")
def title_lookup(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lpad((F.col("l_partkey") * 37 % 600000).cast("string"), 6, "0").alias("section_number"))
    return taxonomy.with_titles(li, _codes_taxonomy(spark, sf_dir)).drop("section_number")


@query("SELECT n_name AS division, r_name AS division_title FROM nation JOIN region ON n_regionkey = r_regionkey")
def division_titles(spark, sf_dir):
    heads = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    codes = heads.select(F.col("n_name").alias("division"), F.concat("n_name", F.lit("0000")).alias("section_number"), F.col("r_name").alias("title"))
    return taxonomy.with_division_titles(table(spark, sf_dir, "nation").select(F.col("n_name").alias("division")), codes)


# ---- texts -----------------------------------------------------------------------------------


@query(r"""
WITH m AS (
  SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}]', '', 'g')) AS alnum,
         len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]{2,}')) AS words FROM documents
)
SELECT doc_id, alnum, words, (alnum >= 50 AND words >= 10) OR words >= 15 AS passes,
       CASE WHEN NOT ((alnum >= 50 AND words >= 10) OR words >= 15) THEN 'ocr' WHEN doc_id % 2 = 0 THEN 'text_and_image' ELSE 'text' END AS route
FROM m
""")
def text_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    measured = docs.select("doc_id", T.alnum_count(F.col("text")).cast("bigint").alias("alnum"), T.word_count(F.col("text")).cast("bigint").alias("words"), T.page_route(F.col("text"), F.col("doc_id") % 2 == 0).alias("route"))
    return measured.withColumn("passes", T.passes_quality(F.col("alnum"), F.col("words")))


@query(r"""
WITH m AS (
  SELECT source, doc_id AS dpi, length(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}]', '', 'g')) AS alnum,
         len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]{2,}')) AS words FROM documents WHERE source IS NOT NULL
), p AS (SELECT *, (alnum >= 50 AND words >= 10) OR words >= 15 AS passes FROM m)
SELECT source, dpi, alnum, words, passes FROM p
QUALIFY row_number() OVER (PARTITION BY source ORDER BY NOT passes, CASE WHEN passes THEN dpi END, words DESC, alnum DESC, dpi) = 1
""")
def quality_best_attempt(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("source is not null")
    tried = docs.select("source", F.col("doc_id").alias("dpi"), T.alnum_count(F.col("text")).cast("bigint").alias("alnum"), T.word_count(F.col("text")).cast("bigint").alias("words"))
    return views.best_attempts(tried.withColumn("passes", T.passes_quality(F.col("alnum"), F.col("words"))), ["source"])


@query("SELECT conv_id, turn FROM conversations WHERE length(regexp_replace(coalesce(text, ''), '\\s', '', 'g')) > 0")
def non_blank_pages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where(T.has_text(F.col("text"))).select("conv_id", "turn")


@query("""
SELECT doc_id, CASE WHEN length(trim(coalesce(text, ''))) > 0 THEN 1500 ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN 1000 ELSE 0 END AS tokens FROM documents
""")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text"), F.col("doc_id") % 2 == 0).alias("tokens"))


@query("""
WITH t AS (SELECT conv_id, turn, text FROM conversations WHERE length(trim(coalesce(text, ''))) > 0)
SELECT conv_id, md5(string_agg('===== PAGE ' || turn || ' START =====' || chr(10) || trim(text) || chr(10) || '===== PAGE ' || turn || ' END =====' || chr(10), '' ORDER BY turn, text)) AS digest
FROM t GROUP BY 1
""")
def page_blocks(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct(F.col("turn").alias("page_index"), "text").alias("p"))
    pages = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("pages"))
    texts = pages.select("conv_id", T.page_blocks(F.col("pages")).alias("t")).where("t <> ''")
    return texts.select("conv_id", F.md5("t").alias("digest"))


# ---- classification and summaries ------------------------------------------------------------


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as results: labelled ones succeeded, primary by quality."""
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(marks, "doc_id", "left")
    return d.select("doc_id", F.col("source").alias("spec_id"), F.col("lang").alias("division"), F.concat_ws("-", "lang", (F.col("doc_id") % 10).cast("string")).alias("section_number"), F.when(F.col("quality").isNull(), "errored").otherwise("succeeded").alias("type"), (F.col("quality") == 1).alias("is_primary"))


RESULTS_SQL = """
WITH q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1),
     r AS (SELECT d.doc_id, source AS spec_id, lang AS division, concat_ws('-', lang, doc_id % 10) AS section_number, quality FROM documents d LEFT JOIN q USING (doc_id))
"""


@query(RESULTS_SQL + """
SELECT spec_id, count(DISTINCT division) FILTER (quality IS NOT NULL) AS total_divisions,
       count(DISTINCT section_number) FILTER (quality IS NOT NULL) AS total_sections,
       count(*) FILTER (quality = 1) AS sections_with_primary, count(*) FILTER (quality = 0) AS sections_with_reference,
       count(*) FILTER (quality IS NULL) AS errors
FROM r GROUP BY 1
""")
def classification_tally(spark, sf_dir):
    return C.tally(_results(spark, sf_dir), ["spec_id"])


@query(RESULTS_SQL + """
SELECT spec_id, section_number FROM r WHERE quality IS NOT NULL GROUP BY 1, 2 HAVING max(quality) = 0
""")
def sections_manual(spark, sf_dir):
    return C.sections_without_primary(C.succeeded(_results(spark, sf_dir)), ["spec_id", "section_number"]).where("spec_id is not null")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def unmatched_results(spark, sf_dir):
    return C.unmatched(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


@query(f"""
WITH e AS (SELECT user_id, event_id, event_type = 'purchase' AS pr, {DAY_SQL} AS d FROM events)
SELECT user_id AS section_number,
       coalesce(string_agg(CASE WHEN pr THEN d::VARCHAR || ',' || (d + 1)::VARCHAR END, ',' ORDER BY event_id) FILTER (pr), '') AS primary_pages,
       coalesce(string_agg(CASE WHEN NOT pr THEN d::VARCHAR || ',' || (d + 1)::VARCHAR END, ',' ORDER BY event_id) FILTER (NOT pr), '') AS reference_pages,
       CASE WHEN 2 * count(*) >= 130 THEN 'complete' ELSE 'pending' END AS classification_status
FROM e GROUP BY 1
""")
def page_list_fold(spark, sf_dir):
    e = _day_pages(spark, sf_dir).select(F.col("section").alias("section_number"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("is_primary"), F.col("page").alias("start"), (F.col("page") + 1).alias("end"))
    none = F.lit(None).cast("array<int>")
    sections = e.select("section_number").distinct().select("section_number", none.alias("primary_pages"), F.array().cast("array<int>").alias("reference_pages"), F.lit(130).alias("total_pages"), F.lit("pending").alias("classification_status"))
    out = C.fold_pages(sections, C.page_lists(e, ["section_number"]), ["section_number"])
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return out.select("section_number", text("primary_pages"), text("reference_pages"), "classification_status")


@query(f"""
WITH e AS (SELECT user_id, event_id, event_type = 'purchase' AS pr, {DAY_SQL} AS d FROM events WHERE user_id IS NOT NULL),
     n AS (SELECT *, (row_number() OVER (PARTITION BY user_id, pr ORDER BY event_id) - 1) // 40 AS part FROM e)
SELECT user_id AS section_number, pr AS is_primary, part, string_agg(d::VARCHAR || ',' || (d + 1)::VARCHAR, ',' ORDER BY event_id) AS pages FROM n GROUP BY 1, 2, 3
""")
def page_lists_in_parts(spark, sf_dir):
    """The lists of page_list_fold in parts of 40 results."""
    e = _day_pages(spark, sf_dir).select(F.col("section").alias("section_number"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("is_primary"), F.col("page").alias("start"), (F.col("page") + 1).alias("end"))
    parts = folds.page_list_parts(e, ["section_number"], size=40)
    return parts.select("section_number", "is_primary", "part", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


@query("""
WITH t AS (SELECT conv_id, turn, min(role) AS role, min(text) AS text FROM conversations GROUP BY 1, 2),
     n AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS part, arg_min(role, turn) OVER (PARTITION BY conv_id) AS section_title FROM t)
SELECT conv_id, part, section_title, string_agg(md5(text), ',' ORDER BY turn) AS digests FROM n GROUP BY 1, 2, 3
""")
def summaries_in_parts(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("section_title"), F.min("text").alias("text"))
    rows = turns.select("conv_id", F.col("turn").alias("seq"), "section_title", F.array(F.md5(F.encode("text", "UTF-8"))).alias("digests"))
    parts = folds.summary_parts(rows, ["conv_id"], ["section_title"], ["digests"], size=3)
    return parts.select("conv_id", "part", "section_title", F.array_join("digests", ",").alias("digests"))


@query("""
SELECT conv_id, arg_min(role, turn) AS section_title, string_agg(md5(text), ',' ORDER BY turn) AS digests FROM
  (SELECT conv_id, turn, min(role) AS role, min(text) AS text FROM conversations GROUP BY 1, 2) GROUP BY 1
""")
def summary_merge(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("section_title"), F.min("text").alias("text"))
    parts = turns.select("conv_id", F.col("turn").alias("seq"), "section_title", F.array_compact(F.array(F.md5("text"))).alias("key_requirements"))
    merged = summaries.merge_summaries(parts, ["conv_id"])
    return merged.select("conv_id", "section_title", F.array_join("key_requirements", ",").alias("digests"))


@query("""
WITH a AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events)
SELECT user_id, event_type, event_id FROM a WHERE n = 1
""")
def latest_attempt(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return C.latest_attempt(e, ["user_id", "event_type"], "event_id")


@query("""
SELECT l_orderkey, l_linenumber, s || '-' || u || '-' || CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END AS custom_id,
       lpad(substr(s, 1, 2), 2, '0') AS division, replace(substr(s, 4), '_', '.') AS section_number, a AS "start", b AS "end", b - a + 1 AS n_pages
FROM (
  SELECT l_orderkey, l_linenumber, substr(c, 1, 2) || '-' || c || '_1' AS s, '11111111-2222-3333-4444-' || lpad(l_orderkey::VARCHAR, 12, '0') AS u,
         l_linenumber AS a, (l_linenumber + l_partkey % 3)::INT AS b
  FROM (SELECT *, lpad(l_partkey::VARCHAR, 6, '0') AS c FROM lineitem)
)
""")
def composite_id_roundtrip(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lpad(F.col("l_partkey").cast("string"), 6, "0").alias("c"), F.col("l_linenumber").alias("a"), (F.col("l_linenumber") + F.col("l_partkey") % 3).cast("int").alias("b"))
    spec = F.concat(F.lit("11111111-2222-3333-4444-"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0"))
    built = li.withColumn("custom_id", T.composite_id(T.division_of(F.col("c")), F.concat("c", F.lit(".1")), spec, F.col("a"), F.col("b")))
    keyed = C.with_key(built.select("l_orderkey", "l_linenumber", "custom_id"))
    return keyed.withColumn("n_pages", F.size(T.page_range(F.col("start"), F.col("end")))).drop("spec_id")


# ---- packages and compliance -----------------------------------------------------------------


@query("""
SELECT o_orderkey AS id, count(l_orderkey) AS n_submittals,
       coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS submittals
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1
""")
def packages_with_submittals(spark, sf_dir):
    pk = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("package_id"), F.col("l_linenumber").alias("sub_id"), "l_partkey")
    out = packages.with_submittals(pk, li, child_id="sub_id")
    return out.select("id", F.size("submittals").cast("bigint").alias("n_submittals"), F.array_join(F.transform("submittals", lambda s: F.concat_ws(":", s["sub_id"], s["l_partkey"])), ",").alias("submittals"))


@query("""
WITH e AS (
  SELECT l_orderkey, count(DISTINCT l_linenumber) AS n, count(DISTINCT l_linenumber) FILTER (l_returnflag <> 'N' OR l_linenumber <= 2) AS c FROM lineitem GROUP BY 1
)
SELECT o_orderkey AS id, CASE WHEN n IS NULL THEN 1 ELSE 1 END AS run_count, CASE WHEN coalesce(c, 0) >= coalesce(n, 0) THEN o_totalprice END AS compliance_score
FROM orders LEFT JOIN e ON o_orderkey = l_orderkey
""")
def package_all_checked(spark, sf_dir):
    orders, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    none = F.array().cast("array<bigint>")
    # lines 1 and 2 had been checked before, this run checks those that were returned or accepted
    seen = li.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_linenumber") <= 2, F.col("l_linenumber").cast("bigint"))).alias("before"), F.collect_set(F.when(F.col("l_returnflag") != "N", F.col("l_linenumber").cast("bigint"))).alias("now"))
    both = orders.join(seen, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    pk = both.select(F.col("o_orderkey").alias("id"), F.lit(None).cast("string").alias("compliance_result"), F.lit(None).cast("double").alias("compliance_score"), F.lit(0).alias("run_count"), F.coalesce("before", none).alias("checked_submittal_ids"))
    ran = both.select(F.col("o_orderkey").alias("package_id"), F.coalesce("now", none).alias("checked"), F.lit("{}").alias("compliance_result"), F.col("o_totalprice").alias("compliance_score"))
    subs = li.select(F.col("l_orderkey").alias("package_id"), F.col("l_linenumber").cast("bigint").alias("id"))
    return packages.apply_runs(pk, subs, ran).select("id", "run_count", "compliance_score")


@query("""
WITH j AS (SELECT l_orderkey, '[' || string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) || ']' AS ids FROM lineitem GROUP BY 1)
SELECT l_orderkey, ids FROM j WHERE json_array_length(ids) = 1 AND CAST(json_extract_string(ids, '$[0]') AS BIGINT) = 1
""")
def single_submittal_runs(spark, sf_dir):
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_list("l_linenumber"))).alias("ids"))
    return lists.where(packages.about_one_json(F.col("ids"), F.lit(1)))


@query("""
SELECT user_id, event_type, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1
""")
def latest_run(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return packages.latest_runs(e, ["user_id", "event_type"], "ts", "event_id").drop("ts")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)::INT AS prompt_version FROM events")
def run_version(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return packages.with_versions(e, ["user_id", "event_type"], "ts", "event_id").select("event_id", "prompt_version")


@query("""
SELECT l_orderkey, bool_and(l_partkey % 7 = 0 OR l_returnflag = 'R') AS drawings_only FROM lineitem GROUP BY 1
""")
def drawings_only(spark, sf_dir):
    kind = F.when((F.col("l_partkey") % 7 == 0) | (F.col("l_returnflag") == "R"), SHOP_DRAWING).when(F.col("l_returnflag") == "A", 2187)
    return packages.only_drawings(table(spark, sf_dir, "lineitem").select("l_orderkey", kind.alias("submittal_type_id")), ["l_orderkey"])


@query("""
SELECT a.c_custkey, a.c_mktsegment FROM customer a WHERE EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = a.c_nationkey AND s.s_suppkey % 100 = a.c_custkey % 100)
""")
def name_taken(spark, sf_dir):
    new = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("section_id"), (F.col("c_custkey") % 100).alias("package_name"), "c_custkey", "c_mktsegment")
    have = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("section_id"), (F.col("s_suppkey") % 100).alias("package_name"))
    return packages.name_taken(new, have).select("c_custkey", "c_mktsegment")


EVENT_COUNTS = f"""
WITH c AS (
  SELECT user_id AS section_id, {DAY_SQL} AS id, count(*) AS requirements,
         count(*) FILTER (event_type = 'error') AS missing_required, count(*) FILTER (event_type = 'signup') AS clarification_needed,
         count(*) FILTER (event_type = 'view' AND value > 90) AS minor, count(*) FILTER (event_type = 'click' AND value > 150) AS major,
         count(*) FILTER (event_type = 'purchase' AND value > 300) AS critical
  FROM events GROUP BY 1, 2
)
"""


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("section_id"), F.expr(DAY).alias("id"), "event_type", "value")
    k = lambda test: F.count_if(F.expr(test))
    return e.groupBy("section_id", "id").agg(
        F.count(F.lit(1)).alias("requirements"),
        k("event_type = 'error'").alias("missing_required"),
        k("event_type = 'signup'").alias("clarification_needed"),
        k("event_type = 'view' and value > 90").alias("minor"),
        k("event_type = 'click' and value > 150").alias("major"),
        k("event_type = 'purchase' and value > 300").alias("critical"),
        F.lit(0).cast("bigint").alias("missing_optional"),
    )


DEDUCTED = "greatest(0, 100 - 5 * missing_required - 2 * clarification_needed - 3 * minor - 10 * major - 20 * critical) / 100"
GRADED = EVENT_COUNTS + f", g AS (SELECT *, {DEDUCTED} AS compliance_score FROM c)"


@query(GRADED + """
SELECT section_id, id, compliance_score, compliance_score >= 0.85 AND major + critical = 0 AS is_compliant FROM g
""")
def compliance_score(spark, sf_dir):
    return compliance.score_by_deductions(_counts(spark, sf_dir)).select("section_id", "id", "compliance_score", "is_compliant")


@query(EVENT_COUNTS + """
, w AS (SELECT *, (2 * greatest(0, 100 * requirements - (75 * critical + 40 * major + 10 * minor + 10 * clarification_needed + 15 * missing_required)) + requirements) // (2 * requirements) / 100 AS compliance_score FROM c)
SELECT section_id, id, compliance_score, compliance_score > 0.85 AND major + critical = 0 AS is_compliant FROM w
""")
def compliance_weighted(spark, sf_dir):
    return compliance.score_by_weights(_counts(spark, sf_dir)).select("section_id", "id", "compliance_score", "is_compliant")


@query(GRADED + """
SELECT a.section_id, a.id AS id_a, b.id AS id_b, round(abs(a.compliance_score - b.compliance_score), 4) AS score_delta,
       CASE WHEN abs(round((a.compliance_score - b.compliance_score) * 10000)) <= 500 THEN 'tie' WHEN a.compliance_score > b.compliance_score THEN 'A' ELSE 'B' END AS overall_winner
FROM g a JOIN g b ON a.section_id = b.section_id AND a.id < b.id
""")
def package_compare_a(spark, sf_dir):
    scored = compliance.score_by_deductions(_counts(spark, sf_dir)).select("section_id", "id", "compliance_score")
    return compliance.compare_by_score(compliance.pairs_within(scored)).select("section_id", "id_a", "id_b", "score_delta", "overall_winner")


@query(EVENT_COUNTS + """
SELECT a.section_id, a.id AS id_a, b.id AS id_b,
       CASE WHEN (a.critical, a.major, a.missing_required, a.clarification_needed) < (b.critical, b.major, b.missing_required, b.clarification_needed) THEN 'A'
            WHEN (a.critical, a.major, a.missing_required, a.clarification_needed) > (b.critical, b.major, b.missing_required, b.clarification_needed) THEN 'B' ELSE 'tie' END AS overall_winner
FROM c a JOIN c b ON a.section_id = b.section_id AND a.id < b.id
""")
def package_compare_b(spark, sf_dir):
    counts = _counts(spark, sf_dir).select("section_id", "id", "critical", "major", "missing_required", "clarification_needed")
    return compliance.compare_by_severity(compliance.pairs_within(counts)).select("section_id", "id_a", "id_b", "overall_winner")


@query(GRADED + """
, p AS (SELECT section_id * 1000 + id AS pid, section_id, compliance_score FROM g),
  n AS (SELECT pid AS id_a, lead(pid) OVER (PARTITION BY section_id ORDER BY pid) AS id_b, compliance_score AS a, lead(compliance_score) OVER (PARTITION BY section_id ORDER BY pid) AS b FROM p)
SELECT id_a, id_b, round(abs(a - b), 4) AS score_delta,
       CASE WHEN abs(round((a - b) * 10000)) <= 500 THEN 'tie' WHEN a > b THEN 'A' ELSE 'B' END AS overall_winner
FROM n WHERE id_b IS NOT NULL
""")
def package_compare_next(spark, sf_dir):
    """Each package against the next of its section: as many pairs as packages at most."""
    scored = compliance.score_by_deductions(_counts(spark, sf_dir)).select((F.col("section_id") * 1000 + F.col("id")).alias("id"), "section_id", "compliance_score")
    return compliance.compare_by_score(compliance.pairs_of(scored, compliance.next_pairs(scored))).select("id_a", "id_b", "score_delta", "overall_winner")


@query(GRADED + """
, d AS (SELECT a.section_id, a.id, b.id AS other, round((a.compliance_score - b.compliance_score) * 10000) AS d FROM g a LEFT JOIN g b ON a.section_id = b.section_id AND a.id <> b.id)
SELECT section_id, id, count(other) FILTER (d > 500) AS wins, count(other) FILTER (abs(d) <= 500) AS ties, count(other) FILTER (d < -500) AS losses FROM d GROUP BY 1, 2
""")
def package_standings(spark, sf_dir):
    """Each package against all others of its section by score, counted without their pairs."""
    scored = compliance.score_by_deductions(_counts(spark, sf_dir)).select("section_id", "id", "compliance_score")
    return compliance.standings_by_score(scored).select("section_id", "id", "wins", "ties", "losses")


@query(EVENT_COUNTS + """
, d AS (
  SELECT a.section_id, a.id, b.id AS other,
         (a.critical, a.major, a.missing_required, a.clarification_needed) < (b.critical, b.major, b.missing_required, b.clarification_needed) AS better,
         (a.critical, a.major, a.missing_required, a.clarification_needed) > (b.critical, b.major, b.missing_required, b.clarification_needed) AS worse
  FROM c a LEFT JOIN c b ON a.section_id = b.section_id AND a.id <> b.id
)
SELECT section_id, id, count(other) FILTER (better) AS wins, count(other) FILTER (NOT better AND NOT worse) AS ties, count(other) FILTER (worse) AS losses FROM d GROUP BY 1, 2
""")
def package_standings_severity(spark, sf_dir):
    counts = _counts(spark, sf_dir).select("section_id", "id", "critical", "major", "missing_required", "clarification_needed")
    return compliance.standings_by_severity(counts).select("section_id", "id", "wins", "ties", "losses")


# ---- state changes ---------------------------------------------------------------------------


@query("""
SELECT coalesce(c_custkey, k) AS c_custkey, coalesce(n, c_name) AS c_name, coalesce(b, c_acctbal) AS c_acctbal
FROM customer FULL JOIN (SELECT c_custkey * 2 AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'new ' || c_custkey END AS n, c_acctbal + 1 AS b FROM customer WHERE c_custkey % 2 = 0) ON c_custkey = k
""")
def upsert_sections(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    changes = old.where("c_custkey % 2 = 0").select((F.col("c_custkey") * 2).alias("c_custkey"), F.expr("if(c_custkey % 3 = 0, null, concat('new ', c_custkey))").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return snapshots.upsert(old, changes, ["c_custkey"])


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'changed' ELSE s_name END AS s_name, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal * 2 ELSE s_acctbal END AS s_acctbal FROM supplier
""")
def partial_update(spark, sf_dir):
    old = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    changes = old.where("s_suppkey % 2 = 0").select("s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, "changed").otherwise("").alias("s_name"), (F.col("s_acctbal") * 2).alias("s_acctbal"))
    beyond = changes.withColumn("s_suppkey", F.col("s_suppkey") + 10_000_000)
    return snapshots.update(old, changes.unionByName(beyond), ["s_suppkey"], blank_keeps=True)


@query("""
WITH n AS (SELECT count(*) AS k, max(s_suppkey) AS top FROM supplier)
SELECT s_suppkey AS id FROM supplier UNION ALL SELECT top + i FROM n, generate_series(1, (SELECT count(*) FROM part)) t(i)
""")
def append_with_ids(spark, sf_dir):
    old = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    new = table(spark, sf_dir, "part").select(F.lit(None).cast("bigint").alias("id"), F.col("p_name").alias("name"))
    return snapshots.append(old, new).select("id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 5 <> 0")
def cascade_delete(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("section_id"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("package_id"), "l_linenumber")
    sections = orders.select(F.col("section_id").alias("id")).distinct()
    gone = sections.where("id % 5 = 0")
    after = snapshots.cascade({"sections": sections, "submittal_packages": orders, "submittals": lines}, "sections", gone)
    return after["submittals"].select(F.col("package_id").alias("l_orderkey"), "l_linenumber")


# ---- views and labels ------------------------------------------------------------------------


@query("""
SELECT o_custkey, count(*) AS runs, count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority < '3' AND o_orderkey % 3 = 0) AS complete,
       sum(o_orderkey % 3)::BIGINT AS errors, bool_and(o_orderstatus = 'F' AND o_orderpriority < '3' AND o_orderkey % 3 = 0) AS all_complete
FROM orders GROUP BY 1
""")
def project_board(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.expr("if(o_orderstatus = 'F', 'complete', 'pending')").alias("classification_status"), F.expr("if(o_orderpriority < '3', 'complete', null)").alias("summary_status"), (F.col("o_orderkey") % 3).alias("errors"))
    return views.project_board(rows, ["o_custkey"])


@query("""
SELECT o_custkey, o_orderpriority, bool_and(o_orderstatus IN ('F', 'P')) AS classification_complete, bool_or(o_orderstatus = 'O') AS classification_pending,
       bool_and(o_orderkey % 4 IN (0, 1, 2)) AS summary_complete, bool_or(o_orderkey % 4 = 3) AS summary_pending, bool_or(false) AS summary_error, count(*) AS n_sections
FROM orders GROUP BY 1, 2
""")
def division_status(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", F.expr("case o_orderstatus when 'F' then 'Complete' when 'P' then 'failed' else 'PENDING' end").alias("classification_status"), F.expr("element_at(array('complete', 'manual', 'failed', 'pending'), cast(o_orderkey % 4 + 1 as int))").alias("summary_status"))
    return views.division_status(rows, ["o_custkey", "o_orderpriority"])


@query("""
SELECT p_partkey FROM part WHERE (contains(lower(p_name), 'a') OR contains(lower(p_type), 'a')) AND (lower(p_brand) = 'brand#13' OR p_size % 2 = 0)
""")
def section_search(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("section_title"), F.col("p_type").alias("section_number"), F.expr("if(lower(p_brand) = 'brand#13', 'Complete', null)").alias("classification_status"), F.lit(None).cast("string").alias("summary_status"), F.expr("if(p_size % 2 = 0, 'complete', null)").alias("lifecycle_status"))
    return views.search_sections(rows, " A ", "complete").select("p_partkey")


@query("""
SELECT o_custkey AS spec_id, o_orderpriority AS division, string_agg(o_orderkey::VARCHAR || o_orderstatus, ',' ORDER BY o_orderkey::VARCHAR, o_orderstatus) AS sections FROM orders GROUP BY 1, 2
""")
def sections_by_division(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("spec_id"), F.col("o_orderpriority").alias("division"), F.col("o_orderkey").cast("string").alias("section_number"), "o_orderstatus")
    return views.by_division(rows, ["section_number", "o_orderstatus"]).select("spec_id", "division", F.array_join(F.transform("sections", lambda s: F.concat(s["section_number"], s["o_orderstatus"])), ",").alias("sections"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 7 OR o_orderkey = 7")
def either_side(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("package_id_a"), F.col("o_orderkey").alias("package_id_b"))
    return views.comparisons_of(rows, package_id=7).select("o_orderkey")


@query("""
SELECT l_orderkey, l_linenumber - 1 AS position, l_partkey::INT AS page FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag <> 'R', l_partkey) AS l_linenumber FROM lineitem)
""")
def section_page_order(spark, sf_dir):
    pages = lambda test: F.array_sort(F.collect_list(F.when(F.expr(test), F.col("l_partkey").cast("int"))))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(pages("l_returnflag = 'R'").alias("primary_pages"), pages("l_returnflag <> 'R'").alias("reference_pages"))
    out = views.section_page_order(rows.withColumn("spec_id", F.lit("s")).withColumn("section_number", F.col("id").cast("string")))
    return out.select(F.col("id").alias("l_orderkey"), F.col("position").cast("bigint").alias("position"), "page")


@query("""
WITH r AS (SELECT doc_id, (strlen(coalesce(text, '')) + 200)::BIGINT AS size FROM documents),
     n AS (SELECT *, doc_id // 500 AS g, sum(size) OVER w AS upto, row_number() OVER w AS i FROM r WINDOW w AS (PARTITION BY doc_id // 500 ORDER BY doc_id)),
     b AS (SELECT *, CASE WHEN size > 100000 THEN 'alone-' || doc_id ELSE g || '-' || ((upto - size) // 100000)::BIGINT || '-' || (i - 1) // 40 END AS batch FROM n)
SELECT batch, count(*) AS request_count, sum(size)::BIGINT AS size_bytes, sum(size) <= 200000 OR count(*) = 1 AS within_limit,
       round(sum(size) / 1048576, 3) AS size_mb, CASE WHEN sum(size) >= 256 * 1048576 THEN 'error' WHEN sum(size) >= 220 * 1048576 THEN 'warning' ELSE 'ok' END AS status,
       greatest(0, 256 * 1048576 - sum(size))::BIGINT AS headroom_bytes
FROM b GROUP BY 1
""")
def request_batches(spark, sf_dir):
    """Documents dealt into request batches of 40 requests and 200,000 bytes: each batch with its totals."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 200).cast("bigint").alias("size_bytes"))
    dealt = scoring.batches(docs, order="doc_id", span=500, most_requests=40, most_bytes=200_000)
    return scoring.batch_metrics(dealt).withColumn("within_limit", F.expr("size_bytes <= 200000 or request_count = 1"))


@query("""
WITH RECURSIVE r AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, (o_totalprice * 40)::BIGINT AS size FROM orders),
     p AS (SELECT i, size, sum(size) OVER (ORDER BY i)::BIGINT AS upto, count(*) OVER () AS n FROM r),
     j AS MATERIALIZED (SELECT a.i, a.n, least(a.i + 10000, a.n, greatest(a.i + 1, coalesce(b.i, a.n))) AS following FROM p a ASOF LEFT JOIN p b ON a.upto - a.size + 230686720 < b.upto),
     s(start) AS (SELECT 0::BIGINT UNION ALL SELECT following FROM s JOIN j ON j.i = s.start WHERE following < n)
SELECT start AS batch, count(*) AS request_count, sum(size)::BIGINT AS size_bytes FROM p ASOF JOIN s ON p.i >= s.start GROUP BY 1
""")
def full_request_batches(spark, sf_dir):
    """Orders as requests of some megabytes in batches of at most 10,000 requests and 220 MB, filled in order."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_totalprice") * 40).cast("decimal(20, 0)").cast("bigint").alias("size_bytes"))
    dealt = scoring.full_batches(orders, span=10_000)
    return dealt.groupBy("batch").agg(F.count(F.lit(1)).alias("request_count"), F.sum("size_bytes").alias("size_bytes"))


@query("""
SELECT o_orderkey,
       CASE WHEN s < 60 THEN printf('%.2f seconds', s) WHEN s < 3600 THEN printf('%.2f minutes', s / 60) ELSE printf('%.2f hours', s / 3600) END AS duration,
       CASE WHEN w < 0 THEN '—' WHEN w < 60 THEN w || 's' ELSE (w // 60) || 'm ' || (w % 60) || 's' END AS elapsed
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 100 * 3600)::DOUBLE ELSE (o_orderkey % 3600)::DOUBLE END AS s, o_orderkey % 500 - 20 AS w FROM orders)
""")
def duration_label(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.duration_label(F.expr("cast(if(o_orderkey % 3 = 0, o_orderkey % 100 * 3600, o_orderkey % 3600) as double)")).alias("duration"), T.elapsed_label(F.col("o_orderkey") % 500 - 20).alias("elapsed"))


@query("SELECT c_custkey, substr(c_name, 1, 8) || '…' || right(c_name, 4) AS short_id FROM customer")
def short_id(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.short_id(F.col("c_name")).alias("short_id"))


@query("""
SELECT o_orderkey, CASE WHEN x >= 0.8 THEN 'high' WHEN x >= 0.5 THEN 'middle' WHEN x > 0 THEN 'low' ELSE 'none' END AS completion,
       CASE WHEN x >= 0.7 THEN 'high' WHEN x >= 0.4 THEN 'middle' ELSE 'low' END AS package,
       CASE WHEN x * 100 >= 75 THEN 'high' WHEN x * 100 >= 50 THEN 'middle' ELSE 'low' END AS comparison,
       CASE WHEN x < 0.01 THEN printf('%.4f', x) || '%' ELSE floor(x * 100 + 0.5)::BIGINT || '%' END AS percent
FROM (SELECT o_orderkey, (o_orderkey % 1001) / 1000 AS x FROM orders)
""")
def score_band(spark, sf_dir):
    x = (F.col("o_orderkey") % 1001) / 1000
    return table(spark, sf_dir, "orders").select("o_orderkey", T.completion_band(x).alias("completion"), T.package_band(x).alias("package"), T.comparison_band(x).alias("comparison"), T.percent_label(x).alias("percent"))


@query("SELECT p_partkey, CASE p_size % 8 " + " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(SUBMITTAL_TYPES.values())) + " END AS type_name FROM part")
def type_name(spark, sf_dir):
    code = F.element_at(F.array(*(F.lit(c) for c in (*SUBMITTAL_TYPES, 1))), (F.col("p_size") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.submittal_type_name(code).alias("type_name"))


@query("""
SELECT o_orderkey, greatest(72, floor(1568 / (e / 72))::INT) AS dpi FROM (SELECT o_orderkey, (o_orderkey % 3000 + 100)::DOUBLE AS e FROM orders)
""")
def optimal_dpi(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.optimal_dpi((F.col("o_orderkey") % 3000 + 100).cast("double")).alias("dpi"))


@query("""
SELECT p_partkey FROM part WHERE lower(p_name) NOT LIKE 'none%' AND p_partkey % 2 = 0 AND p_partkey NOT IN (SELECT s_suppkey FROM supplier)
""")
def new_files(spark, sf_dir):
    files = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_partkey").cast("string"), F.expr("if(p_partkey % 2 = 0 and lower(p_name) not like 'none%', '.PDF', '.png')")).alias("name"), F.lit(None).cast("string").alias("type"))
    have = table(spark, sf_dir, "supplier").select(F.concat(F.col("s_suppkey").cast("string"), F.lit(".PDF")).alias("name"))
    return views.new_files(files, have).select("p_partkey")


@query("""
SELECT o_orderpriority, count(*) AS attempted, count(*) FILTER (o_orderstatus = 'F') AS succeeded, round(100.0::DOUBLE * (count(*) FILTER (o_orderstatus = 'F') / count(*)), 9) AS success_rate FROM orders GROUP BY 1
""")
def success_rate(spark, sf_dir):
    counted = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("attempted"), F.count_if(F.col("o_orderstatus") == "F").alias("succeeded"))
    return counted.withColumn("success_rate", F.round(S.success_rate(F.col("succeeded"), F.col("attempted")), 9))
