"""Registered queries over stores (tables, objects, JSON lines), requests and single rules, each with its SQL.

What is read from a store has been written to it from a driver table just before."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classification as C
from ..operators import lifecycle, packages, scoring, search, snapshots, summaries, views
from ..operators.common import scratch
from ..operators.keyed import KeyedTables, Layout
from ..schemas import LIFECYCLE, SHOP_DRAWING, missing_fields, schema, split_by_domain
from ..sources import containers, store
from ..streaming import tracking
from .catalog import DAY_SQL, LIFECYCLE_OF, _day_pages, query, table

# ---- tables and keys -------------------------------------------------------------------------


@query("SELECT l_orderkey AS package_id, count(*) AS n, sum(l_partkey)::BIGINT AS page_count FROM lineitem GROUP BY 1")
def stored_table_scan(spark, sf_dir):
    """Line items stored as the table `submittals` and read by its schema."""
    root = scratch(spark, "tables")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("bigint").alias("id"), F.col("l_orderkey").cast("bigint").alias("package_id"), F.col("l_partkey").cast("int").alias("page_count"))
    have = set(rows.columns)
    rows.select(*(F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema("submittals").fields)).write.parquet(f"{root}/submittals")
    return store.read_table(spark, root, "submittals").groupBy("package_id").agg(F.count(F.lit(1)).alias("n"), F.sum("page_count").alias("page_count"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def lookup_by_key(spark, sf_dir):
    return store.lookup(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), o_orderkey=7)


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = 7 AND l_linenumber = 1")
def lookup_by_natural_key(spark, sf_dir):
    return store.lookup(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), l_orderkey=7, l_linenumber=1)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7")
def lookup_by_foreign_key(spark, sf_dir):
    return store.lookup(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), o_custkey=7)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (1, 7, 30)")
def lookup_any_of(spark, sf_dir):
    """An empty list finds nothing."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return store.lookup(orders, o_custkey=[1, 7, 30]).unionByName(store.lookup(orders, o_custkey=[]))


# ---- tables in buckets by key ----------------------------------------------------------------


def _keyed(spark: SparkSession, layouts: dict[str, Layout]) -> KeyedTables:
    return KeyedTables(snapshots.Snapshots(spark, scratch(spark, "keyed")), layouts)


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 1 THEN 'new ' || c_name WHEN c_custkey % 5 <> 0 THEN c_name END AS c_name,
       CASE WHEN c_custkey % 5 = 0 OR c_custkey % 4 = 1 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal
FROM customer WHERE c_custkey % 9 <> 0
""")
def merged_by_key(spark, sf_dir):
    """A stored table after a merge of new and changed rows (nulls keep) and a delete."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    tables = _keyed(spark, {"customers": Layout(("c_custkey",), 16)})
    tables.create("customers", rows.where("c_custkey % 5 <> 0"))
    changed = rows.where("c_custkey % 5 = 0 or c_custkey % 4 = 1")
    tables.merge("customers", changed.select("c_custkey", F.expr("if(c_custkey % 4 = 1, concat('new ', c_name), null)").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal")))
    tables.delete("customers", rows.where("c_custkey % 9 = 0").select("c_custkey"))
    return tables.read("customers")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT s_suppkey * 3 FROM supplier)")
def found_by_key(spark, sf_dir):
    """Orders of many customers at once, through the manifest and filters of a table kept by customer."""
    tables = _keyed(spark, {"orders": Layout(("o_custkey", "o_orderkey"), 16, ("o_custkey",))})
    tables.create("orders", table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"))
    return tables.lookup("orders", table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("o_custkey")))


@query(f"""
WITH s AS (
  SELECT o_custkey AS spec_id, o_orderpriority AS division,
         CASE WHEN o_orderkey % 7 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'complete' ELSE 'pending' END WHEN o_orderkey % 11 = 3 THEN 'excluded' ELSE {LIFECYCLE_OF} END AS st
  FROM orders
)
SELECT spec_id, division, count(*) FILTER (st = 'complete') AS complete, count(*) FILTER (st <> 'excluded') AS total, count(*) FILTER (st = 'excluded') AS excluded,
       coalesce(round(count(*) FILTER (st = 'complete') / nullif(count(*) FILTER (st <> 'excluded'), 0), 4), 0.0) AS score,
       CASE WHEN count(*) FILTER (st <> 'excluded') > 0 THEN round(count(*) FILTER (st = 'complete') / count(*) FILTER (st <> 'excluded'), 4) END AS stored
FROM s GROUP BY 1, 2
""")
def rolled_up_changes(spark, sf_dir):
    """Counts and stored scores after two changes of stored sections, moved along by the changed rows alone."""
    orders = table(spark, sf_dir, "orders")
    sections = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("spec_id"), F.col("o_orderpriority").alias("division"), F.expr(LIFECYCLE_OF).alias("lifecycle_status"))
    sections = sections.withColumns({"chosen_packages": F.array().cast("array<bigint>"), "lifecycle_status_override": F.lit(False)})
    tables = _keyed(spark, {t: replace(layout, buckets=8) for t, layout in lifecycle.LAYOUTS.items()})
    tables.create("sections", sections)
    lifecycle.keep_counts(tables)
    before = lifecycle.completion_of_counts(tables.read("section_counts"), ["spec_id", "division"])
    tables.create("divisions", before.select("spec_id", "division", F.when(F.col("total") > 0, F.col("score")).alias("division_completion_score")))
    lifecycle.change_sections(tables, orders.where("o_orderkey % 11 = 3").select(F.col("o_orderkey").alias("id"), F.lit("excluded").alias("lifecycle_status")))
    lifecycle.change_sections(tables, orders.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("id"), F.expr("if(o_orderkey % 2 = 0, 'complete', 'pending')").alias("lifecycle_status")))
    now = lifecycle.completion_of_counts(tables.read("section_counts"), ["spec_id", "division"])
    stored = tables.read("divisions").withColumnRenamed("division_completion_score", "stored")
    return now.join(stored, ["spec_id", "division"], "left").withColumn("stored", F.when(F.col("total") > 0, F.col("stored")))


@query("""
WITH q AS (SELECT DISTINCT upper(substr(p_name, 2, 7)) AS q FROM part WHERE p_partkey % 40 = 0 UNION SELECT unnest(['1', '12', '', 'no such name'])
), t AS (SELECT p_partkey, p_name FROM part)
SELECT q, p_partkey FROM q JOIN t ON contains(lower(p_name), lower(q))
""")
def indexed_search(spark, sf_dir):
    """Substrings of part names, short ones too, looked up in an index of character runs."""
    part = table(spark, sf_dir, "part")
    tables = _keyed(spark, search.layouts("names", "p_partkey", 8))
    index = search.TextIndex(tables, "names", "p_partkey")
    index.build(part.select("p_partkey", "p_name"), "p_name")
    asked = part.where("p_partkey % 40 = 0").select(F.upper(F.substring("p_name", 2, 7)).alias("q"))
    return index.search(asked.unionByName(spark.createDataFrame([("1",), ("12",), ("",), ("no such name",)], "q string")))


# ---- results as a stream ---------------------------------------------------------------------


@query(f"""
WITH e AS (SELECT user_id, event_id, event_type = 'purchase' AS pr, {DAY_SQL} AS d FROM events)
SELECT user_id::VARCHAR AS section_number,
       coalesce(string_agg(d::VARCHAR || ',' || (d + 1)::VARCHAR, ',' ORDER BY event_id) FILTER (pr), '') AS primary_pages,
       coalesce(string_agg(d::VARCHAR || ',' || (d + 1)::VARCHAR, ',' ORDER BY event_id) FILTER (NOT pr), '') AS reference_pages,
       0::BIGINT AS n_failed, 1::BIGINT AS n_left
FROM e GROUP BY 1
""")
def tracked_results(spark, sf_dir):
    """Every event as a run that is asked and answered, as files in no order that a stream reads; between two of its starts come
    the rest and half of the first files again. Each section leaves once, with its pages in the order of event_id."""
    root = scratch(spark, "stream")
    e = _day_pages(spark, sf_dir).where("section is not null")
    runs = e.select(F.lit("all").alias("spec_id"), F.col("section").cast("string").alias("section_number"), F.col("event_id").cast("string").alias("custom_id"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("is_primary"), F.col("page").alias("start"), (F.col("page") + 1).alias("end"))
    turn = F.pmod(F.xxhash64("custom_id"), F.lit(4))
    asked = runs.select("spec_id", "section_number", "custom_id", F.lit("asked").alias("type"))
    answers = runs.withColumn("type", F.lit("succeeded")).withColumn("attempt", F.lit(0))
    parts = 8  # of what is put at once, so that no task writes all of it; a micro-batch takes the files of two puts
    put = lambda rows: rows.repartition(parts).write.mode("append").json(f"{root}/in")
    put(asked)
    put(answers.where(turn < 2))
    for more in (answers.where(turn == 3).unionByName(answers.where(turn == 1)), answers.where(turn == 2)):
        stream = tracking.events(spark, f"{root}/in", 2 * parts)
        tracking.start(tracking.tracked(stream), f"{root}/out", f"{root}/checkpoint").awaitTermination()
        put(more)
    tracking.start(tracking.tracked(tracking.events(spark, f"{root}/in", 2 * parts)), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    sections = spark.read.parquet(f"{root}/out").where("kind = 'section'")
    left = F.count(F.lit(1)).over(Window.partitionBy("spec_id", "section_number")).alias("n_left")
    return sections.select("section_number", text("primary_pages"), text("reference_pages"), "n_failed", left)


# ---- objects ---------------------------------------------------------------------------------


def _written(spark: SparkSession, objects: DataFrame) -> tuple[str, DataFrame]:
    """The folder that the objects were written to, and what came of it."""
    root = scratch(spark, "objects")
    store.write_objects(objects, root).write.parquet(f"{root}-report")
    return root, spark.read.parquet(f"{root}-report")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as pages of their nation's file; every third has an image."""
    c = F.col
    image = F.when(c("s_suppkey") % 3 == 0, F.encode(c("s_name"), "UTF-8"))
    text = F.when(c("s_suppkey") % 4 != 1, c("s_name"))
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("spec"), c("s_nationkey").cast("string")).alias("spec_id"), c("s_suppkey").cast("int").alias("page_index"), text.alias("text"), image.alias("image"))


PAGES_SQL = """
WITH p AS (SELECT 'spec' || s_nationkey AS spec_id, s_suppkey::INT AS page_index, CASE WHEN s_suppkey % 4 <> 1 THEN s_name END AS text,
                  CASE WHEN s_suppkey % 3 = 0 THEN s_name END AS image FROM supplier)
"""


@query(PAGES_SQL + "SELECT spec_id, page_index, text, image FROM p WHERE (text IS NOT NULL OR image IS NOT NULL) AND page_index >= 3 AND page_index < 60")
def stored_page_range(spark, sf_dir):
    """Pages written as objects and read back, first inclusive and end exclusive."""
    root, _ = _written(spark, store.converted_objects(_pages(spark, sf_dir)))
    return store.converted_pages(spark, root, 3, 60).withColumn("image", F.col("image").cast("string"))


@query(PAGES_SQL + """
SELECT spec_id, page_index, text, image FROM p WHERE page_index >= 3 AND page_index < 60 AND spec_id IN ('spec1', 'spec4', 'spec7', 'spec19', 'spec22')
""")
def packed_page_range(spark, sf_dir):
    """Pages of some projects and a range of pages out of containers."""
    root = scratch(spark, "containers")
    containers.write_pages(_pages(spark, sf_dir), root, 8)
    found = containers.read_pages(spark, root, ["spec1", "spec4", "spec7", "spec19", "spec22"], 3, 60)
    return found.withColumns({c: F.col(c).cast("string") for c in ("text", "image")})


@query(PAGES_SQL + "SELECT spec_id, page_index, CASE WHEN text IS NOT NULL AND image IS NOT NULL THEN 'hybrid' WHEN text IS NOT NULL THEN 'text' WHEN image IS NOT NULL THEN 'image' ELSE 'none' END AS kind FROM p")
def stored_page_kinds(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    root, _ = _written(spark, store.converted_objects(pages))
    found = store.pages_with_content(pages.select("spec_id", "page_index"), store.converted_pages(spark, root))
    text, image = F.col("text").isNotNull(), F.col("image").isNotNull()
    return found.select("spec_id", "page_index", F.when(text & image, "hybrid").when(text, "text").when(image, "image").otherwise("none").alias("kind"))


@query(PAGES_SQL + """
SELECT spec_id || '/converted/' || page_index || '/TEXT.txt' AS key, strlen(text) AS length FROM p WHERE text IS NOT NULL
UNION ALL SELECT spec_id || '/converted/' || page_index || '/IMAGE.png', strlen(image) FROM p WHERE image IS NOT NULL
""")
def object_listing(spark, sf_dir):
    root, _ = _written(spark, store.converted_objects(_pages(spark, sf_dir)))
    return store.objects(spark, root, content=False).select(F.regexp_extract("path", "[^/]+/converted/.*$", 0).alias("key"), "length")


@query(PAGES_SQL + ", o AS (SELECT count(text) + count(image) AS n FROM p) SELECT n AS attempts, n AS successes, 100.0::DOUBLE AS success_rate, 0::BIGINT AS n_failed FROM o")
def upload_report(spark, sf_dir):
    root = scratch(spark, "objects")
    metrics = store.write_observed(store.converted_objects(_pages(spark, sf_dir)), root, f"{root}-report")
    return spark.createDataFrame([metrics], "attempts bigint, successes bigint, success_rate double, n_failed bigint")


@query("""
SELECT 'n' || s_nationkey AS spec_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)::INT AS part, s_name AS content FROM supplier
""")
def stored_original_parts(spark, sf_dir):
    """A nation's suppliers as the files of one upload, numbered from 1: part 10 comes after part 9."""
    files = table(spark, sf_dir, "supplier").groupBy(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("spec_id"))
    contents = F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda s: F.encode(s["s_name"], "UTF-8"))
    root, _ = _written(spark, store.numbered_parts(files.agg(contents.alias("contents"))))
    return store.original_parts(spark, root).withColumn("content", F.col("content").cast("string"))


@query("SELECT 'n' || s_nationkey AS spec_id, count(*) AS n_pages, true AS has_pages FROM supplier GROUP BY 1 UNION ALL SELECT 'missing', 0, false")
def stored_page_counts(spark, sf_dir):
    pages = table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("spec_id"), F.col("s_suppkey").cast("int").alias("page"))
    keys = pages.select(T.page_key(F.col("spec_id"), F.col("page")).alias("key"), F.encode(F.lit("pdf"), "UTF-8").alias("content"))
    root, _ = _written(spark, keys)
    found = store.page_counts(spark, root).withColumn("has_pages", F.lit(True))
    lost = spark.createDataFrame([("missing", 0, store.has_original(spark, root, "missing"))], "spec_id string, n_pages bigint, has_pages boolean")
    return found.unionByName(lost)


@query("""
SELECT CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN 'errored' WHEN o_orderkey % 5 = 0 THEN 'expired' ELSE 'succeeded' END AS type,
       CASE WHEN o_orderkey % 11 = 0 THEN 'broken' WHEN o_orderkey % 13 = 0 THEN 'untyped' ELSE 'read' END AS why, count(*) AS n, sum(CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_orderkey END)::BIGINT AS keys
FROM orders GROUP BY 1, 2
""")
def batch_lines(spark, sf_dir):
    """Orders as lines of a batch's result file; some are no JSON, some lack a type."""
    key = F.col("o_orderkey")
    kind = F.when(key % 13 != 0, F.when(key % 5 == 0, "expired").otherwise("succeeded"))
    good = F.to_json(F.struct(F.concat(F.lit("r"), key.cast("string")).alias("custom_id"), kind.alias("type"), key.alias("seq")))
    root = scratch(spark, "lines")
    table(spark, sf_dir, "orders").select(F.when(key % 11 == 0, F.concat(F.lit("broken {"), key.cast("string"))).otherwise(good).alias("value")).write.text(root)
    rows = store.batch_results(spark, root)
    why = F.when(F.startswith("error", F.lit("broken")), "broken").when(F.col("error") == "no type", "untyped").otherwise("read")
    return rows.groupBy("type", why.alias("why")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("seq"), F.lit(0)).alias("keys"))


# ---- rules -----------------------------------------------------------------------------------


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the pages of their returned lines as primary and of the others as reference; every seventh is not classified yet."""
    pages = lambda test: F.array_sort(F.collect_list(F.when(F.expr(test), F.col("l_linenumber").cast("int"))))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(pages("l_returnflag = 'R'").alias("p"), pages("l_returnflag <> 'R'").alias("r"))
    fresh = F.col("l_orderkey") % 7 == 0
    return rows.select("l_orderkey", F.when(~fresh, F.col("p")).alias("primary_pages"), F.when(~fresh, F.col("r")).alias("reference_pages"))


@query("""
SELECT l_orderkey, CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN 'with' ELSE 'without' END AS primary_pages FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY 1
""")
def primary_page_filter(spark, sf_dir):
    rows = _paged(spark, sf_dir)
    of = lambda df, name: df.select("l_orderkey", F.lit(name).alias("primary_pages"))
    return of(views.with_primary_pages(rows), "with").unionByName(of(views.without_primary_pages(rows), "without"))


@query("""
SELECT l_orderkey, CASE WHEN l_orderkey % 7 = 0 THEN '' ELSE coalesce(string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) FILTER (l_returnflag = 'R'), string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber)) END AS pages
FROM lineitem GROUP BY 1
""")
def pages_to_read(spark, sf_dir):
    pages = summaries.pages_to_read(F.col("primary_pages"), F.col("reference_pages"))
    return _paged(spark, sf_dir).select("l_orderkey", F.array_join(pages.cast("array<string>"), ",").alias("pages"))


@query("""
WITH r AS (SELECT event_id AS id, user_id AS package_id, event_type, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS n FROM events WHERE user_id = 7)
SELECT id, 'one' AS asked FROM r WHERE n = 1 AND id % 10 = 4 UNION ALL SELECT id, 'type' FROM r WHERE event_type = 'click' UNION ALL SELECT id, 'all' FROM r
""")
def run_dispatch(spark, sf_dir):
    """By a submittal that a run is about alone, else by type, else all of a package's."""
    runs = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("package_id"), F.col("event_type").alias("run_type"), F.col("ts").alias("created_at"), F.expr("if(event_id % 2 = 0, array(event_id % 10), array(event_id % 10, 1))").alias("submittal_ids"))
    asked = [("one", {"submittal_id": 4, "run_type": "click"}), ("type", {"run_type": "click"}), ("all", {})]
    first, *rest = (packages.find_runs(runs, 7, **how).select("id", F.lit(name).alias("asked")) for name, how in asked)
    for more in rest:
        first = first.unionByName(more)
    return first


@query("SELECT event_id AS id FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 5")
def newest_runs(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("package_id"), F.col("ts").alias("created_at"))
    return packages.find_runs(runs, 7).limit(5).select("id")


@query("""
SELECT CASE WHEN o_orderkey % 6 < 4 THEN 'fine' ELSE 'refused' END AS verdict, count(*) AS n FROM orders GROUP BY 1
""")
def domain_split(spark, sf_dir):
    """Every value of the domain, one outside it, and null."""
    values = F.element_at(F.array(*(F.lit(x) for x in (*LIFECYCLE, "done")), F.lit(None).cast("string")), (F.col("o_orderkey") % 6 + 1).cast("int"))
    fine, refused = split_by_domain(table(spark, sf_dir, "orders").select(values.alias("status")), "status", LIFECYCLE)
    return fine.withColumn("verdict", F.lit("fine")).unionByName(refused.withColumn("verdict", F.lit("refused"))).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH n AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'None stated' WHEN 1 THEN 'nonesuch' ELSE 'item ' || l_linenumber END AS x FROM lineitem),
     k AS (SELECT l_orderkey, x, row_number() OVER (PARTITION BY l_orderkey ORDER BY x) AS i, count(*) OVER (PARTITION BY l_orderkey) AS c FROM n WHERE lower(x) NOT LIKE 'none%')
SELECT o.l_orderkey, coalesce(string_agg(x, ', ' ORDER BY i) FILTER (i <= 2), '') || CASE WHEN coalesce(max(c), 0) > 2 THEN ' +' || (max(c) - 2) || ' more' ELSE '' END AS shown
FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN k ON o.l_orderkey = k.l_orderkey GROUP BY 1
""")
def shown_names(spark, sf_dir):
    """Lists without placeholders, by their first two names."""
    name = F.expr("case l_linenumber % 4 when 0 then 'None stated' when 1 then 'nonesuch' else concat('item ', l_linenumber) end")
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(name)).alias("names"))
    return lists.select("l_orderkey", T.first_names(T.without_placeholders(F.col("names")), 2).alias("shown"))


@query("SELECT o_custkey AS spec_id, count(*) AS n_sections FROM orders GROUP BY 1")
def section_totals(spark, sf_dir):
    return views.section_totals(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("spec_id")), ["spec_id"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END + o_orderkey AS tokens FROM orders")
def token_totals(spark, sf_dir):
    usage = F.struct(F.expr("if(o_orderkey % 3 = 0, null, o_custkey)").alias("input_tokens"), F.col("o_orderkey").alias("output_tokens"))
    return table(spark, sf_dir, "orders").select("o_orderkey", scoring.total_tokens(usage).alias("tokens"))


@query("SELECT d AS division, row_number() OVER (ORDER BY try_cast(d AS INT) NULLS LAST, d) - 1 AS rank FROM (SELECT DISTINCT p_size::VARCHAR AS d FROM part UNION SELECT DISTINCT p_brand FROM part)")
def natural_division_order(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = part.select(F.col("p_size").cast("string").alias("division")).union(part.select("p_brand")).distinct()
    return views.natural_ranks(names)


@query("SELECT s_suppkey, 'spec' || s_nationkey || '/original_pages/page_' || lpad(s_suppkey::VARCHAR, greatest(4, length(s_suppkey::VARCHAR))::INT, '0') || '.pdf' AS key FROM supplier")
def page_keys(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.page_key(F.concat(F.lit("spec"), F.col("s_nationkey").cast("string")), F.col("s_suppkey").cast("int")).alias("key"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || '|' || c_mktsegment ELSE '' END AS items FROM customer")
def json_arrays(spark, sf_dir):
    """Lists kept as JSON; what is none gives an empty list."""
    kept = F.expr("case c_custkey % 3 when 0 then to_json(array(c_name, c_mktsegment)) when 1 then 'not json' end")
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(T.string_array(kept), "|").alias("items"))


@query("SELECT s_suppkey, '2024-05-06 07:08:09' AS updated_at, CASE WHEN s_suppkey % 2 = 0 THEN '2024-05-06 07:08:09' END AS created_at FROM supplier")
def time_stamps(spark, sf_dir):
    """New rows get both times, changed ones one, in whole seconds."""
    rows, now = table(spark, sf_dir, "supplier").select("s_suppkey"), "2024-05-06 07:08:09.75"
    both = snapshots.stamped(rows.where("s_suppkey % 2 = 0"), True, now).unionByName(snapshots.stamped(rows.where("s_suppkey % 2 = 1"), False, now), allowMissingColumns=True)
    return both.select("s_suppkey", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("updated_at", "created_at")))


@query("SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'a b/' || c_custkey ELSE '100%' END AS plain, lower(c_mktsegment) = 'building' AS is_building FROM customer")
def url_text(spark, sf_dir):
    """URL escapes resolved, invalid ones kept; case and blanks put aside."""
    c = table(spark, sf_dir, "customer")
    escaped = F.expr("if(c_custkey % 2 = 0, concat('a%20b%2F', c_custkey), '100%')")
    return c.select("c_custkey", F.trim(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("name"), T.unquoted(escaped).alias("plain"), (F.lower("c_mktsegment") == "building").alias("is_building"))


@query("SELECT n_nationkey, 'document' AS type, 'url' AS url_type, 'https://x/' || n_name AS url, 'application/pdf' AS media_type, to_base64(n_name::BLOB) AS data FROM nation")
def document_blocks(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", T.presented_url(F.col("n_name"), "https://x/").alias("u"), T.base64_block(F.encode("n_name", "UTF-8")).alias("b"))
    return n.select("n_nationkey", "u.type", F.col("u.source.type").alias("url_type"), "u.source.url", "b.source.media_type", "b.source.data")


@query("SELECT o_orderkey, 'Check ' || o_orderkey || ' of ' || o_custkey || ', {other}.' AS prompt FROM orders")
def prompt_texts(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.prompt("Check {a} of {b}, {other}.", a=F.col("o_orderkey"), b=F.col("o_custkey")).alias("prompt"))


# ---- requests --------------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 <= 3 THEN 'succeeded' ELSE 'errored' END AS type, least(o_orderkey % 6, 3)::INT AS attempt FROM orders")
def retry_rounds(spark, sf_dir):
    """Each request fails as many times as its key says; three more rounds are asked."""
    requests = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("custom_id"))
    asked = iter(range(10))

    def ask(df: DataFrame) -> DataFrame:
        return df.withColumn("type", F.when(F.col("o_orderkey") % 6 <= next(asked), "succeeded").otherwise("errored"))

    return C.with_retries(requests, ask).select("o_orderkey", "type", "attempt")


@query("""
SELECT o_orderkey, e < 90000 OR (o_orderkey % 9 <> 0 AND e + 5000 <= 180000) AS fits, CASE WHEN e < 90000 THEN e WHEN o_orderkey % 9 <> 0 THEN e + 5000 END AS tokens
FROM (SELECT o_orderkey, (o_orderkey * 37 % 200000)::BIGINT AS e FROM orders)
""")
def context_guard(spark, sf_dir):
    """Estimates below half of the allowance stand; the others are counted, some in vain."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 37 % 200000).alias("estimate"))
    exact = lambda df: df.withColumn("exact_tokens", F.when(F.col("o_orderkey") % 9 != 0, F.col("estimate") + 5000))
    return scoring.within_context(rows, "estimate", exact).select("o_orderkey", "fits", "tokens")


@query("""
WITH s AS (SELECT l_orderkey AS id, count(*) AS n, bool_and(l_partkey % 3 = 0) AS drawings_only FROM lineitem GROUP BY 1),
     r AS (SELECT o_orderkey AS id, o_custkey, n, drawings_only, c_custkey IS NOT NULL AS found FROM orders JOIN s ON id = o_orderkey LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) ON c_custkey = o_custkey)
SELECT id, drawings_only, CASE WHEN found THEN CASE WHEN drawings_only THEN 'drawings of ' ELSE 'all of ' END || o_custkey END AS prompt,
       CASE WHEN found THEN 2 + n + 2 END AS n_blocks, CASE WHEN found THEN 2 END AS cached_at, CASE WHEN NOT found THEN 'section not found' END AS error,
       CASE WHEN found THEN 'spec/original_pages/page_000' || (o_custkey % 3 + 1) || '.pdf' END AS last_page
FROM r
""")
def package_checks(spark, sf_dir):
    """Orders as packages, their lines as submittals, customers as sections: primary pages, or reference pages where there are none."""
    c = F.col
    own = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), F.lit("spec").alias("spec_id"), c("o_custkey").cast("string").alias("section_number"))
    subs = table(spark, sf_dir, "lineitem").select(c("l_linenumber").cast("bigint").alias("id"), c("l_orderkey").alias("package_id"), F.when(c("l_partkey") % 3 == 0, SHOP_DRAWING).otherwise(2187).alias("submittal_type_id"), F.concat(F.lit("k"), c("l_linenumber").cast("string")).alias("s3_key"))
    pages = F.array((c("c_custkey") % 3 + 1).cast("int"), (c("c_custkey") % 3).cast("int"))
    none = F.array().cast("array<int>")
    sections = table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(F.lit("spec").alias("spec_id"), c("c_custkey").cast("string").alias("section_number"), F.when(c("c_custkey") % 2 == 0, pages).otherwise(none).alias("primary_pages"), F.when(c("c_custkey") % 2 == 1, pages).otherwise(none).alias("reference_pages"))
    asked = scoring.package_check_requests(own, sections, subs, "all of {section_number}", "drawings of {section_number}")
    at = F.expr("array_position(transform(blocks, b -> b.cached), true) - 1")
    return asked.select("id", "drawings_only", "prompt", F.size("blocks").cast("bigint").alias("n_blocks"), at.cast("int").alias("cached_at"), "error", F.expr("blocks[2].url").alias("last_page"))


@query("""
SELECT o_orderkey, '03-' || o_custkey || '-u-' || CASE WHEN o_orderkey % 3 = 0 THEN a::VARCHAR ELSE a || '-' || (a + o_orderkey % 3) END AS custom_id, 1 + o_orderkey % 3 AS n_pages,
       'section ' || o_custkey || ' pages [' || CASE o_orderkey % 3 WHEN 0 THEN a::VARCHAR WHEN 1 THEN a || ',' || (a + 1) ELSE a || ',' || (a + 1) || ',' || (a + 2) END || ']' AS prompt
FROM (SELECT *, o_orderkey % 50 AS a FROM orders)
""")
def classification_requests(spark, sf_dir):
    c = F.col
    start = (c("o_orderkey") % 50).cast("int")
    runs = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("03").alias("division"), c("o_custkey").cast("string").alias("section_number"), F.lit("u").alias("spec_id"), start.alias("start"), (start + c("o_orderkey") % 3).cast("int").alias("end"))
    asked = scoring.run_requests(runs, "section {section_number} pages {pages_analyzed}")
    return asked.select("o_orderkey", "custom_id", F.size("page_keys").cast("bigint").alias("n_pages"), "prompt")


@query("""
SELECT conv_id, string_agg('===== PAGE ' || turn || ' START =====' || chr(10) || trim(t) || chr(10) || '===== PAGE ' || turn || ' END =====' || chr(10), '' ORDER BY turn) AS pages
FROM (SELECT conv_id, turn, 'text ' || length(min(text)) AS t FROM conversations GROUP BY 1, 2) GROUP BY 1
""")
def summary_requests(spark, sf_dir):
    """A conversation as a section, its turns as pages: the prompt carries the pages' texts in order."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.length(F.min("text")).alias("n"))
    turns = turns.select(F.col("conv_id").cast("string").alias("spec_id"), F.col("conv_id").cast("string").alias("section_number"), F.col("turn").cast("int").alias("page_index"), F.concat(F.lit("text "), F.col("n").cast("string")).alias("text"))
    runs = turns.where("text is not null").select("spec_id", "section_number", F.col("page_index").alias("start"), F.col("page_index").alias("end"))
    asked = scoring.section_requests(runs, turns, "{pages}")
    return asked.select(F.col("section_number").cast("bigint").alias("conv_id"), F.col("prompt").alias("pages"))


@query("""
SELECT o_orderkey, concat_ws(',', 'o_missing', CASE WHEN o_orderkey % 4 = 0 THEN 'o_orderpriority' WHEN o_orderkey % 4 = 1 THEN 'o_orderpriority' END, CASE WHEN o_orderkey % 3 = 0 THEN 'o_totalprice' END) AS missing FROM orders
""")
def required_fields(spark, sf_dir):
    """What each request lacks of the required fields: blank, null or not there at all."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("case o_orderkey % 4 when 0 then ' ' when 1 then null else o_orderpriority end").alias("o_orderpriority"), F.expr("if(o_orderkey % 3 = 0, null, o_totalprice)").alias("o_totalprice"))
    return orders.select("o_orderkey", F.array_join(missing_fields(orders, ["o_totalprice", "o_orderkey", "o_missing", "o_orderpriority"]), ",").alias("missing"))


@query("SELECT l_orderkey, count(*) AS n, bool_or(l_linenumber % 2 = 0) AS changed FROM lineitem GROUP BY 1")
def shards_joined(spark, sf_dir):
    """Shards (lines of odd and of even number) put together again, and whether the odd shard alone lacks something of the whole."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    odd = li.where("l_linenumber % 2 = 1")
    ids = lambda df, name: df.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias(name))
    whole = ids(odd.unionByName(li.where("l_linenumber % 2 = 0")), "all")
    return whole.join(ids(odd, "some"), "l_orderkey", "left").select("l_orderkey", F.size("all").cast("bigint").alias("n"), (~F.col("all").eqNullSafe(F.col("some"))).alias("changed"))
