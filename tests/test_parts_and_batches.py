"""Folds in parts, runs in two levels, standings without pairs, batches filled in order: against plain loops, with hot keys."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from specloom.operators import classification, compliance, folds, runs, scoring, summaries
from specloom.operators.common import numbered


def plain_runs(pages):
    out = []
    for p in pages:
        if out and out[-1][1] + 1 == p:
            out[-1][1] = p
            out[-1][2] += 1
        else:
            out.append([p, p, 1])
    return [tuple(r) for r in out]


@pytest.mark.parametrize("span", [1, 4, 4096])
def test_runs_across_spans(spark, monkeypatch, span):
    monkeypatch.setattr(runs, "SPAN", span)
    rng = random.Random(span)
    pages = {k: [rng.randrange(-20, 40) for _ in range(n)] for k, n in (("a", 70), ("b", 15), ("c", 1))}
    pages["d"] = list(range(-9, 30)) + [3, 4, 4, 7, 8, 11, 12]
    pairs = spark.createDataFrame([(k, p) for k, ps in pages.items() for p in ps] + [("n", None)], "section string, page int")
    got = lambda df: {k: sorted((r["start"], r["end"], r["length"]) for r in df.collect() if r["section"] == k) for k in pages}
    assert got(runs.page_runs(pairs, ["section"])) == {k: plain_runs(sorted(set(ps))) for k, ps in pages.items()}
    assert got(runs.runs_with_repeats(pairs, ["section"])) == {k: sorted(plain_runs(sorted(ps))) for k, ps in pages.items()}
    assert runs.page_runs(pairs, ["section"]).where("section = 'n'").count() == 1


def test_a_hot_section_has_its_runs_in_many_tasks(spark):
    pairs = spark.range(300_000).where("id % 1000 <> 7").select(F.lit("hot").alias("section"), F.col("id").cast("int").alias("page"))
    out = runs.page_runs(pairs, ["section"])
    assert out.count() == 301 and out.agg(F.sum("length")).first()[0] == 299_700
    spans = pairs.select("section", "page", runs._span("page")).repartition(8, "section", "_span").groupBy(F.spark_partition_id()).count()
    assert spans.count() == 8


def test_numbers_follow_the_order(spark):
    rows = spark.createDataFrame([(random.Random(i).random(),) for i in range(2000)], "x double").repartition(5)
    got = numbered(rows, ["x"]).orderBy("_pos").collect()
    assert [r["_pos"] for r in got] == list(range(2000)) and [r["x"] for r in got] == sorted(r["x"] for r in got)


def test_parts_put_together_are_the_whole_lists(spark):
    rng = random.Random(1)
    rows = [(f"s{rng.randrange(4)}", i, rng.choice([True, False, None]), s := rng.randrange(50), s + rng.randrange(3)) for i in range(400)]
    results = spark.createDataFrame(rows, "section string, seq bigint, is_primary boolean, start int, end int").repartition(3)
    whole = {r["section"]: (r["new_primary"], r["new_reference"]) for r in classification.page_lists(results, ["section"]).collect()}
    parts = sorted((r["section"], r["is_primary"], r["part"], r["pages"]) for r in folds.page_list_parts(results, ["section"], size=7).collect())
    lists = defaultdict(list)
    for section, primary, _, pages in parts:
        lists[section, primary] += pages
    assert {s: (lists[s, True], lists[s, False]) for s in whole} == whole
    summed = results.select("section", "seq", F.concat(F.lit("t"), "seq").alias("section_title"), F.array(F.col("seq").cast("string")).alias("materials"))
    merged = {r["section"]: (r["section_title"], r["materials"]) for r in summaries.merge_summaries(summed, ["section"]).collect()}
    got = defaultdict(list)
    for r in sorted(folds.summary_parts(summed, ["section"], ["section_title"], ["materials"], size=9).collect(), key=lambda r: r["part"]):
        assert r["section_title"] == merged[r["section"]][0]
        got[r["section"]] += r["materials"]
    assert got == {s: m for s, (_, m) in merged.items()}


def test_a_hot_key_of_a_million_values_comes_in_parts(spark):
    rows = spark.range(1_000_000).select(F.lit("hot").alias("k"), F.col("id").alias("seq"), (F.col("id") % 97).alias("v"))
    parts = folds.in_parts(rows, ["k"], ["seq"], ["seq", "v"], size=5000)
    sizes = parts.select("part", F.size("items").alias("n"), F.col("items")[0]["seq"].alias("first")).collect()
    assert len(sizes) == 200 and {r["n"] for r in sizes} == {5000}
    assert all(r["first"] == 5000 * r["part"] for r in sizes)


def test_standings_count_what_pairs_would(spark):
    rng = random.Random(2)
    rows = [(s, i, rng.choice([0.5, 0.55, 0.56, 0.9, 1.0, 0.8512]), *(rng.randrange(3) for _ in range(4))) for s in range(3) for i in range(1, 25)] + [(9, 1, 0.3, 0, 0, 0, 0)]
    packages = spark.createDataFrame(rows, "section_id int, id int, compliance_score double, critical int, major int, missing_required int, clarification_needed int")
    for standings, compare in ((compliance.standings_by_score, compliance.compare_by_score), (compliance.standings_by_severity, compliance.compare_by_severity)):
        want = {(r[0], r[1]): [0, 0, 0] for r in rows}
        for p in compare(compliance.pairs_within(packages)).collect():
            for side, ident in (("A", p["id_a"]), ("B", p["id_b"])):
                want[p["section_id"], ident][1 if p["overall_winner"] == "tie" else 0 if p["overall_winner"] == side else 2] += 1
        got = {(r["section_id"], r["id"]): [r["wins"], r["ties"], r["losses"]] for r in standings(packages).collect()}
        assert got == want


@pytest.mark.parametrize(("n", "span"), [(0, 10), (1, 10), (95, 10), (1000, 64), (300, 1000)])
def test_batches_are_those_of_one_pass(spark, n, span):
    rng = random.Random(n)
    sizes = [rng.choice([1, 5, 30, 99, 140]) for _ in range(n)]
    want, start, total = [], 0, 0
    for i, x in enumerate(sizes):
        if i > start and (total + x > 100 or i - start >= 8):
            start, total = i, 0
        total += x
        want.append(start)
    rows = spark.createDataFrame([(7 * i, x, i) for i, x in enumerate(sizes)], "seq bigint, size_bytes bigint, i int").repartition(3)
    got = {r["i"]: r["batch"] for r in scoring.full_batches(rows, span=span, most_requests=8, most_bytes=100).collect()}
    assert [got[i] for i in range(n)] == want
    with pytest.raises(ValueError, match="span"):
        scoring.full_batches(rows, span=7, most_requests=8)
