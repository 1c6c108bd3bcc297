"""Small literal cases of the operators, and models of them in plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from specloom.functions import text as T
from specloom.operators import classification, compliance, lifecycle, packages, runs, scoring, snapshots, summaries, taxonomy, views
from specloom.schemas import COMPLIANCE, KEYS, TABLES, decode, missing_columns, schema, split_by_domain

FORMS = "See 003132, 00 31 32, 00-31-32, 00.31.32, 003132.12, 003132.12a, 00 31 32.12b 1003132 003132.123 50 31 32 03 30 00"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_candidates_and_normal_forms(spark):
    assert one(spark, T.candidates(F.lit(FORMS))) == ["003132", "00 31 32", "00-31-32", "00.31.32", "003132.12", "003132.12a", "00 31 32.12b", "003132", "31 32 03"]
    for raw, code in {"00 31 32": "003132", "00-31-32": "003132", "00.31.32": "003132", "003132.12a": "003132.12a", "00 31 32.12b": "003132.12b", "0031": None}.items():
        assert one(spark, T.normalise(F.lit(raw))) == code


def known(spark, codes):
    return spark.createDataFrame([(c[:2], c, f"title {c}") for c in codes], "division string, section_number string, title string")


def test_validation_order(spark):
    tax = known(spark, ["031000", "033000", "042000.13"])
    codes = spark.createDataFrame([(c,) for c in ("033000", "033000.99", "033000A", "033099", "042000.13", "042000.14", "990000", None)], "code string")
    assert {r["code"] for r in taxonomy.validate_codes(codes, tax).collect()} == {"033000", "033000.99", "033000A", "033099", "042000.13"}


def test_validation_against_a_scan(spark):
    rng = random.Random(3)
    digits = lambda n: "".join(rng.choice("0123") for _ in range(n))
    have = {digits(6) + rng.choice(["", "", ".1"]) for _ in range(60)}
    asked = {digits(6) + rng.choice(["", ".1", "a"]) for _ in range(600)}

    def valid(c):
        if c in have:
            return True
        return c[:6] in have if len(c) > 6 else any(k.startswith(c[:4]) for k in have)

    found = taxonomy.validate_codes(spark.createDataFrame([(c,) for c in asked], "code string"), known(spark, have))
    assert {r["code"] for r in found.collect()} == {c for c in asked if valid(c)}


def test_runs_of_pages(spark):
    pairs = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 5), ("b", 3)], "section string, page int")
    found = {(r["section"], tuple(r["single"]), tuple(map(tuple, r["multi"]))) for r in runs.single_and_multi(runs.page_runs(pairs, ["section"]), ["section"]).collect()}
    assert found == {("a", (5,), ((1, 2),)), ("b", (3,), ())}
    assert {(r["section"], r["n_runs"], r["all_contiguous"]) for r in runs.contiguity(pairs, ["section"]).collect()} == {("a", 3, False), ("b", 1, True)}
    assert [r["pages"] for r in runs.section_index(pairs, ["section"]).orderBy("section").collect()] == [[1, 2, 5], [3]]


def test_pages_to_sections(spark):
    pages = spark.createDataFrame([("s", 0, "03 30 00 and 033000.10"), ("s", 1, "033000"), ("s", 2, " \n"), ("s", 3, None), ("s", 4, "033000 990000")], "spec_id string, page int, text string")
    codes = taxonomy.validate_codes(taxonomy.extract_codes(pages), known(spark, ["033000"]))
    found = runs.page_runs(codes, ["spec_id", "code"]).collect()
    assert {(r["code"], r["start"], r["end"]) for r in found} == {("033000", 0, 1), ("033000", 4, 4), ("033000.10", 0, 0)}


def test_fold_and_tally(spark):
    sections = spark.createDataFrame([("s", "030000", None, [], 2, "pending", None), ("s", "040000", [1], [2], 9, "complete", "pending")], "spec_id string, section_number string, primary_pages array<int>, reference_pages array<int>, total_pages int, classification_status string, summary_status string")
    uuid = "11111111-2222-3333-4444-555555555555"
    results = spark.createDataFrame([(f"03-030000-{uuid}-3-4", "succeeded", True, 1), (f"04-040000-{uuid}-7", "expired", None, 2)], "custom_id string, type string, is_primary boolean, seq int")
    keyed = classification.with_key(results).withColumn("spec_id", F.lit("s"))
    keys = ["spec_id", "section_number"]
    ok = classification.succeeded(keyed)
    after = {r["section_number"]: r for r in classification.fold_pages(sections, classification.page_lists(ok, keys), keys).collect()}
    assert (after["030000"]["primary_pages"], after["030000"]["classification_status"]) == ([3, 4], "complete")
    assert after["040000"]["primary_pages"] == [1] and after["040000"]["classification_status"] == "complete"
    t = classification.tally(keyed, ["spec_id"]).first()
    assert (t["total_sections"], t["sections_with_primary"], t["sections_with_reference"], t["errors"]) == (1, 1, 0, 1)
    assert classification.primary_runs(keyed).count() == 1


def test_retries_ask_only_for_what_failed(spark):
    requests = spark.createDataFrame([(str(i),) for i in range(6)], "custom_id string")
    seen = []

    def ask(df):
        ids = sorted(int(r["custom_id"]) for r in df.collect())
        seen.append(ids)
        return df.withColumn("type", F.when(F.col("custom_id").cast("int") < 2 + 2 * len(seen), "succeeded").otherwise("errored"))

    out = classification.with_retries(requests, ask)
    assert out.count() == 6 and classification.failed(out).count() == 0
    assert seen == [[0, 1, 2, 3, 4, 5], [4, 5]]


def test_summaries_merge_in_order(spark):
    rows = spark.createDataFrame([("x", 2, "second", ["c"], 5, 5), ("x", 1, "first", ["a", "b"], 1, 2), ("y", 1, None, None, 9, 9)], "section_number string, seq int, overview string, materials array<string>, start int, end int")
    found = {r["section_number"]: r for r in summaries.merge_summaries(rows, ["section_number"]).collect()}
    assert (found["x"]["overview"], found["x"]["materials"], found["x"]["pages_summarized"]) == ("first", ["a", "b", "c"], [1, 2, 5])
    assert found["y"]["overview"] is None and found["y"]["materials"] == []


def test_rollup(spark):
    rows = [("p", "03", "complete"), ("p", "03", "pending"), ("p", "03", "excluded"), ("p", "04", "excluded")]
    found = {(r["division"], r["is_project"]): (r["total"], r["complete"], r["excluded"], r["score"]) for r in lifecycle.lifecycle_rollup(spark.createDataFrame(rows, "spec_id string, division string, lifecycle_status string")).collect()}
    assert found == {("03", False): (2, 1, 1, 0.5), ("04", False): (0, 0, 1, 0.0), (None, True): (2, 1, 2, 0.5)}


@pytest.mark.parametrize(("counts", "score", "fine"), [((1, 2, 1, 0, 0), 0.88, True), ((1, 2, 1, 1, 0), 0.78, False), ((0, 0, 0, 0, 6), 0.0, False), ((3, 0, 0, 0, 0), 0.85, True)])
def test_deductions(spark, counts, score, fine):
    names = ("missing_required", "clarification_needed", "minor", "major", "critical")
    r = compliance.score_by_deductions(spark.createDataFrame([counts], ", ".join(f"{n} int" for n in names))).first()
    assert (r["compliance_score"], r["is_compliant"]) == (score, fine)


def test_findings_from_records(spark):
    text = '{"requirement_findings": [{"status": "clarification_needed"}, {"status": "not_applicable"}, {"status": "compliant"}], "non_conformances": [{"severity": "minor"}, {"severity": "informational"}, {}], "missing_items": [{"required": false}, {"description": "x"}]}'
    rows = decode(spark.createDataFrame([(1, text), (2, "not json")], "id int, compliance_result string"), "compliance_result", COMPLIANCE)
    both = {r["id"]: r for r in compliance.score_by_deductions(compliance.count_findings(rows)).collect()}
    assert both[1]["compliance_score"] == 0.87 and both[1]["requirements"] == 2 and both[1]["missing_optional"] == 1
    assert both[2]["raw"] == "not json" and both[2]["compliance_result"] is None


def test_packages_after_runs(spark):
    packs = spark.createDataFrame([(1, None, 0.5, [1], 3)], "id bigint, compliance_result string, compliance_score double, checked_submittal_ids array<bigint>, run_count int")
    ran = spark.createDataFrame([(1, [2], "{}", 0.9)], "package_id bigint, checked array<bigint>, compliance_result string, compliance_score double")
    for ids, score in (((1, 2), 0.9), ((1, 2, 3), 0.5)):
        subs = spark.createDataFrame([(1, i) for i in ids], "package_id bigint, id bigint")
        r = packages.apply_runs(packs, subs, ran).first()
        assert (r["checked_submittal_ids"], r["run_count"], r["compliance_score"]) == ([1, 2], 4, score)


def test_runs_are_found_and_recorded(spark):
    rows = [(1, 7, [4], "individual", 1, 0.1, "2024-01-01"), (2, 7, [4, 5], "cumulative", 1, 0.2, "2024-01-02"), (3, 7, [5], "individual", 2, 0.3, "2024-01-02")]
    old = spark.createDataFrame(rows, "id bigint, package_id bigint, submittal_ids array<bigint>, run_type string, prompt_version int, compliance_score double, created_at string")
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(packages.find_runs(old, 7, submittal_id=4)) == [1] and ids(packages.find_runs(old, 7, run_type="individual")) == [3, 1] and ids(packages.find_runs(old, 7)) == [3, 2, 1]
    new = spark.createDataFrame([(7, "individual", [6], 0.9), (8, "cumulative", [1], 0.8)], "package_id bigint, run_type string, submittal_ids array<bigint>, compliance_score double")
    after = {r["id"]: (r["package_id"], r["prompt_version"], r["compliance_score"]) for r in packages.record_runs(old, new, ["package_id", "run_type"]).collect()}
    assert after == {1: (7, 1, 0.1), 2: (7, 1, 0.2), 3: (7, 3, 0.9), 4: (8, 1, 0.8)}


def test_lifecycle_changes_and_deletes(spark):
    sections = spark.createDataFrame([(1, "pending", [], False), (2, "complete", [8, 9], False)], "id bigint, lifecycle_status string, chosen_packages array<bigint>, lifecycle_status_override boolean")
    changes = spark.createDataFrame([(1, None, [5], None)], "id bigint, lifecycle_status string, chosen_packages array<bigint>, override boolean")
    assert lifecycle.apply_lifecycle(sections, changes).where("id = 1").first()["lifecycle_status"] == "complete"
    packs = spark.createDataFrame([(8, 2, True), (9, 2, True), (5, 1, False)], "id bigint, section_id bigint, is_chosen boolean")
    pairs = spark.createDataFrame([(8, 5), (5, 9), (5, 6)], "package_id_a bigint, package_id_b bigint")
    left, compared, after = lifecycle.delete_packages(packs, pairs, sections, spark.createDataFrame([(8,)], "id bigint"))
    assert left.count() == 2 and compared.count() == 2
    r = after.where("id = 2").first()
    assert (r["chosen_packages"], r["lifecycle_status"], r["lifecycle_status_override"]) == ([9], "complete", True)


def test_snapshots_and_cascade(spark, tmp_path):
    store = snapshots.Snapshots(spark, f"file://{tmp_path}")
    store.write("projects", spark.createDataFrame([("a", "one", 1), ("b", "two", 2)], "spec_id string, project_name string, errors int"))
    store.upsert("projects", spark.createDataFrame([("b", None, 5), ("c", "three", None)], "spec_id string, project_name string, errors int"))
    assert {tuple(r) for r in store.read("projects").collect()} == {("a", "one", 1), ("b", "two", 5), ("c", "three", None)}
    assert store.version("projects") == 2 and store.version("nothing") == 0
    tables = {"projects": store.read("projects"), "sections": spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, spec_id string"), "amendments": spark.createDataFrame([(1, 1), (2, 2)], "id bigint, section_id bigint")}
    after = snapshots.cascade(tables, "projects", spark.createDataFrame([("a",)], "spec_id string"))
    assert [after[t].count() for t in ("projects", "sections", "amendments")] == [2, 1, 1]


def test_scorers_fail_their_own_requests(spark):
    requests = scoring.run_requests(spark.createDataFrame([("u", "03", "030000", 1, 2), ("u", "03", "031000.1", 5, 5)], "spec_id string, division string, section_number string, start int, end int"), "about {section_number}: {pages_analyzed}")
    rows = {r["section_number"]: r for r in scoring.ask(requests, lambda: scoring.FixedScorer(lambda p: {"is_primary": "030000" in p}), size=1).collect()}
    assert rows["030000"]["response"] == '{"is_primary": true}' and rows["030000"]["prompt"] == "about 030000: [1,2]"
    assert rows["031000.1"]["custom_id"] == "03-031000_1-u-5" and rows["030000"]["page_keys"][0] == "u/original_pages/page_0001.pdf"

    class Broken:
        def answer(self, prompts):
            if any("031000" in p for p in prompts):
                raise RuntimeError("no answer")
            return ["{}"] * len(prompts)

    kinds = {r["section_number"]: (r["type"], r["error"]) for r in scoring.ask(requests, Broken, size=1).collect()}
    assert kinds == {"030000": ("succeeded", None), "031000.1": ("errored", "no answer")}
    closed = scoring.closed_schema({"type": "object", "properties": {"a": {"type": "array", "items": {"type": "object"}}}, "anyOf": [{"type": "object", "additionalProperties": True}]})
    assert closed["additionalProperties"] is False and closed["properties"]["a"]["items"]["additionalProperties"] is False and closed["anyOf"][0]["additionalProperties"] is True


def test_batches_keep_their_limits(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([10, 40, 90, 120, 400])) for i in range(3000)]
    dealt = scoring.batches(spark.createDataFrame(rows, "seq bigint, size_bytes bigint"), most_requests=20, most_bytes=300)
    found = scoring.batch_metrics(dealt).collect()
    assert sum(r["request_count"] for r in found) == 3000
    assert all(r["request_count"] <= 20 and (r["size_bytes"] <= 300 or r["request_count"] == 1) for r in found)


def test_views_and_labels(spark):
    rows = spark.createDataFrame([("10", "B"), ("9", "a"), ("x", "c")], "division string, n string")
    assert [r["division"] for r in views.natural_order(rows).collect()] == ["9", "10", "x"]
    assert views.project_board(spark.createDataFrame([], "classification_status string, summary_status string, errors int")).first()["all_complete"] is True
    assert one(spark, T.without_placeholders(F.array(F.lit("None noted"), F.lit("real")))) == ["real"]
    assert one(spark, T.first_names(F.array(*map(F.lit, "abcde")))) == "a, b, c +2 more"
    assert one(spark, T.string_array(F.lit("oops"))) == [] and one(spark, T.string_array(F.lit('["a"]'))) == ["a"]
    assert one(spark, summaries.pages_to_read(F.array().cast("array<int>"), F.array(F.lit(4)))) == [4]
    assert one(spark, T.short_id(F.lit("11111111-2222-3333-4444-555555555555"))) == "11111111…5555"
    assert one(spark, T.base64_block(F.lit(b"ab")))["source"]["data"] == "YWI="
    nested = views.by_division(spark.createDataFrame([("s", "03", "031", 1), ("s", "03", "030", 2)], "spec_id string, division string, section_number string, n int"), ["section_number", "n"]).first()
    assert [s["section_number"] for s in nested["sections"]] == ["030", "031"]


def test_schemas_and_domains(spark):
    assert set(KEYS) == set(TABLES) and all(schema(t).fields for t in TABLES)
    df = spark.createDataFrame([("pending",), ("odd",), (None,)], "s string")
    fine, bad = split_by_domain(df, "s", ("pending",))
    assert (fine.count(), bad.count(), missing_columns(df, ["s", "t"])) == (1, 2, ["t"])


def test_alnum_counts_letters_and_digits(spark):
    text = "Äb1 ²_\n-九"
    assert one(spark, T.alnum_count(F.lit(text))) == sum(c.isalnum() for c in re.sub(r"[ \n]", "", text))


def test_small_helpers(spark):
    assert one(spark, T.unquoted(F.lit("03%2030"))) == "03 30" and one(spark, T.unquoted(F.lit("100%"))) == "100%"
    assert one(spark, T.is_pdf(F.lit("A.PDF"), F.lit("application/pdf"))) and not one(spark, T.is_pdf(F.lit("a.pdf"), F.lit(None).cast("string")))
    r = snapshots.stamped(spark.range(1), new=True, now="2024-05-06 07:08:09.9").select(F.col("created_at").cast("string"), F.col("updated_at").cast("string")).first()
    assert tuple(r) == ("2024-05-06 07:08:09",) * 2
    assert one(spark, T.elapsed_label(F.lit(-1))) == "—" and one(spark, T.duration_label(F.lit(90.0))) == "1.50 minutes"
    packs = spark.createDataFrame([(1, 7, 0.9), (2, 7, 0.5), (3, 7, 0.52), (4, 8, 0.1)], "id bigint, section_id bigint, compliance_score double")
    wanted = spark.createDataFrame([(1, 3), (3, 3), (2, 9)], "id_a bigint, id_b bigint")
    assert [(r["id_a"], r["id_b"], r["overall_winner"]) for r in compliance.compare_by_score(compliance.pairs_of(packs, wanted)).collect()] == [(1, 3, "A")]
    assert {(r["id_a"], r["id_b"]) for r in compliance.next_pairs(packs).collect()} == {(1, 2), (2, 3)}
    assert {(r["section_id"], r["n_sections"]) for r in views.section_totals(packs, ["section_id"]).collect()} == {(7, 3), (8, 1)}


def test_extraction_requests_and_records(spark):
    found = spark.createDataFrame([("s", "030000", 1, 2), ("s", "030000", 4, 4)], "spec_id string, section_number string, start int, end int")
    pages = spark.createDataFrame([("s", 4, "four"), ("s", 1, "one "), ("s", 2, " "), ("s", 3, "three")], "spec_id string, page_index int, text string")
    asked = scoring.section_requests(found, pages, "{section_number}\n{pages}")
    assert asked.first()["prompt"] == "030000\n===== PAGE 1 START =====\none\n===== PAGE 1 END =====\n===== PAGE 4 START =====\nfour\n===== PAGE 4 END =====\n"
    said = scoring.ask(asked, lambda: scoring.FixedScorer({"section_number": "030000", "products": [{"product_name": "x", "properties": [{"name": "n", "value": "1"}]}]}))
    r = scoring.extractions(said).first()
    assert r["raw"] is None and r["response"]["products"][0]["properties"][0]["value"] == "1"


def test_two_writers_conflict_and_commits_are_whole(spark, tmp_path):
    one, two = (snapshots.Snapshots(spark, f"file://{tmp_path}/s") for _ in range(2))
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "id bigint")
    one.commit({"a": rows(1), "b": rows(2)})
    seen = two.version("a")
    one.write("a", rows(3), one.version("a"))
    with pytest.raises(snapshots.Conflict):
        two.write("a", rows(4), seen)
    two.write("b", rows(5), two.version("b"))  # the table that it read still stands
    assert [r["id"] for r in two.read("a").collect()] == [3] and (one.version("a"), one.version("b"), one.version("c")) == (2, 2, 0)
    assert not one._put(one._state()[0], {}) and one._put(one._state()[0] + 1, one._state()[1])
    with pytest.raises(snapshots.Conflict):
        one.commit({"a": rows(6), "c": rows(7)}, {"c": 4})
    one.commit({}, added={"a": rows(8)})
    assert sorted(r["id"] for r in one.read("a").collect()) == [3, 8] and one.version("c") == 0


def test_equal_attempts_have_one_winner(spark):
    rows = [("r", 1, x) for x in "abcdef"]
    found = {classification.latest_attempt(spark.createDataFrame(part, "custom_id string, attempt int, x string").repartition(n), ["custom_id"]).first()["x"] for n, part in ((1, rows), (3, rows[::-1]), (5, rows))}
    assert len(found) == 1


def test_added_rows_are_gathered_now_and_then(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots.Snapshots, "MOST_FOLDERS", 3)
    store = snapshots.Snapshots(spark, f"file://{tmp_path}/s", {"p": ["kind"]})
    for i in range(5):
        rows = spark.createDataFrame([(i, f"k{i % 2}")], "id int, kind string")
        store.commit({}, added={"a": rows, "p": rows})
    for table in ("a", "p"):
        assert sorted(r["id"] for r in store.read(table).collect()) == [0, 1, 2, 3, 4] and store.version(table) == 5
        assert len(store._state()[1][table]["folders"]) == 2
