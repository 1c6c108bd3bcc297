"""Tables in buckets by key: what a merge touches, conflicts, look-ups, compaction, vacuum, roll-ups by differences."""

import random

import pytest
from pyspark.sql import functions as F

from specloom.api import Engine
from specloom.operators import keyed, lifecycle
from specloom.operators.keyed import KeyedTables, Layout
from specloom.operators.snapshots import Conflict, Snapshots
from specloom.schemas import BATCH_RESULT
from specloom.streaming import results


@pytest.fixture
def tables(spark, tmp_path):
    made = KeyedTables(Snapshots(spark, f"file://{tmp_path}"), {"t": Layout(("id",), 8)})
    made.create("t", spark.range(2000).select("id", (F.col("id") * 2).alias("x")))
    return made


def files(tables):
    return {r["file"] for r in tables.manifest("t").collect()}


def bucket_of(spark, ids, buckets=8):
    rows = spark.createDataFrame([(i,) for i in ids], "id bigint").select("id", Layout(("id",), buckets).bucket().alias("b")).collect()
    return {r["id"]: r["b"] for r in rows}


def test_merge_rewrites_only_files_that_hold_a_changed_key(spark, tables):
    before = files(tables)
    assert len(before) == 8
    staged = tables.merge("t", spark.createDataFrame([(17, -1)], "id bigint, x bigint"))
    after = files(tables)
    assert len(staged.removed) == 1 and len(before & after) == 7 and len(after) == 8
    assert set(staged.old.inputFiles()) == set(staged.removed)
    assert sorted(map(tuple, tables.read("t").collect())) == [(i, -1 if i == 17 else 2 * i) for i in range(2000)]


def test_new_keys_beyond_the_range_rewrite_nothing(spark, tables):
    before = files(tables)
    staged = tables.merge("t", spark.range(10_000, 10_020).withColumn("x", F.lit(0).cast("bigint")))
    assert not staged.removed and before < files(tables)
    assert tables.read("t").count() == 2020
    inside = KeyedTables(tables.store, {"u": Layout(("id",), 2)})  # within the range, the filters tell
    inside.create("u", spark.range(0, 20_000, 2).withColumn("x", F.lit(1)))
    assert len(inside.files_of("u", spark.createDataFrame([(4,)], "id bigint"))) == 1
    odd = [inside.files_of("u", spark.createDataFrame([(i,)], "id bigint")) for i in (1, 5001, 9999, 777)]
    assert sum(map(len, odd)) <= 1


def test_lookup_opens_only_files_that_may_hold_the_keys(spark, tables):
    found = tables.lookup("t", spark.createDataFrame([(5,), (5,), (99_999,)], "id bigint"))
    assert [tuple(r) for r in found.collect()] == [(5, 10)]
    assert len(found.inputFiles()) == 1
    assert tables.lookup("t", spark.createDataFrame([], "id bigint")).collect() == []


def test_writers_conflict_only_within_a_bucket(spark, tables):
    by = bucket_of(spark, range(200))
    a, b = 0, next(i for i in by if by[i] != by[0])
    same = next(i for i in by if i and by[i] == by[0])
    row = lambda i: spark.createDataFrame([(i, -5)], "id bigint, x bigint")
    first, second, third = (tables.stage("t", row(i)) for i in (a, b, same))
    tables.commit(first)
    tables.commit(second)
    with pytest.raises(Conflict):
        tables.commit(third)
    assert {r["id"] for r in tables.read("t").where("x = -5").collect()} == {a, b}
    assert tables.store.version("t") == 3


def test_buckets_of_many_files_are_written_as_one(spark, tables, monkeypatch):
    monkeypatch.setattr(keyed, "MOST_FILES", 3)
    ids = [i for i, b in bucket_of(spark, range(100_000, 100_200)).items() if b == 3][:4]
    for i in ids:
        tables.merge("t", spark.createDataFrame([(i, 0)], "id bigint, x bigint"))
    assert tables.manifest("t").where("bucket = 3").count() <= 3
    assert tables.read("t").count() == 2004


def test_delete_update_and_vacuum(spark, tables):
    tables.delete("t", spark.range(0, 2000, 3))
    tables.update("t", spark.createDataFrame([(1, 7), (3, 7), (5000, 7)], "id bigint, x bigint"))  # 3 is gone, 5000 never was
    want = sorted((i, 7 if i == 1 else 2 * i) for i in range(2000) if i % 3)
    assert sorted(map(tuple, tables.read("t").collect())) == want
    assert tables.vacuum(keep=1, older_than=3600) == 2  # entries only: the files are too young
    assert tables.vacuum(keep=1, older_than=-1) > 0
    assert tables.vacuum(keep=1, older_than=-1) == 0
    assert sorted(map(tuple, tables.read("t").collect())) == want
    tables.delete("t", spark.range(2000))
    assert tables.read("t").count() == 0


def test_vacuum_of_whole_tables(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}")
    for n in (3, 4, 5):
        store.write("a", spark.range(n))
    store.commit({}, added={"a": spark.range(2)})
    store.vacuum(keep=1, older_than=-1)
    assert store.read("a").count() == 7
    assert len([p for p in (tmp_path / "a").iterdir() if p.is_dir()]) == 2


def test_roll_up_by_differences_equals_recomputation(spark, tmp_path):
    rng = random.Random(4)
    layouts = {t: Layout(x.keys, 4, x.by) for t, x in lifecycle.LAYOUTS.items()}
    engine = Engine(spark, f"file://{tmp_path}", layouts)
    rows = [(i, f"p{i % 5}", f"{i % 3:02d}", rng.choice(["pending", "complete", "excluded", None]), [], False) for i in range(300)]
    kinds = "id bigint, spec_id string, division string, lifecycle_status string, chosen_packages array<bigint>, lifecycle_status_override boolean"
    engine.keyed.create("sections", spark.createDataFrame(rows, kinds))
    engine.keyed.create("divisions", spark.createDataFrame([(f"p{p}", f"{d:02d}", None) for p in range(5) for d in range(3)], "spec_id string, division string, division_completion_score double"))
    engine.keyed.create("projects", spark.createDataFrame([(f"p{p}", None) for p in range(5)], "spec_id string, project_completion_score double"))
    for _ in range(3):
        some = rng.sample(range(300), 4)
        engine.set_lifecycle(spark.createDataFrame([(i, rng.choice(["pending", "complete", "excluded"])) for i in some], "id bigint, lifecycle_status string"))
        sections = engine.table("sections")
        want = {tuple(r) for r in lifecycle.division_completion(sections).collect()}
        counts = engine.table("section_counts")
        assert {tuple(r) for r in lifecycle.completion_of_counts(counts, ["spec_id", "division"]).collect()} == want
        touched = {r[0] for r in sections.where(F.col("id").isin(some)).select("spec_id").collect()}
        scores = {(r["spec_id"], r["division"]): r["score"] for r in lifecycle.division_completion(sections).where("total > 0").collect()}
        for r in engine.table("divisions").collect():
            if r["spec_id"] in touched and (r["spec_id"], r["division"]) in scores:
                assert r["division_completion_score"] == scores[r["spec_id"], r["division"]]
    moved = lifecycle.change_sections(engine.keyed, spark.createDataFrame([(0, "complete")], "id bigint, lifecycle_status string"))
    assert moved.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] == 0  # sections move between statuses, none appears
    assert len(engine.keyed.stage("sections", spark.createDataFrame([(0, "pending")], "id bigint, lifecycle_status string")).removed) == 1
    with pytest.raises(ValueError, match="lifecycle_status"):
        engine.set_lifecycle(spark.createDataFrame([(0, "odd")], "id bigint, lifecycle_status string"))


def test_batches_of_results_touch_their_sections_only(spark, tmp_path):
    layouts = {t: Layout(x.keys, 8) for t, x in results.LAYOUTS.items()}
    tables = KeyedTables(Snapshots(spark, f"file://{tmp_path}"), layouts)
    kinds = "spec_id string, section_number string, primary_pages array<int>, reference_pages array<int>, total_pages int, classification_status string"
    tables.create("sections", spark.createDataFrame([("s", f"{i:06d}", None, [], 3, "pending") for i in range(64)], kinds))
    tables.create("applied", spark.createDataFrame([], "custom_id string, batch bigint"))

    def batch(*rows):
        made = [(c, "succeeded", None, 0, n, ("t", primary, 1.0, "", [], []), "s", section, start, end) for n, (c, section, primary, start, end) in enumerate(rows)]
        return spark.createDataFrame(made, f"{BATCH_RESULT}, spec_id string, section_number string, start int, end int")

    def section(number):
        r = tables.lookup("sections", spark.createDataFrame([("s", number)], "spec_id string, section_number string")).first()
        return r["primary_pages"], r["reference_pages"], r["classification_status"]

    before = {r["file"] for r in tables.manifest("sections").collect()}
    first = batch(("a", "000003", True, 1, 2), ("b", "000003", False, 7, 7), ("x", "999999", True, 1, 1))
    assert results.apply_keyed(first, 0, tables).count() == 3
    assert section("000003") == ([1, 2], [7], "complete")
    assert len(before - {r["file"] for r in tables.manifest("sections").collect()}) == 1
    assert results.apply_keyed(first, 0, tables) is None  # a replay
    assert results.apply_keyed(batch(("b", "000003", False, 7, 7), ("c", "000004", True, 5, 5)), 1, tables).count() == 1
    assert section("000003") == ([1, 2], [7], "complete") and section("000004") == ([5], [], "pending")
    assert sorted(map(tuple, tables.read("applied").collect())) == [("a", 0), ("b", 0), ("c", 1), ("x", 0)]


def test_large_buckets_are_written_as_several_files(spark, tables, monkeypatch):
    monkeypatch.setattr(keyed, "FILE_ROWS", 100)
    tables.create("t", spark.range(2000).select("id", (F.col("id") * 2).alias("x")))
    sizes = [r["rows"] for r in tables.manifest("t").collect()]
    assert sum(sizes) == 2000 and len(sizes) > 16 and max(sizes) < 200
    tables.merge("t", spark.createDataFrame([(17, -1)], "id bigint, x bigint"))
    assert sorted(map(tuple, tables.read("t").collect())) == [(i, -1 if i == 17 else 2 * i) for i in range(2000)]
