"""Substring search by an index of character runs against plain containment, and observed writes."""

from specloom.operators import search
from specloom.operators.keyed import KeyedTables, Layout
from specloom.operators.snapshots import Snapshots
from specloom.sources import store


def test_search_finds_what_contains_does(spark, tmp_path):
    texts = {1: "Cast-in-Place Concrete", 2: "concrete", 3: "", 4: "033000", 5: "Türen É aÉb", 6: "aaaa", 7: "in", 8: "x" * 300 + "needle" + "y" * 300}
    tables = KeyedTables(Snapshots(spark, f"file://{tmp_path}"), search.layouts("s", "id", 16))
    index = search.TextIndex(tables, "s", "id")
    index.build(spark.createDataFrame([*texts.items(), (9, None)], "id bigint, title string"), "title")
    asked = ["CONCRETE", "in", "n", "É", "aé", "aaa", "aaaaa", "0330", "33", "needley", "crete conc", "", "zq", "t-in-p"]

    def check():
        want = {(q, i) for q in asked for i, t in texts.items() if q.lower() in t.lower()}
        got = [tuple(r) for r in index.search(spark.createDataFrame([(q,) for q in [*asked, "in", None]], "q string")).collect()]
        assert sorted(got) == sorted(want)

    check()
    texts |= {2: "Steel", 10: "Concrete forming"}
    del texts[6]
    index.put(spark.createDataFrame([(2, "Steel"), (10, "Concrete forming"), (6, None)], "id bigint, title string"), "title")
    check()
    assert tables.read("s_counts").where("n < 1").count() == 0
    assert tables.read("s_postings").groupBy("gram").count().exceptAll(tables.read("s_counts")).count() == 0


def test_search_opens_files_of_its_runs_only(spark, tmp_path):
    tables = KeyedTables(Snapshots(spark, f"file://{tmp_path}"), {"t": Layout(("gram", "id"), 32, ("gram",))})
    tables.create("t", spark.range(2000).selectExpr("concat('g', id % 200) as gram", "id"))
    found = tables.lookup("t", spark.createDataFrame([("g7",)], "gram string"))
    assert found.count() == 10 and len(found.inputFiles()) == 1


def test_a_hot_value_is_spread_over_buckets(spark, tmp_path):
    tables = KeyedTables(Snapshots(spark, f"file://{tmp_path}"), {"t": Layout(("gram", "id"), 32, ("gram",), 4)})
    tables.create("t", spark.range(4000).selectExpr("if(id % 4 = 0, concat('g', id), 'e') as gram", "id"))
    hot = tables.lookup("t", spark.createDataFrame([("e",)], "gram string"))
    assert hot.count() == 3000 and len(hot.inputFiles()) == 4
    sizes = [r["rows"] for r in tables.manifest("t").collect()]
    assert sum(sizes) == 4000 and max(sizes) < 1200
    tables.delete("t", hot.where("id < 100").select("gram", "id"))
    assert tables.lookup("t", spark.createDataFrame([("e",)], "gram string")).count() == 2925


def test_writes_are_counted_while_they_are_made(spark, tmp_path):
    (tmp_path / "o" / "b").mkdir(parents=True)
    rows = spark.createDataFrame([("a/1", b"x"), ("a/2", None), ("b", b"y")], "key string, content binary")  # b is a folder
    assert store.write_observed(rows, f"file://{tmp_path}/o", f"file://{tmp_path}/failed") == (3, 2, 100.0 * 2 / 3, 1)
    assert [r["key"] for r in spark.read.parquet(f"file://{tmp_path}/failed").collect()] == ["b"]
    assert store.write_observed(rows.limit(0), f"file://{tmp_path}/p", f"file://{tmp_path}/none") == (0, 0, 0.0, 0)
