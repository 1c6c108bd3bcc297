"""Stores, page functions and the result stream."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from specloom.api import Engine
from specloom.operators.snapshots import Snapshots
from specloom.sources import pdf, store
from specloom.streaming import results

UUID = "11111111-2222-3333-4444-555555555555"


def test_object_store_round_trip(spark, tmp_path):
    root = f"file://{tmp_path}"
    files = spark.createDataFrame([("s", [b"%d" % i for i in range(1, 12)])], "spec_id string, contents array<binary>")
    done = store.write_objects(store.numbered_parts(files), root).collect()
    assert len(done) == 11 and all(r["error"] is None for r in done)
    parts = store.original_parts(spark, root).orderBy("spec_id", "part").collect()
    assert [int(r["content"]) for r in parts] == list(range(1, 12))
    assert store.has_original(spark, root, "s") and not store.has_original(spark, root, "t")
    pages = spark.createDataFrame([("s", 0, "text", None), ("s", 1, None, b"img"), ("s", 2, "t2", b"i2")], "spec_id string, page_index int, text string, image binary")
    m = store.upload_metrics(store.write_objects(store.converted_objects(pages), root)).first()
    assert (m["attempts"], m["successes"], m["success_rate"]) == (4, 4, 100.0)
    back = {r["page_index"]: (r["text"], r["image"] and bytes(r["image"])) for r in store.converted_pages(spark, root, 0, 2).collect()}
    assert back == {0: ("text", None), 1: (None, b"img")}
    wanted = spark.createDataFrame([("s", 9)], "spec_id string, page_index int")
    assert store.pages_with_content(wanted, store.converted_pages(spark, root)).first()["text"] is None
    store.write_objects(spark.createDataFrame([("s/original_pages/page_0000.pdf", b"x"), ("s/original_pages/page_0001.pdf", b"y")], "key string, content binary"), root).collect()
    assert store.page_counts(spark, root).first()["n_pages"] == 2
    assert store.remove_objects(spark, root, "s/converted") and not store.remove_objects(spark, root, "s/converted")


def test_lookups_push_down(spark, tmp_path):
    path = f"{tmp_path}/x.parquet"
    spark.range(100).withColumn("s", F.col("id").cast("string")).write.parquet(path)
    df = store.lookup(spark.read.parquet(path), id=[3, 4], s="4")
    assert [r["id"] for r in df.collect()] == [4] and store.lookup(df, id=[]).count() == 0
    plan = df._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "EqualTo(s,4)" in plan


class Fake:
    """Pages are lines of the file."""

    def pages(self, data):
        return len(data.split(b"\n"))

    def text(self, data, page):
        return data.split(b"\n")[page].decode()

    def has_images(self, data, page):
        return page % 2 == 1

    def read(self, picture):
        return picture.decode()


def test_pages_of_files(spark):
    files = spark.createDataFrame([("s", b"\n".join([b"word " * 20, b"few", b"more words " * 20]))], "spec_id string, content binary")
    rows = pdf.routed(pdf.page_rows(files, Fake)).orderBy("page_index").collect()
    assert [r["route"] for r in rows] == ["text", "ocr", "text"]
    assert pdf.page_rows(files, Fake, 1, 2).count() == 2
    with pytest.raises(Exception, match="not all in a file"):
        pdf.page_rows(files, Fake, 1, 3).collect()
    pictures = spark.createDataFrame([("s", 1, 200, b"few"), ("s", 1, 250, b"ab " * 16), ("s", 1, 300, b"ab " * 99)], "spec_id string, page_index int, dpi int, picture binary")
    best = pdf.read_attempts(pictures, Fake).first()
    assert (best["dpi"], best["passes"]) == (250, True)
    assert pdf.compress(b"x" * 1000, lambda p, q, s: p[: int(len(p) * q / 100 * s)], 100) == b"x" * 75
    small = pdf.select_pages(files.withColumn("pages", F.array(F.lit(1))), lambda data, pages: b"\n".join(data.split(b"\n")[i] for i in pages)).first()
    assert bytes(small["content"]) == b"few"


def line(seq, section, start, primary=True, kind="succeeded"):
    return json.dumps({"custom_id": f"03-{section}-{UUID}-{start}", "type": kind, "seq": seq, "attempt": 0, "content": {"is_primary": primary}})


def test_results_from_files_and_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join([line(1, "030000", 4), line(2, "030000", 6, False), "broken {", line(3, "031000", 1, kind="expired")]))
    batch = store.batch_results(spark, f"file://{tmp_path}/in")
    assert {r["type"]: r["count"] for r in batch.groupBy("type").count().collect()} == {"succeeded": 2, "errored": 1, "expired": 1}
    kept = Snapshots(spark, f"file://{tmp_path}/store")
    kept.write("sections", spark.createDataFrame([(UUID, "030000", None, None, 3, "pending")], "spec_id string, section_number string, primary_pages array<int>, reference_pages array<int>, total_pages int, classification_status string"))

    def drain():
        stream = results.result_stream(spark, f"file://{tmp_path}/in")
        results.apply_stream(stream, kept, f"file://{tmp_path}/checkpoint").awaitTermination()
        r = kept.read("sections").first()
        return r["primary_pages"], r["reference_pages"], r["classification_status"]

    assert drain() == ([4], [6], "pending")
    (tmp_path / "in" / "b.json").write_text("\n".join([line(1, "030000", 4), line(4, "030000", 9)]))
    assert drain() == ([4, 9], [6], "complete")
    assert drain() == ([4, 9], [6], "complete")


def test_running_page_lists(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join([line(2, "030000", 6), line(1, "030000", 4), line(1, "030000", 4)]))
    folded = results.folded_sections(results.result_stream(spark, f"file://{tmp_path}/in"))
    q = folded.writeStream.format("memory").queryName("folded").outputMode("update").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.table("folded").first()
    assert (r["primary_pages"], r["n_results"]) == ([4, 6], 2)


def test_engine_end_to_end(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}")
    pages = spark.createDataFrame([("s", 0, "03 30 00", None), ("s", 1, "033000", None)], "spec_id string, page_index int, text string, image binary")
    codes = spark.createDataFrame([("03", "033000", "Concrete")], "division string, section_number string, title string")
    found = engine.index_pages(pages, codes).first()
    assert (found["section_number"], found["start"], found["end"]) == ("033000", 0, 1)
    engine.store.write("sections", spark.createDataFrame([(1, "s", "03", "033000", [], [], 2, "pending", "pending", [], "pending", False), (2, "s", "03", "034000", [], [], 2, "pending", "pending", [], "pending", False)], "id bigint, spec_id string, division string, section_number string, primary_pages array<int>, reference_pages array<int>, total_pages int, classification_status string, summary_status string, chosen_packages array<bigint>, lifecycle_status string, lifecycle_status_override boolean"))
    engine.store.write("divisions", spark.createDataFrame([("s", "03", 0.0)], "spec_id string, division string, division_completion_score double"))
    engine.store.write("projects", spark.createDataFrame([("s", 0.0)], "spec_id string, project_completion_score double"))
    engine.set_lifecycle(spark.createDataFrame([(1, "complete")], "id bigint, lifecycle_status string"))
    assert engine.projects().first()["project_completion_score"] == 0.5
    assert {r["score"] for r in engine.lifecycle_summary("s").collect()} == {0.5}
    with pytest.raises(ValueError, match="lifecycle_status"):
        engine.set_lifecycle(spark.createDataFrame([(1, "done")], "id bigint, lifecycle_status string"))
    engine.apply_classification(spark.createDataFrame([("s", "03", "034000", 0, 1, "succeeded", True, 1)], "spec_id string, division string, section_number string, start int, end int, type string, is_primary boolean, seq int"))
    assert [r["section_number"] for r in engine.sections_with_primary_pages("s").collect()] == ["034000"]
    engine.delete_project("s", cascade=True)
    assert engine.projects().count() == 0 and engine.sections("s").count() == 0


def test_a_crash_between_batches_applies_nothing_twice(spark, tmp_path, monkeypatch):
    kept = Snapshots(spark, f"file://{tmp_path}/store")
    kept.write("sections", spark.createDataFrame([(UUID, "030000", None, None, 9, "pending")], "spec_id string, section_number string, primary_pages array<int>, reference_pages array<int>, total_pages int, classification_status string"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join([line(1, "030000", 4), line(2, "030000", 6)]))
    batch = spark.read.schema(results.BATCH_RESULT).json(f"file://{tmp_path}/in")
    put = Snapshots._put
    monkeypatch.setattr(Snapshots, "_put", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError, match="crash"):
        results.apply_batch(batch, 7, kept)
    monkeypatch.setattr(Snapshots, "_put", put)
    assert kept.version("applied") == 0 and kept.read("sections").first()["primary_pages"] is None
    results.apply_batch(batch, 7, kept).unpersist()
    assert results.apply_batch(batch, 7, kept) is None
    assert kept.read("sections").first()["primary_pages"] == [4, 6] and kept.read("applied").count() == 2
    later = results.apply_batch(batch, 8, kept)
    assert later.count() == 0 and kept.read("sections").first()["primary_pages"] == [4, 6]


def test_failed_uploads_are_a_table(spark):
    written = spark.createDataFrame([("a", 1, None), ("b", None, "no"), ("c", None, "no")], "key string, bytes bigint, error string")
    m = store.upload_metrics(written).first()
    assert (m["attempts"], m["successes"]) == (3, 1) and {r["key"] for r in store.failed_uploads(written).collect()} == {"b", "c"}


def test_the_entry_works_without_the_subpackage(tmp_path):
    code = (
        "import sys\n"
        "class Block:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'public_tokenizers':\n"
        "            raise ImportError(name)\n"
        "sys.meta_path.insert(0, Block())\n"
        "import __spark_entry__ as e\n"
        "assert 'op1_exact_dedup' not in e.queries() and len(e.queries()) > 60 and set(e.queries()) == set(e.oracle_sql())\n"
    )
    root = Path(__file__).resolve().parents[1]
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_objects_are_listed_and_read_by_tasks(spark, tmp_path):
    kept = {"a/original/1": b"x", "a/b/c/d.txt": b"", "top.txt": b"yy", "b/page_1.txt": b"z" * 9}
    for name, content in {**kept, "a/.hidden": b"h", "_gone/x.txt": b"g"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    root = f"file://{tmp_path}"
    read = lambda **how: {r["path"].removeprefix(root + "/"): r for r in store.objects(spark, root, **how).collect()}
    assert {k: (r["content"], r["length"]) for k, r in read().items()} == {k: (v, len(v)) for k, v in kept.items()}
    assert set(read(pattern="*.txt", content=False)) == {"a/b/c/d.txt", "top.txt", "b/page_1.txt"}
    assert set(read(content=False, like=store.ORIGINAL)) == {"a/original/1"}
    plan = store.objects(spark, root, content=False)._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan  # whose index holds every object on the driver
    (tmp_path / "none").mkdir()
    assert store.objects(spark, f"{root}/none").collect() == []
