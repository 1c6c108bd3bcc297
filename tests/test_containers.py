"""Pages in containers: round trip, which containers and pages a query reads, lists that show whole writes."""

import pytest
from pyspark.sql import functions as F

from specloom.sources import containers
from specloom.sources.containers import ContainerReader, ContainerWriter


def pages(spark, n=400, projects=4):
    rows = spark.range(n).select(F.concat(F.lit("p"), F.col("id") % projects).alias("spec_id"), (F.col("id") / projects).cast("int").alias("page_index"), F.col("id"))
    text = F.when(F.col("id") % 5 != 0, F.concat(F.lit("page "), "id"))
    return rows.select("spec_id", "page_index", text.alias("text"), F.when(F.col("id") % 3 == 0, F.encode(F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")), "UTF-8")).alias("image"))


def plain(df):
    return sorted((r["spec_id"], r["page_index"], r["text"] and bytes(r["text"]), None if r["image"] is None else bytes(r["image"])) for r in df.collect())


def test_round_trip_and_pruning(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    want = pages(spark)
    containers.write_pages(want, root, 8)
    stored = containers.read_pages(spark, root)
    assert plain(stored) == plain(want.withColumn("text", F.col("text").cast("binary")))
    assert len(list((tmp_path / "c").glob("*.pages"))) == 8 and stored.rdd.getNumPartitions() == 8
    some = containers.read_pages(spark, root, ["p2"], 10, 20)
    assert some.count() == 10 and 1 <= some.rdd.getNumPartitions() <= 2
    assert [tuple(r) for r in containers.read_pages(spark, root, ["p0", "p9"], 3, 4).select("spec_id", "page_index").collect()] == [("p0", 3)]
    nothing = containers.read_pages(spark, root, ["other"])
    assert nothing.count() == 0 and nothing.rdd.getNumPartitions() == 1
    assert some.where("page_index = 12").count() == 1 and some.count() == 10
    assert stored.where("length(text) > 6 or page_index = 1").count() == want.where("length(text) > 6 or page_index = 1").count()


def test_conditions_choose_containers_and_pages(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    containers.write_pages(pages(spark), root, 8)
    reader = ContainerReader(root, ["p1"], 95, 98)
    parts = reader.partitions()
    assert len(parts) <= 2
    assert sorted(i for part in parts for batch in reader.read(part) for i in batch.column(1).to_pylist()) == [95, 96, 97]


def test_writes_append_overwrite_and_abort(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    containers.write_pages(pages(spark, 40), root, 2)
    containers.write_pages(pages(spark, 10, 1).withColumn("spec_id", F.lit("more")), root, 1)
    assert containers.read_pages(spark, root).count() == 50
    containers.write_pages(pages(spark, 7, 1), root, 3, mode="overwrite")
    assert containers.read_pages(spark, root).count() == 7
    containers.write_pages(pages(spark, 7, 1).limit(0), root)
    assert containers.read_pages(spark, root).count() == 7
    writer = ContainerWriter(root, False)
    before = set((tmp_path / "c").glob("*.pages"))
    message = writer.write(iter([containers._batch([("a", 1, b"x", None)])]))
    writer.abort([message, None])
    assert set((tmp_path / "c").glob("*.pages")) == before and containers.read_pages(spark, root).count() == 7
    (tmp_path / "c" / message.file).write_bytes(b"no container at all")
    with pytest.raises(ValueError, match="no container"):
        list(ContainerReader(root).read(containers.Container(message.file)))
