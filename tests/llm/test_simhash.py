"""op10 against brute force over all pairs, and the parts it is made of."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from specloom.llm import components, queries, simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(3, len(words))
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: find(i) for i in fps}


def check(rows, texts):
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    least = plain_components(fps)
    assert len(rows) == len(texts)
    for r in rows:
        assert r["fingerprint"] == f"{fps[r['doc_id']]:016x}"
        assert r["component_id"] == least[r["doc_id"]]


def test_query_against_all_pairs(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    check(queries.op10_simhash(spark, small).collect(), texts)


def test_edge_cases_and_chains(spark):
    base = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n", "one", "One", "one two", "ONE\ttwo", " ".join(base), " ".join(base), *(" ".join([*base[: 400 - k], "zz", *base[401 - k :]]) for k in range(1, 30))]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, fp int, row int")
    check(simhash.near_duplicates(docs).collect(), dict(enumerate(texts)))
    kept = {r["doc_id"] for r in simhash.near_dedup(docs).collect()}
    assert kept == {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert simhash.near_dedup(docs).columns == docs.columns
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, "x y z"), (7, "x y z"), (7, "x y z")], "doc_id bigint, text string")
    assert {r["component_id"] for r in simhash.near_duplicates(twice).collect()} == {7}
    assert [r["doc_id"] for r in simhash.near_dedup(twice).collect()] == [7]


@pytest.mark.parametrize("segments", [8, 16])
def test_links_lose_none_and_add_none(spark, segments):
    rng = random.Random(segments)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        fps |= {f ^ 1 << rng.randrange(64), f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64), f ^ 7 << rng.randrange(60)}
    signed = [(f + 2**63) % 2**64 - 2**63 for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    found = simhash.links(nodes, segments=segments).collect()
    pairs = {frozenset((r["u"], r["v"])) for r in found}
    assert len(pairs) == len(found)
    assert pairs == {frozenset(p) for p in combinations(signed, 2) if ((p[0] ^ p[1]) % 2**64).bit_count() <= 2}


def test_long_runs_are_counted_in_parts(monkeypatch):
    text = " ".join(f"t{i % 97}" for i in range(5000))
    whole = simhash._fingerprints([text, None, "a b c d"], 3)
    monkeypatch.setattr(simhash, "RUN", 100)
    assert (simhash._fingerprints([text, None, "a b c d"], 3) == whole).all()
    assert int(whole[0]) == plain_fingerprint(text)


def test_components_of_a_path_a_star_and_a_ring(spark):
    path = [(i, i + 1) for i in range(0, 200)]
    star = [(1000, 1001 + i) for i in range(100)]
    ring = [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)]
    edges = path + star + ring + [(5, 5)]
    random.Random(1).shuffle(edges)
    found = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert found == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(101)}, **{2000 + i: 2000 for i in range(50)}}
    assert components.connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_popcounts_bound_the_distance_from_below():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (int(x) for x in rng.integers(0, 2**63, 2))
        manhattan = sum(abs((a >> 8 * i & 255).bit_count() - (b >> 8 * i & 255).bit_count()) for i in range(8))
        assert manhattan <= (a ^ b).bit_count()


def test_a_star_of_a_hundred_thousand_leaves(spark):
    edges = spark.range(1, 100_001).selectExpr("id as u", "0L as v").unionByName(spark.range(5).selectExpr("200000 + id as u", "200001 + id as v"))
    found = components.connected_components(edges)
    assert found.groupBy("root").count().collect().__len__() == 2
    assert {(r["root"], r["count"]) for r in found.groupBy("root").count().collect()} == {(0, 100_001), (200_000, 6)}


def test_segments_follow_how_crowded_the_cells_are(spark):
    rng = random.Random(2)
    few = spark.createDataFrame([(rng.getrandbits(63),) for _ in range(500)], "fp bigint")
    assert simhash.choose_segments(few) == 8
    crowded = spark.range(20_000).selectExpr("sum(id) over (order by id) as x", "id").select(F.expr("shiftleft(1L, cast(id % 8 as int)) | shiftleft(1L, 8 + cast(id div 8 % 8 as int)) | shiftleft(1L, 16 + cast(id div 64 % 8 as int)) | shiftleft(1L, 24 + cast(id div 512 % 8 as int)) | shiftleft(1L, 32 + cast(id div 4096 % 8 as int))").alias("fp")).distinct()
    assert simhash.choose_segments(crowded) == 16
    assert simhash.choose_segments(few.limit(0)) == 8


def test_intermediate_tables_are_shared_and_can_be_removed(spark, monkeypatch):
    from specloom.llm import common

    table = common.cut(spark.range(3), "kept")
    root = f"{common.shared_dir(spark)}/specloom/{spark.sparkContext.applicationId}"
    assert root in table.inputFiles()[0]
    common.remove(spark, table.inputFiles()[0].rpartition("/")[0])
    assert not spark._jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0]).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0]))

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master = "spark://a:7077"

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(Cluster)


def test_tables_that_grow_are_joined_by_shuffle(spark):
    docs = spark.createDataFrame([(i, f"a b c {i % 7} d e") for i in range(40)], "doc_id long, text string")
    nodes = spark.createDataFrame([(1,), (3,), (1 << 40,)], "fp long")
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8)], "u long, v long")
    plans = [simhash.near_duplicates(docs), simhash.links(nodes, segments=8), components._star(components._both_ways(edges), large=True)]
    for made in plans:  # Spark would build a broadcast table on the driver
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, components.connected_components(edges).collect())) == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)]
