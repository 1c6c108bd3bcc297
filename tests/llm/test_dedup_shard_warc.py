"""op1, op3 and op5 against plain versions, their edge cases, and the pipeline against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from specloom.llm import exact_dedup, queries, sharding, warc

from .test_pii import plain_spans
from .test_simhash import plain_components, plain_fingerprint


def rows_of(sql, sf):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = con.execute(sql)
    return {tuple(r) for r in got.fetchall()}, [d[0] for d in got.description]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, small, name):
    want, columns = rows_of(queries.SQL[name], small)
    found = queries.QUERIES[name](spark, small)
    assert sorted(found.columns) == sorted(columns)
    assert {tuple(r) for r in found.select(*columns).collect()} == want


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "x", i, "y") for i, t in enumerate(texts)], "doc_id bigint, text string, _row string, row bigint, _maybe string")


def test_exact_dedup_edge_cases(spark):
    texts = ["a  b", "a b", "a\t\nb", None, "", " ", "c", "a b", "x" * 200_000, "x" * 200_000]
    docs = documents(spark, texts)
    found = {r["doc_id"]: r for r in exact_dedup.exact_duplicates(docs).collect()}
    key = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t in enumerate(texts):
        same = [j for j, u in enumerate(texts) if key(u) == key(t)]
        r = found[i]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (same[0], len(same), i == same[0])
        assert r["text_sha256"] == hashlib.sha256(key(t).encode()).hexdigest()
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in found.items() if r["kept"]}
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, "t"), (3, "t"), (3, "t"), (None, "u")], "doc_id bigint, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in exact_dedup.exact_dedup(twice).collect()) == [(0, "u"), (3, "t")]


def test_a_full_filter_changes_nothing(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = {tuple(r) for r in exact_dedup.exact_duplicates(docs).drop("row").collect()}
    monkeypatch.setattr(exact_dedup.bloom, "bits_for", lambda keys, most: 64)
    assert {tuple(r) for r in exact_dedup.exact_duplicates(docs).drop("row").collect()} == want


def test_few_rows_pass_the_filter(spark, small):
    found = exact_dedup.ExactDedup(spark.read.parquet(f"{small}/documents.parquet"))
    copies = found.hashed.groupBy("text_sha256").count().where("count > 1").agg(F.sum("count")).first()[0]
    assert found.rest.count() <= copies + 2


def test_capacity_follows_the_rows_by_slices(spark):
    """Ten times the rows that one filter of 4096 bits holds: slices, the same result, and few unique rows that pass."""
    docs = spark.range(2560).select("id", F.concat(F.lit("text "), F.expr("if(id % 10 = 0, 1, id)").cast("string")).alias("text")).withColumnRenamed("id", "doc_id")
    found = exact_dedup.ExactDedup(docs, filter_bits=4096)
    assert exact_dedup.slice_count(2560, 4096) == 10 and found.hashed.select("slice").distinct().count() == 10
    rows = found.annotate().collect()
    assert len(rows) == 2560
    for r in rows:
        group = r["doc_id"] % 10 == 0 or r["doc_id"] == 1
        assert (r["keep_id"], r["group_size"]) == ((0, 257) if group else (r["doc_id"], 1))
    unique = found.rest.where("doc_id % 10 <> 0 and doc_id <> 1").count()
    assert unique < 0.05 * 2303


def test_pass_one_exchanges_chunks_and_no_rows(spark, small):
    found = exact_dedup.ExactDedup(spark.read.parquet(f"{small}/documents.parquet"))
    hot = exact_dedup.cut(exact_dedup.hot_hashes(found.hashed, found.rows), "hot")
    bitmap = exact_dedup.sparse_bitmap(found.hashed, hot, found.rows)
    plan = bitmap._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert dealt and all("hashpartitioning(chunk" in x for x in dealt) and "partial_collect_list" in plan
    assert bitmap.count() == 1 and bitmap.select(F.explode("places")).count() <= found.rows


def test_identity_of_rows_survives_a_shuffled_input(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(7)
    want = {r["keep_id"] for r in exact_dedup.exact_duplicates(docs).collect()}
    assert {r["doc_id"] for r in exact_dedup.exact_dedup(docs).collect()} == want


def test_shards_are_contiguous_balanced_and_checked(spark, small, tmp_path):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op5_sharding(spark, small).collect()
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        assert (r["size"], r["text_crc32"], r["grown_shard"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]]), None)
        by[r["shard"]].append(r)
    assert [r["shard"] for r in sorted(rows, key=lambda r: r["doc_id"])] == sorted(r["shard"] for r in rows)
    totals = [sum(r["size"] for r in by[s]) for s in range(8)]
    assert max(totals) - min(totals) <= 2 * max(r["size"] for r in rows)
    for own in by.values():
        assert [r["slot"] for r in own] == list(range(len(own)))
    odd = spark.createDataFrame([(None, None, 1), (1, "é", 2), (1, "é", 3), (0, "", 4)], "doc_id bigint, text string, shard int")
    assert sorted(r["size"] for r in sharding.assign_shards(odd, 2).collect()) == [1, 1, 3, 3]
    assert sharding.assign_shards(odd.limit(0)).count() == 0
    path = sharding.write_shards(odd, f"file://{tmp_path}/shards", 2)
    back = spark.read.parquet(path)
    assert back.count() == 4 and "shard_" in back.columns and back.where("shard_ = 0").count() >= 1


def test_archives_hold_what_was_written(spark, tmp_path):
    big = "<p>" + "x" * 2000
    pages = spark.createDataFrame([(1, "http://a/ü b\r\nc", big, 0), (5, None, big, 0), (3, "u", big, 0), (2, "v", "small", 0), (4, "w", "small", 0), (6, "z", None, 0), (None, "n", big, 0), (7, "y", "q" * 300_000, 0)], "page_id bigint, url string, html string, payload int")
    manifest = warc.write_archives(warc.with_revisits(pages), f"file://{tmp_path}/w", roll_bytes=500)
    assert manifest.agg(F.sum("records")).first()[0] == 8 and manifest.count() >= 2
    back = {r["page_id"]: r for r in warc.read_archives(manifest).collect()}
    assert {i: (r["record_type"], r["refers_to"], r["payload_bytes"]) for i, r in back.items()} == {
        1: ("revisit", 5, 2003), 3: ("revisit", 5, 2003), None: ("revisit", 5, 2003), 5: ("response", None, 2003),
        2: ("response", None, 5), 4: ("response", None, 5), 6: ("response", None, 0), 7: ("response", None, 300_000),
    }
    assert bytes(back[5]["payload"]) == big.encode() and back[1]["digest"] == hashlib.sha1(big.encode()).hexdigest()
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_broken_archives_are_refused():
    record = warc.make_record(1, "u", b"payload", None)
    raw = zlib.decompress(record, 31)
    assert warc.parse(raw)["payload"] == b"payload"
    for bad in (raw.replace(b"payload\r\n", b"pAyload\r\n"), raw[:-1], raw.replace(b"WARC/1.1", b"NONE/1.1")):
        with pytest.raises(warc.BadRecord):
            warc.parse(bad)

    class Stream:
        def __init__(self, data):
            self.data = data

        def read(self, n):
            out, self.data = self.data[:7], self.data[7:]
            return out

    assert len(list(warc.members(Stream(record * 3)))) == 3
    with pytest.raises(warc.BadRecord):
        list(warc.members(Stream(record[:-9])))


def foreign(kind, fields, block, version="WARC/1.0"):
    head = b"".join(k + b": " + v + b"\r\n" for k, v in [(b"WARC-Type", kind), *fields])
    return version.encode() + b"\r\n" + head + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def test_records_of_other_writers_have_defined_results():
    http = (b"Content-Type", b"application/http; msgtype=response")
    info = warc.parse(foreign(b"warcinfo", [(b"Content-Type", b"application/warc-fields")], b"software: x\r\n\r\nmore"))
    assert (info["warc-type"], info["payload"], info["payload_bytes"]) == ("warcinfo", b"software: x\r\n\r\nmore", 19)
    bare = warc.parse(foreign(b"response", [http], b"HTTP/1.1 200 OK\r\nTransfer-Encoding: x\r\n\r\nbody"))
    assert (bare["payload"], bare["payload_bytes"], bare["digest"]) == (b"body", 4, hashlib.sha1(b"body").hexdigest())
    assert warc.parse(foreign(b"request", [http], b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"))["payload_bytes"] == 0
    odd = warc.parse(foreign(b"metadata", [(b"WARC-Target-URI", b"http://a/\xff"), (b"X-Long", b"a\r\n b")], b""))
    assert odd["warc-target-uri"] == "http://a/\xff" and odd["x-long"] == "a b"
    other = warc.parse(foreign(b"resource", [(b"WARC-Block-Digest", b"md5:00")], b"data"))
    assert other["payload"] == b"data"
    assert warc.parse(foreign(b"response", [http, (b"WARC-Payload-Digest", b"sha1:" + hashlib.sha1(b"b").hexdigest().encode())], b"HTTP/1.1 200 OK\r\n\r\nb"))["digest"] == hashlib.sha1(b"b").hexdigest()
    again = warc.parse(foreign(b"revisit", [http], b"HTTP/1.1 200 OK\r\n\r\n"))
    assert (again["payload_bytes"], again["digest"]) == (None, None)
    for bad in (foreign(b"response", [http, (b"WARC-Payload-Digest", b"sha1:!!")], b"HTTP/1.1 200 OK\r\n\r\nb"), foreign(b"response", [http], b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\nb"), b"WARC/1.0\r\nWARC-Type: x\r\n\r\n", foreign(b"a", [], b"x").replace(b"Length: 1", b"Length: z")):
        with pytest.raises(warc.BadRecord):
            warc.parse(bad)


def test_a_member_that_inflates_far_beyond_a_chunk(monkeypatch):
    import io

    monkeypatch.setattr(warc, "CHUNK", 1000)
    record = warc.make_record(1, "u", b"x" * 300_000, None)
    assert [warc.parse(raw)["payload_bytes"] for raw in warc.members(io.BytesIO(record * 2))] == [300_000] * 2
    with pytest.raises(warc.BadRecord):
        list(warc.members(io.BytesIO(b"no gzip at all")))


def test_repeated_page_ids(spark):
    big = "y" * 1500
    pages = spark.createDataFrame([(3, "u", big), (3, "u", big), (1, "u", big), (1, None, "s"), (1, None, "s"), (None, None, None)], "page_id bigint, url string, html string")
    rows = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in warc.round_trip(pages).collect())
    assert rows == [(0, 0, "response", 0), (1, 1, "response", 0), (1, 1, "response", 0), (1, 1500, "revisit", 3), (3, 1500, "response", 0), (3, 1500, "response", 0)]


def test_pipeline_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.cut(stage(spark, docs, sf), f"test-{i}")
        if i < 4:
            assert out.columns == docs.columns
        steps[name], docs = ({r["doc_id"]: r["text"] for r in docs.collect()}, out.collect()), out
    before, after = steps["quality classifier"]
    assert len(before) == 200 and {r["doc_id"] for r in after} < set(before)
    before, after = steps["exact dedup"]
    first = {}
    for i in sorted(before):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i] or ""), i)
    assert {r["doc_id"] for r in after} == set(first.values())
    before, after = steps["simhash near-dedup"]
    least = plain_components({i: plain_fingerprint(t) for i, t in before.items()})
    assert {r["doc_id"] for r in after} == set(least.values())
    before, after = steps["pii"]
    assert {r["doc_id"] for r in after} == set(before)
    for r in after:
        assert not plain_spans(r["text"]) and r["n_chars"] == len(r["text"])
        if not plain_spans(before[r["doc_id"]]):
            assert r["text"] == before[r["doc_id"]]
    before, after = steps["best-fit packing"]
    assert {r["doc_id"] for r in after} == set(before)
    assert corpus_pipeline.run(spark, sf).count() == len(after)


def test_pipeline_of_odd_documents(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, ties, further columns with clashing names, and no rows at all."""
    long = " ".join(f"word{i % 977} then{i % 31}" for i in range(12_000))
    texts = [None, "", " ", "mail me at a@b.cd now please", "mail me at a@b.cd now please", long, long, long + " end", "x" * 70_000, "plain text of some words " * 5]
    rows = [(i, t, "en", "s", len(t or ""), 1, "d", 2) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 5, 1, "d", 2), (None, "no id here", None, None, None, 1, "d", 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int, row int, doc string, score int")
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    for source in (docs, docs.limit(0)):
        source.write.mode("overwrite").parquet(f"{sf}/documents.parquet")
        now, counts = spark.read.parquet(f"{sf}/documents.parquet"), []
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            now = corpus_pipeline.cut(stage(spark, now, sf), f"odd-{i}")
            assert now.columns == docs.columns
            counts.append(now.count())
        packed = corpus_pipeline.run(spark, sf)
        if source is docs:
            texts_left = {r["doc_id"]: r["text"] for r in now.collect()}
            assert counts[:2] == [12, 8] and texts_left[3] == "mail me at <EMAIL> now please" and set(texts_left) >= {0, 3, 5, 8, 9, None}
            assert {r["doc_id"] for r in packed.collect()} == set(texts_left)
        else:
            assert counts == [0] * 4 and packed.count() == 0


def test_groups_of_copies_are_joined_by_shuffle(spark):
    docs = spark.createDataFrame([(i, f"text {i // 2}") for i in range(20)], "doc_id long, text string")
    plan = exact_dedup.ExactDedup(docs)._judged()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan  # else their hash table would be built on the driver
