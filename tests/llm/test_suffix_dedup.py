"""op2 against a brute-force version, with long runs, tiny shards and a tiny filter."""

import hashlib
import random
import tracemalloc

import numpy as np
import pytest

from specloom.llm import queries, suffix_dedup


def brute(texts, length):
    first, out = {}, {}
    raws = {i: (t or "").encode() for i, t in texts.items()}
    for i in sorted(raws):
        for p in range(len(raws[i]) - length + 1):
            first.setdefault(raws[i][p : p + length], (i, p))
    for i, raw in raws.items():
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] < (i, p):
                gone[p : p + length] = b"\x01" * length
        spans = bytes(gone).replace(b"\x00", b" ").split()
        out[i] = (len(raw), sum(gone), len(spans), bytes(b for b, g in zip(raw, gone, strict=True) if not g))
    return out


def test_query_against_brute_force(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    want = brute(texts, 100)
    rows = queries.op2_suffix_dedup(spark, small).collect()
    assert len(rows) == len(texts) and any(r["n_removed"] for r in rows)
    for r in rows:
        n, removed, spans, kept = want[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, removed, spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize(("seed", "options"), [(0, {}), (1, {"shard_bytes": 1, "memory": 50}), (2, {"max_filter_bits": 2**20, "shard_bytes": 500}), (3, {"hot_segments": 1}), (4, {"hot_segments": 3, "shard_bytes": 400}), (5, {"hot_segments": 2, "shard_bytes": 1 << 20, "memory": 60})])
def test_random_texts(spark, monkeypatch, seed, options):
    rng = random.Random(seed)
    words = ["ab", "é", "x" * 7, "\n", " ", "lorem ", "日本"]
    parts = ["".join(rng.choice(words) for _ in range(30)) for _ in range(12)]
    texts = ["".join(rng.choice([*parts, rng.choice(words), "z"]) for _ in range(rng.randrange(0, 12))) for _ in range(80)]
    texts += [None, "", "a" * 500, "ab" * 400, "a" * 19, "a" * 20, "b" + "a" * 21, texts[3], texts[3], "lorem " * 90]
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    docs = spark.createDataFrame([(i, t, 1, b"") for i, t in enumerate(texts)], "doc_id bigint, text string, n int, bytes binary")
    rows = suffix_dedup.substring_dedup(docs, length=20, **options).collect()
    want = brute(dict(enumerate(texts)), 20)
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == want[r["doc_id"]], texts[r["doc_id"]]


def test_no_rows_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "q" * 5 + "r" * 30), (4, "r" * 30), (4, "r" * 30), (9, "s" * 10)], "doc_id bigint, text string")
    rows = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed"]) for r in suffix_dedup.substring_dedup(docs, length=20).collect())
    assert rows == [(False, 4, 29), (False, 4, 29), (False, 9, 0), (True, 0, 30)]
    assert suffix_dedup.substring_dedup(docs.limit(0)).count() == 0


def test_split_segments_hold_each_string_once_under_one_key():
    rng = np.random.default_rng(0)
    body = rng.integers(97, 100, 3000).astype(np.uint8)
    data = np.concatenate([body, body[500:1500], rng.integers(97, 100, 500).astype(np.uint8)])
    bounds = np.array([3000, 4000, 4500])
    plain, split = (suffix_dedup.Chunk(data, bounds, 100) for _ in range(2))
    split.split(np.arange(0, len(split.h), 2))
    starts = lambda c: np.sort(np.concatenate([np.arange(a, a + n) for a, n in zip(c.start, c.n, strict=True)]))
    assert np.array_equal(starts(plain), starts(split)) and len(split.h) > len(plain.h)
    every = suffix_dedup.Chunk(data, bounds, 100)
    every.split(np.arange(len(every.h)))
    keys = {}
    for h, a, n in zip(every.h.tolist(), every.start.tolist(), every.n.tolist(), strict=True):
        for i in range(a, a + n):
            assert keys.setdefault(data[i : i + 100].tobytes(), h) == h


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_segments_do_not_depend_on_blocks(monkeypatch, block):
    rng = np.random.default_rng(block)
    data = rng.integers(97, 99, 700).astype(np.uint8)
    bounds = np.array([30, 30, 31, 200, 650, 700])
    length, (k, w) = 20, suffix_dedup.piece_sizes(20)
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    c = suffix_dedup.Chunk(data, bounds, length)
    pieces = c.hashes(np.arange(len(data) - k + 1), np.arange(k, len(data) + 1)) >> np.uint64(24)
    want = []
    for p in range(len(data) - length + 1):
        if any(p < b < p + length for b in bounds):
            continue
        anchor = p + max(range(w), key=lambda i: (-int(pieces[p + i]), i))
        if want and want[-1][1] == anchor and want[-1][2] + want[-1][3] == p and p not in bounds:
            want[-1][3] += 1
        else:
            want.append([int(c.hashes(np.array([anchor]), np.array([anchor + k]))[0]), anchor, p, 1])
    assert [list(x) for x in zip(c.h.tolist(), c.anchor.tolist(), c.start.tolist(), c.n.tolist(), strict=True)] == want


def test_a_chunk_holds_few_arrays_as_long_as_itself():
    data = np.random.default_rng(0).integers(97, 123, 1 << 20).astype(np.uint8)
    suffix_dedup.Chunk(data, np.array([1 << 20]))
    tracemalloc.start()
    suffix_dedup.Chunk(data, np.array([1 << 20]))
    assert tracemalloc.get_traced_memory()[1] < 50 << 20
    tracemalloc.stop()


def test_equal_hashes_alone_do_not_fold():
    data = np.frombuffer(b"a" * 150 + b"b" * 150, np.uint8)
    c = suffix_dedup.Chunk(data, np.array([150, 300]), 100)
    assert c.same(np.array([0, 0]), np.array([1, len(c.h) - 1])).tolist() == [True, False]


def test_a_hot_anchor_with_many_different_surroundings(spark):
    rng = random.Random(1)
    middle = "".join(rng.choice("abcdefgh") for _ in range(40))
    texts = ["".join(rng.choice("xyz") for _ in range(40)) + middle + "".join(rng.choice("uvw") for _ in range(rng.choice([3, 40]))) for _ in range(60)]
    texts += [t[10:] for t in texts[:20]] + [middle * 4] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(9)
    want = brute(dict(enumerate(texts)), 50)
    for options in ({}, {"hot_segments": 10, "shard_bytes": 5000}, {"hot_segments": 10, "memory": 100}):
        for r in suffix_dedup.substring_dedup(docs, length=50, **options).collect():
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == want[r["doc_id"]]
