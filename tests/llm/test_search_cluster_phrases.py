"""op11, op12 and op13 against brute force, their defined cases, and that their methods do the work."""

import hashlib
import math
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from specloom.llm import collocations, queries, topk_search, va_clustering

VECTORS = "vec_id bigint, embedding array<float>"


def floors(values, scale):
    return [math.floor(scale * float(x)) for x in values]


def whole(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain_top(rows, scale, k, is_query):
    """(query_id, rank, vec_id, score) of all queries, by all products; rows are (vec_id, vector)."""
    kept = [(i, floors(v, scale)) for i, v in rows if whole(v)]
    out = []
    for n, (q, x) in enumerate(kept):
        if q is not None and is_query(q):
            scores = [(-sum(a * b for a, b in zip(x, y)), math.inf if i is None else i) for m, (i, y) in enumerate(kept) if m != n]
            out += [(q, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def found_top(df):
    return sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()), key=str)


def test_search_query_against_all_products(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert found_top(queries.op11_topk_search(spark, small)) == plain_top(rows, 64, 20, lambda i: i % 20 == 0)


def test_search_defined_cases(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(30)]  # equal vectors: ties by vec_id
    rows += [(3, rows[3][1]), (3, rows[5][1])]  # a repeated id, once with the same vector
    rows += [(None, rows[3][1]), (200, None), (201, [1.0, None]), (202, [float("nan")]), (203, [float("inf"), 1.0]), (204, []), (205, [0.5, 2.0]), (206, [1.0] * 9)]
    df = spark.createDataFrame([(a, b, "x", 1, 2) for a, b in rows], VECTORS + ", id string, row int, score int").repartition(3)
    got = topk_search.top_k(df, F.col("vec_id") % 3 == 0, k=5, scale=8, pivots=4, block=16, group=7)
    assert found_top(got) == plain_top(rows, 8, 5, lambda i: i % 3 == 0)
    few = spark.createDataFrame(rows[:3], VECTORS)
    assert found_top(topk_search.top_k(few, F.lit(True), scale=8)) == plain_top(rows[:3], 8, 20, lambda i: True)
    assert topk_search.top_k(df.limit(0), F.lit(True)).collect() == []
    with pytest.raises(Exception, match="larger than"):
        topk_search.top_k(spark.createDataFrame([(1, [1e6])], VECTORS), F.lit(True)).collect()


def test_search_eliminates_by_pivots(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 4
    rows = [(i, (centres[i % 40] + rng.normal(size=16) * 0.05).astype(np.float32).tolist()) for i in range(6000)]
    got = topk_search.top_k(spark.createDataFrame(rows, VECTORS).coalesce(1), F.col("vec_id") % 100 == 0, k=10).cache()
    assert found_top(got) == plain_top(rows, 64, 10, lambda i: i % 100 == 0)
    assert got.agg(F.avg("evaluated")).first()[0] < 0.25 * len(rows)


def plain_clusters(rows, k, rounds, scale=256, dims=64):
    kept = [(i, np.array(floors(v, scale), np.int64)) for i, v in rows if v is not None and len(v) == dims and whole(v)]
    starts = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1].tolist()))[:k]
    c, x = np.array([v for _, v in starts]), np.array([v for _, v in kept])
    nearest = lambda: ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        own = nearest().argmin(axis=1)
        c = np.array([x[own == j].sum(axis=0) // (own == j).sum() if (own == j).any() else c[j] for j in range(len(c))])
    d = nearest()
    own = d.argmin(axis=1)
    least = d.min(axis=1)
    digest = [hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest() for v in c]
    return sorted(((i, int(j), int(e), int(least[own == j].sum()), int(least.sum()), digest[j]) for (i, _), j, e in zip(kept, own, least, strict=True)), key=str)


def found_clusters(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def test_clustering_query_against_plain_rounds(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert found_clusters(queries.op13_va_clustering(spark, small)) == plain_clusters(rows, 40, 5)


def test_clustering_defined_cases(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-3, 3, 8).astype(np.float32).tolist()) for i in range(90)]  # many ties
    rows += [(200 + i, rows[0][1]) for i in range(60)] + [(5, rows[7][1]), (None, rows[9][1])]
    rows += [(300, None), (301, [1.0] * 7), (302, [1.0] * 7 + [None]), (303, [float("nan")] * 8), (304, [float("inf")] * 8)]
    df = spark.createDataFrame([(a, b, 0, "y") for a, b in rows], VECTORS + ", cluster int, cells string").repartition(3)
    for bits in (1, 3, 8):
        assert found_clusters(va_clustering.cluster(df, k=7, rounds=4, dims=8, bits=bits, scale=4)) == plain_clusters(rows, 7, 4, 4, 8)
    assert found_clusters(va_clustering.cluster(df.where("vec_id < 3"), k=7, rounds=2, dims=8)) == plain_clusters(rows[:3], 7, 2, 256, 8)
    assert va_clustering.cluster(df.limit(0), dims=8).collect() == []


def test_clustering_fetches_only_overlapping_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 64)) * 3
    rows = [(i, (centres[i % 6] + rng.normal(size=64) * 0.1).astype(np.float32).tolist()) for i in range(3000)]
    made = va_clustering.Clustering(spark.createDataFrame(rows, VECTORS), k=6, rounds=5)
    assert found_clusters(made.result()) == plain_clusters(rows, 6, 5)
    assert made.fetched[-1] < 0.5 * len(rows)
    seen = made._by_cells(made.vectors.select("row", F.lit(b"").alias("cells"), F.lit(0).alias("cluster")))
    assert "v#" not in seen._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]  # approximations alone are read


def plain_phrases(rows, least=10, longest=3, overlap=50, top=2000):
    counts, totals = {}, Counter()
    for lang, text in rows:
        g = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[g] += len(w)
            for k in range(1, longest + 1):
                counts.setdefault(g, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for g, f in counts.items():
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + k] for p, a in good.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= overlap * f[p[i : i + k]]}
        scored = []
        for p, a in good.items():
            if p not in gone:
                score, _, l, r = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(g, n + 1, p.decode(), -a, l, r, totals[g], -s) for n, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def found_phrases(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_phrases_query_against_plain_counts(spark, small):
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert found_phrases(queries.op12_collocations(spark, small)) == plain_phrases(rows)


def test_phrases_defined_cases_with_tries_that_burst_and_spill(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(30)] + ["The", "the", "É", "é", "a b", "x\x01"]
    marks = [" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b", "! "]
    text = lambda n: "".join(str(rng.choice(words)) + str(rng.choice(marks)) for _ in range(n))
    rows = [("en", text(int(rng.integers(0, 300)))) for _ in range(60)] + [("en", text(20_000).replace(".", " "))]
    rows += [(None, "the the the the " * 20), ("de", None), ("de", ""), ("de", " . ,"), ("fr", "one two"), ("fr", "one two " * 30), ("en", rows[0][1])]
    df = spark.createDataFrame([(a, b, "p", 1, 2) for a, b in rows], "lang string, text string, phrase string, n int, words int").repartition(3)
    want = plain_phrases(rows)
    assert want == found_phrases(collocations.collocations(df))
    assert want == found_phrases(collocations.collocations(df, chunk_words=500, most_entries=50, burst=4))
    assert found_phrases(collocations.collocations(df, top=3, overlap=90, least=5)) == plain_phrases(rows, 5, 3, 90, 3)
    assert found_phrases(collocations.collocations(df, longest=2)) == plain_phrases(rows, longest=2)
    assert collocations.collocations(df.limit(0)).collect() == []


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(collocations, "SEGMENT", 10)
    for text in (b"aaa bbb.ccc ddd eee fff ggg", b"a" * 35 + b" b " + b"c" * 12, b"", b"x" * 30):
        parts = list(collocations._segments(text))
        assert b"".join(parts) == text
        assert b" ".join(parts).replace(b".", b" . ").split() == text.replace(b".", b" . ").split()


def test_trie_bursts_and_spills_whole_subtrees():
    trie = collocations.Trie(3, burst=5)
    rng = np.random.default_rng(6)
    truth = Counter()
    for _ in range(20):
        phrases = np.unique(rng.integers(0, 6, (60, 3)), axis=0)
        counts = rng.integers(1, 5, len(phrases))
        trie.add(phrases, counts)
        truth.update({tuple(p): int(n) for p, n in zip(phrases.tolist(), counts, strict=True)})
    assert trie.burst_roots and len(trie) == len(truth)
    taken = Counter()
    first = {p[0] for phrases, counts in trie.spill(len(truth) // 2) for p, n in zip(phrases.tolist(), counts, strict=True) if not taken.update({tuple(p): int(n)})}
    assert taken == {p: n for p, n in truth.items() if p[0] in first} and len(trie) <= len(truth) // 2
    for phrases, counts in trie.spill(0):
        taken.update({tuple(p): int(n) for p, n in zip(phrases.tolist(), counts, strict=True)})
    assert taken == truth


def test_trie_takes_little_memory_where_second_words_differ():
    rng = np.random.default_rng(7)
    phrases = np.unique(rng.integers(0, [20, 20_000, 200_000], (200_000, 3)), axis=0)
    tracemalloc.start()
    try:
        trie = collocations.Trie(3)
        trie.add(phrases, np.ones(len(phrases), np.int64))
        kept, _ = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert trie.burst_roots and len(trie) == len(phrases)
    assert kept < 100 * len(phrases)


def test_scores_beyond_64_bits(spark):
    made = collocations.Collocations.__new__(collocations.Collocations)
    a, l, r = 3_000_000_000_001, 5_000_000_000_003, 7_000_000_000_009
    made.longest, made.least = 2, 10
    made.counts = spark.createDataFrame([("en", "x y", a, 2), ("en", "x", l, 1), ("en", "y", r, 1)], "lang string, phrase string, n bigint, words int")
    made.totals = spark.createDataFrame([("en", l + r)], "lang string, total bigint")
    assert made.top().first()["score"] == 1_000_000 * a * a // (l * r)
