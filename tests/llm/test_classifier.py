"""op9: held-out accuracy, and defined results without labels, texts or rows."""

import numpy as np
from pyspark.sql import functions as F

from specloom.llm import quality_classifier as qc


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    unseen = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0)
    out = qc.classify(docs, labels.join(unseen, "doc_id", "left_anti"))
    assert out.count() == docs.count()
    judged = out.join(unseen, "doc_id").select("p_text", "p_meta", "keep", "quality").collect()
    good, bad = [r for r in judged if r["quality"] == 1], [r for r in judged if r["quality"] == 0]
    assert sum(r["keep"] for r in good) / len(good) > 0.985
    assert sum(not r["keep"] for r in bad) / len(bad) > 0.9
    assert sum((r["p_text"] >= 0.5) == (r["quality"] == 1) for r in judged) / len(judged) > 0.95
    assert all(0 < r["p_meta"] < 1 for r in judged)


def test_views_teach_each_other_over_all_documents(spark):
    """Few labels; the source tells most, and words that no labelled document has come with it: only pseudo-labels can teach them."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(3000):
        good = i % 3 > 0
        words = [f"{'fine' if good else 'junk'}{rng.integers(300)}" if i >= 240 else f"common{rng.integers(20)}" for _ in range(12)]
        rows.append((i, " ".join([*words, "alpha" if good else "omega"] if i < 240 else words), "en", f"{'press' if good else 'spam'}{i % 5}", 90))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(240)], "doc_id bigint, quality int, toxic int")
    plain, taught = (qc.train(docs, labels, rounds=r) for r in (0, 2))
    unseen = qc.Rows.of([qc.text_features(f"fine{i} fine{i + 1}") for i in range(100)] + [qc.text_features(f"junk{i} junk{i + 1}") for i in range(100)])
    right = lambda m: float(((unseen.logits(m.text) > 0) == (np.arange(200) < 100)).mean())
    assert right(taught) > 0.95 > right(plain)
    sums = qc.label_sums(qc.viewed(docs), plain, 0.66)
    assert sums[0, :, qc.DIM].sum() > 2500


def test_metadata_features_see_nothing_of_the_text():
    assert np.array_equal(qc.meta_features("en", "s", 5), qc.meta_features("en", "s", 5))
    assert len(qc.meta_features(None, None, None)) == 5


def test_edge_cases(spark):
    rows = [(i, None if i == 3 else f"text {i} " * i, None if i == 4 else "en", "s", 1.0) for i in range(40)] + [(None, "x", None, None, 0.0)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, score double")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    out = qc.classify(docs, none)
    assert out.columns == [*docs.columns, "p_text", "p_meta", "score_", "keep"]
    assert {(r["score_"], r["keep"]) for r in out.collect()} == {(0.5, True)}
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(1, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert qc.classify(docs, labels).count() == len(rows)
    twice = docs.unionByName(docs.where("doc_id < 9"))
    assert qc.classify(twice, labels).count() == len(rows) + 9
    huge = docs.unionByName(spark.createDataFrame([(50, "long text " * 100_000, None, None, None)], docs.schema))
    assert qc.classify(huge.drop("lang", "source"), labels).columns == ["doc_id", "text", "score", "p_text", "p_meta", "score_", "keep"]
    assert qc.classify(huge, labels).count() == len(rows) + 1
    assert qc.keep_good(docs, labels).columns == docs.columns
    assert qc.classify(docs.limit(0), labels).count() == 0


def test_a_few_odd_rows_do_not_open_the_filter():
    scores = np.concatenate([np.linspace(0.01, 0.4, 200), np.linspace(0.8, 0.99, 800)])
    good = np.arange(1000) >= 200
    assert qc.cut_point(scores, good) == 0.5
    good[[3, 60, 110, 150]] = True
    assert qc.cut_point(scores, good) == 0.5
    good[100:200] = True
    assert 0.2 < qc.cut_point(scores, good) < 0.25
    assert qc.cut_point(scores, np.ones(1000, bool)) == 0
