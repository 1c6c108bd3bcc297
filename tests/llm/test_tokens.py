"""op4, op8 and op7 against plain versions of the same definitions."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from specloom.llm import bpe, packing, quality_rules, queries

ODD_TEXTS = [None, "", " ", "  ", "a", "a  b\n\n c", "x  y", "tab\t\ttab \r\n", "word " * 3000, "no_space" * 2000, "don't  we'll\n 12 345", "<|endoftext|> ok", "日本語 テキスト　です", "é" * 300 + " " + "  z", "a" + " " * 500 + "b", "\x1c \x85 q"]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "clash", i) for i, t in enumerate(texts)], "doc_id bigint, text string, length string, row bigint")


def test_bpe_equals_the_library_and_round_trips(spark, small):
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("t", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = documents(spark, ODD_TEXTS).select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, path, tokenizers.PATTERN), path, tokenizers.PATTERN)
    for r in coded.collect():
        assert r["ids"] == own.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    for r in queries.op4_byte_bpe(spark, small).collect():
        assert r["n_tokens"] >= 0 and len(r["ids_sha256"]) == 64
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op4_byte_bpe(spark, small).collect():
        ids = own.encode_ordinary(texts[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert bpe.encode(docs.limit(0), path, tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_safe_parts_do_not_change_ids(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["a", "Z", "9", " ", "\n", "  ", "'s", "é", " ", ".", "-"]) for _ in range(4000))
    own = bpe.encoding(tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)
    parts = list(bpe.safe_parts(text, 40))
    assert "".join(parts) == text and len(parts) > 10
    assert [i for p in parts for i in own.encode_ordinary(p)] == own.encode_ordinary(text)


@pytest.mark.parametrize("unit", ["слово и другие слова, ", "漢字かな交じり文。次の文、", "word's and 12 more. ", "ελληνικά κείμενα; "])
def test_long_texts_of_every_script_are_cut(unit):
    own = bpe.encoding(tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)
    text = unit * (1_000_000 // len(unit))
    parts = list(bpe.safe_parts(text))
    assert len(parts) > 10 and max(map(len, parts)) < bpe.LONG + 100
    assert bpe.encode_text(text, own).tolist() == own.encode_ordinary(text)


@pytest.mark.parametrize("seed", range(4))
def test_safe_places_of_many_scripts_do_not_change_ids(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["я", "漢", "。", "、", "」", "é", "e\u0301", "٣", " ", "\n", "'s", "’", "x", "\u3000", "\u00a0", "!", "ก"]) for _ in range(6000))
    own = bpe.encoding(tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)
    parts = list(bpe.safe_parts(text, 10))
    assert "".join(parts) == text and len(parts) > 100
    assert [i for p in parts for i in own.encode_ordinary(p)] == own.encode_ordinary(text)


def test_bpe_of_clashing_columns_repeats_and_byte_bounds(spark, monkeypatch):
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    monkeypatch.setattr(bpe, "IDS", 50)
    docs = spark.createDataFrame([(1, "a b", 7, 8), (1, "a b", 7, 8), (None, "c " * 300, 7, 8), (2, None, 7, 8)], "doc_id bigint, text string, IDS int, decoded int")
    coded = bpe.encode(docs, path, tokenizers.PATTERN)
    assert coded.columns[-1] == "ids_"
    rows = bpe.decode(coded, path, tokenizers.PATTERN, ids_column="ids_").collect()
    assert sorted(bytes(r["decoded_"]).decode() for r in rows) == ["", "a b", "a b", "c " * 300] and {r["IDS"] for r in rows} == {7}


def test_packing_query_against_the_library(spark, small):
    lib = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    check_packing(queries.op8_best_fit_packing(spark, small).collect(), texts, lib)
    docs = documents(spark, ODD_TEXTS)
    packed = packing.pack(packing.pieces(docs, tokenizers.path("byte_bpe_50k.json"), with_ids=True))
    rows = packed.collect()
    check_packing(rows, {i: t or "" for i, t in enumerate(ODD_TEXTS)}, lib, spare=1)
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for r in rows:
        assert whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]
    assert packing.pack(packing.pieces(docs.limit(0), tokenizers.path("byte_bpe_50k.json"))).count() == 0


def check_packing(rows, texts, lib, spare=0):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert by_doc.keys() == texts.keys()
    for doc, own in by_doc.items():
        ids = [*lib.encode(texts[doc], add_special_tokens=False).ids, 2]
        at = 0
        for n, r in enumerate(sorted(own, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (n, at) and (n == 0 or r["length"] == 1024)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) <= max(math.ceil(total / 1024 * 1.005), math.ceil(total / 1024) + spare)


@pytest.mark.parametrize("seed", range(4))
def test_units_do_not_change_ids(seed):
    rng = random.Random(seed)
    lib = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    signs = ["a", "The", "Zoë", "ÿ", "×", "9", " ", " ", " ", "\n", "\t", "\r\n", "  ", "'s", "'", "é", ".", "#", "漢", "e\u0301", "<|endoftext|>"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(30))) + rng.choice(["", "", "\x1c", "\u00a0\n b", "\u2028"]) for _ in range(400)]
    own = packing.UnitTokenizer(tokenizers.path("byte_bpe_50k.json"), units_kept=200)
    for at in range(0, len(texts), 40):
        part = pa.array([None, "", *texts[at : at + 40], ""])
        ids, ends = own.ids(part.slice(1))
        assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends)] == [lib.encode(t, add_special_tokens=False).ids for t in part.to_pylist()[1:]]  # noqa: B905


def test_a_unit_is_looked_up_once_for_all_its_places():
    class Counted(dict):
        looked = 0

        def get(self, *a):
            Counted.looked += 1
            return super().get(*a)

    own = packing.UnitTokenizer(tokenizers.path("byte_bpe_50k.json"))
    own.kept = Counted()
    ids, ends = own.ids(pa.array(["the same words, again and again. " * 1000, "Words again,\nagain and again."]))
    assert len(ids) == ends[1] > 7000 and Counted.looked < 20


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_within_capacity(seed):
    rng = np.random.default_rng(seed)
    counts = {int(k): int(v) for k, v in zip(rng.choice(np.arange(1, 65), 20, replace=False), rng.integers(1, 1000, 20), strict=True)}
    made = packing.plan(counts, 64)
    used = Counter()
    for took, times in made:
        assert sum(took) <= 64
        for x in took:
            used[x] += times
    assert used == counts
    sizes, places = packing.ranges(made, counts)
    ranks = Counter()
    for length, block, lo, hi, _, _, _, begin in places:
        assert begin <= lo < hi <= counts[length] and lo // dict(sizes)[length] == block == (hi - 1) // dict(sizes)[length]
        ranks[length] += hi - lo
    assert ranks == counts


def test_pairs_and_triples_fill_gaps_exactly():
    assert packing.plan({60: 2, 40: 2}, 100) == [((60, 40), 2)]
    assert packing.plan({50: 1, 30: 1, 20: 1}, 100) == [((50, 30, 20), 1)]
    assert packing.plan({40: 1, 24: 1, 20: 1, 16: 1}, 100) == [((40, 24, 20, 16), 1)]
    assert packing.plan({50: 3}, 100) == [((50, 50), 1), ((50,), 1)]


@pytest.mark.parametrize("seed", range(4))
def test_gaps_are_filled_by_the_index_wherever_it_can(seed):
    rng = np.random.default_rng(seed)
    capacity, least = 256, 40
    counts = {int(k): int(n) for k, n in zip(*np.unique(rng.integers(10, 110, 400), return_counts=True), strict=True)}
    have, pairs_and_triples = Counter(counts), 0
    for took, times in packing.plan(counts, capacity):
        for _ in range(times):
            left, gap = have.copy(), capacity - took[0]
            left.subtract([took[0]])
            long = [x for x in left if left[x] > 0 and x >= least]
            two = {a + b for a in long for b in long if a < b or left[a] > 1 and a == b}
            exact = left[gap] > 0 or gap in two
            assert not exact or sum(took) == capacity, took
            pairs_and_triples += len(took) in (3, 4) and min(took[1:]) >= least and sum(took) == capacity
            have.subtract(took)
    assert not +have and pairs_and_triples >= 10


def test_most_gaps_are_filled_exactly_on_a_large_histogram():
    rng = np.random.default_rng(1)
    drawn = np.ceil(rng.lognormal(5.5, 1.0, 200_000)).astype(int)
    drawn = drawn[drawn < 1000]
    counts = {int(k): int(n) for k, n in zip(*np.unique(drawn, return_counts=True), strict=True)}
    made = packing.plan(counts, 1024)
    total, sequences = int(drawn.sum()), sum(n for _, n in made)
    assert sequences <= -(-total // 1024) * 1.0005 + 1
    filled = sum(n for took, n in made if len(took) in (3, 4) and min(took[1:]) >= 160 and sum(took) == 1024)
    exact = sum(n for took, n in made if len(took) <= 4 and sum(took) == 1024)
    assert exact > 0.6 * sequences and filled > sequences / 8


def test_packing_of_clashing_columns_repeats_and_long_texts(spark):
    lib = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    texts = ["word " * 40_000, "слово " * 15_000, None, "", "same text", "same text", "x" * 70_000]
    docs = documents(spark, texts)
    made = packing.pieces(docs, tokenizers.path("byte_bpe_50k.json")).withColumn("_part", F.lit("p")).withColumn("row", F.lit("r")).withColumn("sequence_id", F.lit("s")).withColumn("Offset", F.lit("o"))
    rows = packing.pack(made).collect()
    assert {(r["_part"], r["row"], r["sequence_id"], r["Offset"]) for r in rows} == {("p", "r", "s", "o")}
    renamed = [{**r.asDict(), "sequence_id": r["sequence_id_"], "offset": r["offset_"]} for r in rows]
    check_packing(renamed, {i: t or "" for i, t in enumerate(texts)}, lib, spare=1)
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "d")], "doc_id bigint, text string")
    assert packing.pack(packing.pieces(twice, tokenizers.path("byte_bpe_50k.json"))).count() == 3


def plain_statistics(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    inside = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)]


def test_rule_statistics_against_a_plain_version(spark, small):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op7_quality_rules(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = plain_statistics(texts[r["doc_id"]])
        assert [r[c] for c in quality_rules.COUNTS[:5]] == n
        assert r["base_failed"] == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert not (r["base_failed"] and r["kept"])
    odd = quality_rules.statistics(documents(spark, [*ODD_TEXTS, "\x0b\x0c  ", "a b c d e f g h " * 3])).collect()
    for r, t in zip(sorted(odd, key=lambda r: r["doc_id"]), [*ODD_TEXTS, "\x0b\x0c  ", "a b c d e f g h " * 3], strict=True):
        assert list(r)[1:6] == plain_statistics(t or "")


def test_rules_hold_on_labels_that_were_not_used(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    unseen = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) == 0)
    out = quality_rules.apply_rules(docs, labels.join(unseen, "doc_id", "left_anti"))
    judged = out.join(unseen, "doc_id").where("not base_failed").select("kept", "rule", "quality").collect()
    bad = [r for r in judged if r["quality"] == 0]
    good = [r for r in judged if r["quality"] == 1]
    assert sum(r["kept"] for r in good) / len(good) > 0.99
    assert sum(not r["kept"] for r in bad) / len(bad) > 0.6


def test_a_small_sample_yields_rules(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.apply_rules(docs, labels).join(labels, "doc_id", "left").select("rule", "quality").collect()
    hit = [r["quality"] for r in rows if r["rule"]]
    assert hit and hit.count(1) <= 0.03 * len(hit)


def test_learning_goes_on_after_a_refused_rule():
    rng = np.random.default_rng(0)
    n = 900
    x = {"a": rng.uniform(0, 1, n), "b": rng.uniform(0, 1, n)}
    held = np.arange(n) % 3 == 0
    noise = (x["a"] > 0.9) & ~held  # bad only in the rows that rules are grown on: cannot be confirmed
    real = x["b"] > 0.9
    rules = quality_rules.learn(x, noise | real, held)
    assert rules and all(c.feature == "b" for c in rules[0])
    hit = quality_rules.covers(rules[0], x, n)
    assert real[hit].all() and hit.sum() > 0.8 * real.sum()


def test_rules_without_labels_or_rows(spark):
    docs = documents(spark, ODD_TEXTS)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "word " * 30), (2, "long " * 70_000)], "doc_id bigint, text string")
    assert sorted((r["n_words"], r["kept"]) for r in quality_rules.apply_rules(twice, none).collect()) == [(2, False), (2, False), (30, False), (70_000, False)]
    assert {r["rule"] for r in quality_rules.apply_rules(docs, none).collect()} == {0}
    assert quality_rules.apply_rules(docs.limit(0), none).count() == 0
