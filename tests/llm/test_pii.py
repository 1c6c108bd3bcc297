"""op6: base spans against the contract's patterns, and what contexts add."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from specloom.llm import pii, queries

PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(d := re.sub(r"[ -]", "", s)) <= 19 and plain_luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub(r"[^0-9]", "", s)) <= 15),
}


def plain_luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def plain_spans(text):
    found = [(m.start(), list(PLAIN).index(k), m.end()) for k, (p, ok) in PLAIN.items() for m in re.finditer(p, text) if ok(m[0])]
    return sorted(found)


@pytest.mark.parametrize("seed", range(8))
def test_base_spans_on_random_texts(seed):
    rng = random.Random(seed)
    bits = ["a", "Z", "1", "23", "255", "256", ".", "@", "-", "+", " ", "(", ")", "4111111111111111", "1.2.3.4", "a@b.c", "é", "%", "00", "\n", "_"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + "(" * 200_000, "@" * 200_000):
        pii.base_spans(text)


def test_query_against_plain_patterns(spark, small):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op6_pii(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = plain_spans(texts[r["doc_id"]])
        said = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans]
        assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == i for s in spans) for i in range(4)]
        assert set(said) <= set(filter(None, r["spans"].split(",")))


def test_contexts_find_unseen_identifiers_and_nothing_else(spark):
    seeds = [f"please call me at +1 (555) 010-{1000 + i} tomorrow or so" for i in range(40)]
    new = ["please call me at 555.010.7777 tomorrow or so", "they call me at 020-7946-0958 tomorrow again"]
    other = [f"the part number is 99887{i:04d} as listed" for i in range(40)] + ["edition of 19991231 in print", None, ""]
    texts = [*seeds, *new, *other]
    docs = spark.createDataFrame([(i, t, "x", len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, base string, n_chars bigint")
    found = {r["doc_id"]: r["spans"] for r in pii.report(docs).collect()}
    assert found[40] == "phone:18:30" and found[41] == "phone:16:29"
    assert all(found[i] == "" for i in range(42, len(texts)))
    clean = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert clean[0]["text"] == "please call me at <PHONE> tomorrow or so" and clean[0]["n_chars"] == len(clean[0]["text"])
    assert clean[40]["text"] == "please call me at <PHONE> tomorrow or so"
    assert clean[45]["text"] == texts[45] and clean[len(texts) - 2]["text"] is None
    assert pii.report(docs.limit(0)).count() == 0


def test_values_found_in_one_context_lead_to_the_next(spark):
    seeds = [f"please call me at +1 (555) 010-{1000 + i} tomorrow or so" for i in range(40)]
    found = [f"please call me at 555.010.77{i} tomorrow or so" for i in range(10, 20)]
    again = [f"kindly ring desk line 555.010.77{i} during office hours" for i in range(10, 20)]
    new = ["kindly ring desk line 020-7946-0958 during office hours", "kindly ring part number 020-7946-0959 during office"]
    texts = [*new, *seeds, *found, *again]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.report(docs).collect()}
    assert spans[0] == "phone:22:35" and spans[1] == ""
    assert all(spans[i] for i in range(2, len(texts)))


def test_identifiers_with_blanks_are_candidates():
    for text, wanted in (
        ("please call me at 020 7946 0958 tomorrow", "020 7946 0958"),
        ("please call me at (555) 010-7777 tomorrow", "(555) 010-7777"),
        ("call me at 020 7946 0958, 12 of us", "020 7946 0958"),
        ("at 555 010 7777", "555 010 7777"),
    ):
        assert wanted in [text[a:b] for a, b in pii.candidates(text, pii.base_spans(text))]
    assert [t[a:b] for t in ["room B417, or #a1"] for a, b in pii.candidates(t, [])] == ["B417"]
    assert pii.candidates("12 or 34 of 5 pages", []) == []
    assert pii.candidates("1 2 3 4 5 " * 10, []) == []
    text = "12 +1 (555) 010-1000 34 56"
    assert pii.candidates(text, pii.base_spans(text)) == []


def test_masks_merge_overlaps():
    assert pii.masked("ab12cd", [(2, 1, 4), (3, 2, 5)]) == "ab<IP>d"
    assert pii.masked("ab", []) == "ab"


def plain_bootstrapping(texts):
    """The same definition, one dictionary at a time: all spans of each text."""
    seen = [(i, a, b, k, t[a:b].lower(), pii.patterns(t, a, b)) for i, t in enumerate(texts) for own in [pii.base_spans(t)] for a, b, k in [(a, b, k) for a, k, b in own] + [(a, b, None) for a, b in pii.candidates(t, own)]]
    edges = {(p, v, k) for _, _, _, k, v, ps in seen for p in ps}
    sizes = {p: len({v for q, v, _ in edges if q == p}) for p in {p for p, _, _ in edges}}
    seeds = defaultdict(int)
    for p, _, k in edges:
        if k is not None:
            seeds[p, k] += 1
    free = defaultdict(set)
    for p, v, k in edges:
        if k is None:
            free[p].add(v)
    scored = {pk: round(n / (sizes[pk[0]] + 1), 9) for pk, n in seeds.items() if n >= 5}
    for _ in range(pii.MOST_TURNS):
        miss = defaultdict(lambda: 1.0)
        for (p, k), s in scored.items():
            for v in free[p]:
                miss[v, k] *= max(1e-9, 1 - s)
        value = {vk: round(1 - m, 9) for vk, m in miss.items()}
        now = {}
        for p in sizes:
            for k in range(4):
                own = [value[v, k] for v in free[p] if (v, k) in value]
                if seeds.get((p, k), 0) + sum(x >= pii.CONFIDENT for x in own) >= pii.SUPPORT:
                    now[p, k] = round((seeds.get((p, k), 0) + sum(own)) / (sizes[p] + 1), 9)
        if now == scored:
            break
        scored = now
    best = {}
    for (p, k), s in scored.items():
        if s >= pii.CONFIDENT:
            best[p] = max(best.get(p, (0, 0)), (s, k))
    spans = defaultdict(list)
    for i, a, b, k, _, ps in seen:
        named = max((best[p] for p in ps if p in best), default=None)
        if any(ps) and k is None and named:
            spans[i].append((a, named[1], b))
    return [sorted([*pii.base_spans(t), *spans[i]]) for i, t in enumerate(texts)]


def chain(hops):
    """Texts in which each context shares values with the next one only; the last holds one value more."""
    texts = [f"please call me at +1 (555) 010-{1000 + i} tomorrow or so" for i in range(40)]
    contexts = ["please call me at {} tomorrow or so", *(f"step{h} ring desk line{h} {{}} then{h} hold on" for h in range(1, hops + 1))]
    for h in range(hops):
        for i in range(12):
            value = f"X{h}{i:02d}-55"
            texts += [contexts[h].format(value), contexts[h + 1].format(value)]
    return [*texts, contexts[-1].format("Q7-last"), "the part number is 99887766 as listed", ""]


@pytest.mark.parametrize("hops", [1, 2, 4])
def test_bootstrapping_equals_a_plain_loop(spark, hops):
    texts = chain(hops)
    want = plain_bootstrapping(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.report(docs).collect()}
    assert got == {i: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in own) for i, own in enumerate(want)}
    assert got[len(texts) - 3].startswith("phone") and not got[len(texts) - 2]


def test_the_query_equals_a_plain_loop(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    want = plain_bootstrapping([r["text"] or "" for r in rows])
    got = {r["doc_id"]: r["spans"] for r in queries.op6_pii(spark, small).collect()}
    assert got == {r["doc_id"]: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in own) for r, own in zip(rows, want, strict=True)}


def test_words_around_a_span_are_whole():
    long = "w" * 500
    text = f"{long} {long}x 123456 {long}y z"
    first, second = pii.patterns(text, text.index("123456"), text.index("123456") + 6)
    assert first == f"{pii._plain(long)} {pii._plain(long + 'x')} _" and second == f"{pii._plain(long + 'x')} _ {pii._plain(long + 'y')}"
    assert pii.patterns("a b 1234", 4, 8) == ["a b _"] and pii.patterns("1234 c", 0, 4) == []


def test_repeats_nulls_and_clashing_columns(spark):
    text = "mail a@b.cd now"
    docs = spark.createDataFrame([(1, text, 1, 2, 3), (1, text, 1, 2, 3), (None, None, 1, 2, 3), (2, "x" * 300_000 + " 1.2.3.4", 1, 2, 3)], "doc_id bigint, text string, row int, doc int, _spans int")
    out = pii.redact(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[-14:]) for r in out.collect()) == [(0, ""), (1, "mail <EMAIL> now"[-14:]), (1, "mail <EMAIL> now"[-14:]), (2, "x" * 9 + " <IP>")]
    assert sorted(r["n_email"] for r in pii.report(docs).collect()) == [0, 0, 1, 1]
