"""Quality rules: a decision list learned by sequential covering over per-document statistics.

Statistics of every whole text are computed once. Rules are learned from labelled rows that the base
rule lets pass: a rule is a conjunction of thresholds, grown by FOIL gain on two thirds of the sample
(each condition's thresholds lie between the values of the rows still inside, at quantiles of the bad
ones), pruned from its end on the other third, and accepted only if it is precise on both parts;
covered rows leave and the next rule is grown. A rule that is refused leaves too, with the bad rows
that it was grown for set aside, so that other kinds of bad rows still get rules. The list is then an
ordered Spark conditional expression applied to all rows. Rules only reject, and must be precise, so
unusual but clean documents stay.

The learner reads at most `sample_rows` labelled rows (those with the smallest id hashes).

Defined cases: a null text has no words; a document without words fails the base rule; long texts are
read whole; rows that repeat a doc_id, or have none, are documents of their own, and all that repeat a
labelled one bear its label; without usable labels the list is empty and only the base rules reject;
labels that disagree about a document count as their mean (0.5 and above is good); of rules that both
hold the first counts, of equal gains the first feature and threshold; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, in_sample, slices

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines")
#: What rules may test, as expressions over the counts.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_ratio": "n_symbols / greatest(n_words, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
    "upper_ratio": "n_upper / greatest(word_chars, 1)",
}


def repeated_words(words: list[list[bytes]], window: int = WINDOW) -> np.ndarray:
    """For each document, how many of its words lie in a window that it holds at least twice."""
    sizes = np.array([len(w) for w in words], np.int64)
    total = int(sizes.sum())
    if not total:
        return np.zeros(len(words), np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    h = np.fromiter((hash(x) for w in words for x in w), np.int64, total).view(np.uint64)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(total)  # words from here to the document's end
    starts = np.flatnonzero(left >= window)
    if not len(starts):
        return np.zeros(len(words), np.int64)
    key = owner[starts].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(window):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[starts + j]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(starts), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(total + 1, np.int64)
    np.add.at(step, starts[twice], 1)
    np.add.at(step, starts[twice] + window, -1)
    return np.bincount(owner, weights=np.cumsum(step)[:-1] > 0, minlength=len(words)).astype(np.int64)


def _count(texts: list[str]) -> list[list[int]]:
    raw = [t.encode() for t in texts]
    words = [b.split() for b in raw]  # bytes.split() splits at exactly [\x20\x09-\x0D]
    rows = []
    for text, data, own, repeats in zip(texts, raw, words, repeated_words(words), strict=True):
        lines = [x for x in data.split(b"\n") if x.strip()]
        blanks = len(data) - len(data.translate(None, BLANKS))
        rows.append([len(own), len(text) - blanks, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), int(repeats), len(data) - len(data.translate(None, UPPER)), len(lines)])
    return rows


def statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and the counts of every whole text."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = np.array(_count([t or "" for t in batch.column(1).to_pylist()]), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, i]) for i in range(len(COUNTS)))], names=["doc_id", *COUNTS])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def sql(self) -> str:
        return f"({FEATURES[self.feature]} {'>' if self.above else '<='} {self.threshold!r}D)"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray], rows: int) -> np.ndarray:
    out = np.ones(rows, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def thresholds(values: np.ndarray, bad: np.ndarray, most: int = 41) -> np.ndarray:
    """Places between the values that occur, on either side of quantiles of the bad rows' values."""
    distinct = np.unique(values)
    between = (distinct[1:] + distinct[:-1]) / 2
    at = np.searchsorted(between, np.unique(np.quantile(values[bad], np.linspace(0, 1, most))))
    near = np.unique(np.concatenate([at - 1, at]))
    return between[near[(near >= 0) & (near < len(between))]]


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < most and (inside & ~bad).any():
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        if not p:
            break
        base, best = np.log2(p / (p + n)), (1e-9, None)
        for name, values in x.items():
            own, wrong = values[inside], bad[inside]
            for t in thresholds(own, wrong).tolist():
                over = own > t
                for above, held in ((True, over), (False, ~over)):
                    p1, n1 = (held & wrong).sum(), (held & ~wrong).sum()
                    if p1 and (gain := p1 * (np.log2(p1 / (p1 + n1)) - base)) > best[0]:
                        best = (gain, Condition(name, above, t))
        if best[1] is None:
            break
        rule += (best[1],)
        inside &= best[1].holds(x)
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, held_out: np.ndarray, precision: float = 0.97, least: int = 2, most_rules: int = 12, most_conditions: int = 4, most_tries: int = 40) -> list[Rule]:
    """Sequential covering: each rule is grown on the rows not held out and pruned on those held out; it must hit `least` held-out bad rows and be precise on both parts."""
    left, wanted, rules = np.ones(len(bad), bool), bad.copy(), []
    part = lambda rows: {f: v[rows] for f, v in x.items()}
    for _ in range(most_tries):
        if len(rules) == most_rules or not (left & wanted & ~held_out).any():
            break
        own = left & ~held_out & (wanted | ~bad)  # bad rows that have been set aside neither help nor hurt
        grown = _grow(part(own), bad[own], most_conditions)
        if not grown:
            break
        tested, b = part(left & held_out), bad[left & held_out]

        def judged(rule: Rule, tested=tested, b=b) -> tuple[int, int]:
            c = covers(rule, tested, len(b))
            return int((c & b).sum()), int((c & ~b).sum())

        def worth(rule: Rule, judged=judged) -> float:
            hits, wrong = judged(rule)
            return (hits - wrong) / max(1, hits + wrong)

        rule = max((grown[:k] for k in range(len(grown), 0, -1)), key=worth)
        hits, wrong = judged(rule)
        covered = covers(rule, x, len(bad))
        seen = covered & left & ~held_out
        fine = hits >= least and hits >= precision * (hits + wrong) and (seen & bad).sum() >= precision * seen.sum()
        if fine:
            rules.append(rule)
            left &= ~covered
        else:
            aside = covers(grown, x, len(bad)) & ~held_out
            if not (aside & wanted).any():
                break
            wanted &= ~aside
    return rules


def sample(counts: DataFrame, labels: DataFrame, sample_rows: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Features, badness and the held-out third of at most sample_rows labelled documents that pass the base rule."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    few = in_sample("doc_id", sample_rows, marks.count())
    joined = counts.where(few).where(~base_failed()).join(marks.where(few), "doc_id").withColumn("h", F.xxhash64("doc_id"))
    rows = joined.orderBy("h", "doc_id").limit(sample_rows).select("h", "quality", *(F.expr(e).alias(f) for f, e in FEATURES.items())).toPandas()
    return {f: rows[f].to_numpy(np.float64) for f in FEATURES}, rows["quality"].to_numpy(np.float64) < 0.5, rows["h"].to_numpy(np.int64) % 3 == 0


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression: 0 for no rule, else the first rule that rejects."""
    if not rules:
        return F.lit(0)
    sql = "case " + " ".join(f"when {' and '.join(c.sql() for c in rule)} then {i}" for i, rule in enumerate(rules, 1)) + " else 0 end"
    return F.expr(sql)


def base_failed() -> Column:
    return F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")


def apply_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> DataFrame:
    """doc_id, the counts, base_failed, rule (the first that rejects, or 0), kept: one row per document."""
    counts = cut(statistics(docs), "rules-statistics")
    rules = learn(*sample(counts, labels, sample_rows))
    return counts.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules)).withColumn("kept", F.expr("not base_failed and rule = 0"))
