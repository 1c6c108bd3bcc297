"""Quality classifier by co-training two views of a document.

One logistic model sees the text: its words, their endings and how it is laid out, in steps. The other
sees the page's metadata alone: language, source and stored length, and their combinations. Both are
fitted on labelled rows and calibrated on labelled rows that were held out. In each round Spark scores
all documents with both; what one view is sure of (a calibrated score beyond SURE, and well beyond the
share of good documents) is a pseudo-label for the other, and the tasks count, for each view, in how
many documents that the other has labelled either way each feature occurs. From these sums, which are
of fixed size whatever the corpus, each view takes the log-odds of its features as one more input and
is fitted and calibrated again. The calibrated views are then combined on the held-out rows, and the
threshold is the highest, 0.5 at most, at which nine of ten held-out documents that fall are bad.

Fitting reads at most `labelled_rows` labelled documents (those with the smallest id hashes) with at
most FEATURES_KEPT features in all; rounds and scoring read every document.

Defined cases: null texts, languages and sources count as empty, as do such columns where they are
missing; labels that disagree about a document count as their mean; null labels are left out; of rows
that repeat a labelled doc_id one (that with the least text hash) is fitted, and all are scored; long
texts are read whole; documents with equal views get equal scores, and a score at the threshold stays;
without labels of both classes all documents score 0.5 and stay; an empty table gives an empty result;
scoring carries all columns, and names its own with underscores where they clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from .common import cut, free_name, in_sample, slices, tidy

DIM = 1 << 16
WORDS = DIM - 1024  # places of layout steps follow those of words
LABELLED_ROWS, FEATURES_KEPT = 8_000, 8_000_000
ROUNDS, SURE, LAYOUT = 2, 0.9, 1.5
SYMBOLS, UPPER, DIGITS = b"#*$%&|<>=_{}\\^~", bytes(range(65, 91)), bytes(range(48, 58))


def _hashed(steps: dict[str, object], first: int, places: int) -> set[int]:
    return {first + crc32(f"{k}:{v}".encode("utf-8", "surrogatepass")) % places for k, v in steps.items()}


def text_features(text: str) -> np.ndarray:
    """Hashed features of the text: the words present, their last characters, and layout ratios in steps."""
    raw = text.encode()
    low = raw.lower()  # A-Z; other letters stay
    every = low.split()
    words = set(every)
    found = {crc32(w) % WORDS for w in words}
    found.update(crc32(tail, 7) % WORDS for tail in {w[-3:] for w in words})
    size, n = max(1, len(raw)), max(1, len(every))
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    found |= _hashed(
        {
            "word": min(40, int(2 * (size / n))),
            "symbols": min(20, int(50 * share(SYMBOLS) + 0.999)),
            "upper": min(10, int(20 * share(UPPER))),
            "digits": min(10, int(40 * share(DIGITS))),
            "marks": min(10, int(50 * share(b"!"))),
            "distinct": int(10 * len(words) / n),
            "lines": min(12, int(60 * share(b"\n"))),
        },
        WORDS,
        DIM - WORDS,
    )
    return np.fromiter(found, np.int32, len(found))


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Hashed features of what is stored about the page; nothing of its text."""
    length = "" if n_chars is None else int(2 * math.log2(1 + max(0, n_chars)))
    lang, source = lang or "", source or ""
    return np.array(sorted(_hashed({"lang": lang, "source": source, "length": length, "both": f"{lang} {source}", "size": f"{source} {length}"}, 0, WORDS)), np.int32)


@dataclass
class Rows:
    """Sparse binary rows; words and the like are scaled to length one together, so many do not drown the layout steps."""

    at: np.ndarray
    index: np.ndarray

    @cached_property
    def value(self) -> np.ndarray:
        if not len(self):
            return np.empty(0)
        words = self.index < WORDS
        n = np.add.reduceat(words, self.at[:-1], dtype=np.int64)
        return np.where(words, np.repeat(1 / np.sqrt(np.maximum(1, n)), np.diff(self.at)), LAYOUT)

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> Rows:
        rows = [r if len(r) else np.zeros(1, np.int32) for r in rows]
        return cls(np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64), np.concatenate(rows) if rows else np.empty(0, np.int32))

    def __len__(self) -> int:
        return len(self.at) - 1

    def take(self, which: np.ndarray) -> Rows:
        return Rows.of([self.index[self.at[i] : self.at[i + 1]] for i in which])

    def logits(self, w: np.ndarray) -> np.ndarray:
        if not len(self):
            return np.empty(0)
        return np.add.reduceat(w[self.index] * self.value, self.at[:-1]) + w[DIM]


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: Rows, y: np.ndarray, odds: np.ndarray | None = None, steps: int = 60, rate: float = 0.5, shrink: float = 1e-5) -> np.ndarray:
    """Logistic regression, classes weighted alike, by adaptive full-batch gradient steps; the features' log-odds, summed up, are one more input."""
    odds = np.zeros(DIM + 1) if odds is None else np.append(odds, 0.0)
    w, past = np.zeros(DIM + 2), np.full(DIM + 2, 1e-8)
    weight = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum()))
    sizes, told = np.diff(x.at), x.logits(odds)
    for _ in range(steps):
        err = (sigmoid(x.logits(w[:-1]) + w[-1] * told) - y) * weight
        grad = np.append(np.bincount(x.index, np.repeat(err, sizes) * x.value, DIM), [err.sum(), (err * told).sum()]) + shrink * w
        past += grad * grad
        w -= rate * grad / np.sqrt(past)
    return w[:-1] + w[-1] * odds


def platt(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (and a constant) of a logistic fit of y on the columns of z, by damped Newton steps."""
    a = np.column_stack([z, np.ones(len(y))])
    b = np.zeros(a.shape[1])
    for _ in range(25):
        p = sigmoid(a @ b)
        b += np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + 1e-2 * np.eye(len(b)), a.T @ (y - p) - 1e-2 * b)
    return b


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    text_scale: np.ndarray
    meta_scale: np.ndarray
    mix: np.ndarray
    threshold: float

    def score(self, text: Rows, meta: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of a good document by either view and by both."""
        zt = self.text_scale[0] * text.logits(self.text) + self.text_scale[1]
        zm = self.meta_scale[0] * meta.logits(self.meta) + self.meta_scale[1]
        return sigmoid(zt), sigmoid(zm), sigmoid(self.mix[0] * zt + self.mix[1] * zm + self.mix[2])


def sure_labels(p: np.ndarray, prior: float, sure: float = SURE) -> np.ndarray:
    """1 for surely good, 0 for surely bad, -1 for neither: beyond `sure`, and with odds that much beyond those of all documents."""
    lift = np.log(np.clip(p, 1e-9, 1 - 1e-9) / np.clip(1 - p, 1e-9, 1)) - math.log(prior / (1 - prior))
    least = math.log(sure / (1 - sure))
    return np.where((p >= sure) & (lift >= least), 1, np.where((p <= 1 - sure) & (lift <= -least), 0, -1))


def label_sums(docs: DataFrame, model: Model, prior: float) -> np.ndarray:
    """[view, label, feature]: in how many of the documents that the other view is sure of the feature occurs; the last feature counts the documents."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # weight vectors of fixed size

    def run(batches):
        model, sums = shared.value, np.zeros((2, 2, DIM + 1), np.int64)
        for batch in batches:
            for views in view_rows(batch, 0):
                p = model.score(*views)
                for v in (0, 1):
                    labels = sure_labels(p[1 - v], prior)
                    for label in (0, 1):
                        rows = views[v].take(np.flatnonzero(labels == label))
                        if len(rows):
                            sums[v, label] += np.append(np.bincount(rows.index, minlength=DIM), len(rows))
        found = np.flatnonzero(sums.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(sums.ravel()[found])], names=["at", "n"])

    counted = docs.select("text", "lang", "source", "n_chars").mapInArrow(tidy(run), "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n"))
    out, table = np.zeros((2, 2, DIM + 1), np.int64), counted.toArrow()  # at most 4 (DIM + 1) rows
    out.ravel()[np.asarray(table.column("at"))] = np.asarray(table.column("n"))
    return out


def log_odds(sums: np.ndarray) -> np.ndarray | None:
    """Of each feature, between the documents labelled good and bad; None unless there are both."""
    if not sums[:, -1].all():
        return None
    share = (sums[:, :-1] + 1) / (sums[:, -1:] + 2)
    return np.log(share[1]) - np.log(share[0])


def cut_point(scores: np.ndarray, good: np.ndarray, precision: float = 0.9) -> float:
    """The highest cut, 0.5 at most, below which at least that share of the held-out rows is bad; where there is none, nothing is cut."""
    order = np.argsort(scores, kind="stable")
    s, right = scores[order], np.cumsum(~good[order]) / np.arange(1, len(scores) + 1)
    cuts = np.append(np.unique(s[s < 0.5]), 0.5)
    below = np.searchsorted(s, cuts)  # rows that fall
    fits = (below > 0) & (right[below - 1] >= precision)
    return float(cuts[fits][-1]) if fits.any() else 0.0


def view_rows(batch, first: int):
    """Of slices of a batch with text, lang, source and n_chars from column `first` on: the rows of both views."""
    for own in slices(batch, batch.schema.names[first]):
        texts, *more = (own.column(first + i).to_pylist() for i in range(4))
        yield Rows.of([text_features(t or "") for t in texts]), Rows.of([meta_features(*x) for x in zip(*more, strict=True)])


def viewed(docs: DataFrame) -> DataFrame:
    """docs with text, lang, source and n_chars as they are stored, null where there is no such column."""
    has = {c.lower() for c in docs.columns}
    kinds = {"text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
    own = [(F.col(c) if c in has else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()]
    return docs.select("doc_id", *own)


def labelled(docs: DataFrame, labels: DataFrame, labelled_rows: int) -> tuple[list[Rows], np.ndarray]:
    """Both views' rows and the goodness of a bounded number of labelled documents, in an order that ids alone decide."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
    marks = cut(marks, "classifier-marks")
    few = in_sample("doc_id", labelled_rows, marks.count())
    ids = docs.select("doc_id").where(few).distinct()
    known = ids.join(marks.where(few), "doc_id").withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(labelled_rows)
    own = docs.join(F.broadcast(known), "doc_id")  # at most labelled_rows rows
    one = own.groupBy("doc_id", "h", "good").agg(F.min_by(F.struct("text", "lang", "source", "n_chars"), F.xxhash64("text", "lang", "source", "n_chars")).alias("d"))

    def run(batches):
        for batch in batches:
            done = 0
            for views in view_rows(batch, 3):
                n = len(views[0])
                lists = [pa.ListArray.from_arrays(pa.array(v.at.astype(np.int32)), pa.array(v.index)) for v in views]
                sizes = pa.array(np.diff(views[0].at))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(done, n) for i in range(3)), sizes, *lists], names=["doc_id", "h", "good", "n", "a", "b"])
                done += n

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = cut(one.select("doc_id", "h", "good", "d.*").mapInArrow(tidy(run), f"doc_id {kind}, h bigint, good boolean, n bigint, a array<int>, b array<int>"), "classifier-labelled")
    order = rows.select("doc_id", "h", "n").toPandas().sort_values(["h", "doc_id"])
    kept = order["h"][order["n"].cumsum() <= FEATURES_KEPT]
    if not len(kept):
        return [Rows.of([]), Rows.of([])], np.empty(0, bool)
    table = rows.where(F.col("h") <= int(kept.iloc[-1])).orderBy("h", "doc_id").select("good", "a", "b").toArrow()
    views = [Rows.of([np.asarray(x.values) for x in table.column(c)]) for c in ("a", "b")]
    return views, np.array(table.column("good").to_pylist(), bool)


def calibrated(weights: list[np.ndarray], held: list[Rows], good: np.ndarray) -> Model:
    y = good.astype(float)
    z = [x.logits(w) for x, w in zip(held, weights, strict=True)]
    scale = [platt(v[:, None], y) for v in z]
    mix = platt(np.column_stack([s[0] * v + s[1] for s, v in zip(scale, z, strict=True)]), y)
    return Model(*weights, *scale, mix, 0.5)


def train(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, rounds: int = ROUNDS, precision: float = 0.9) -> Model | None:
    """The model, or None without labels of both classes."""
    docs = viewed(docs)
    views, y = labelled(docs, labels, labelled_rows)
    test = np.zeros(len(y), bool)
    for good in (True, False):
        test[np.flatnonzero(y == good)[::4]] = True  # a fourth of either class is held out
    if any(not part.any() or part.all() for part in (y[test], y[~test])):
        return None
    fitted, held = ([v.take(np.flatnonzero(part)) for v in views] for part in (~test, test))
    model = calibrated([fit(x, y[~test]) for x in fitted], held, y[test])
    for _ in range(rounds):
        sums = label_sums(docs, model, float(np.clip(y[~test].mean(), 0.01, 0.99)))
        model = calibrated([fit(x, y[~test], log_odds(sums[v])) for v, x in enumerate(fitted)], held, y[test])
    model.threshold = cut_point(model.score(*held)[2], y[test], precision)
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with p_text, p_meta, score and keep; names that clash get underscores. One row per document."""
    names = [free_name(docs.columns, c) for c in ("p_text", "p_meta", "score", "keep")]
    if model is None:
        return docs.withColumns({c: F.lit(0.5) for c in names[:3]} | {names[3]: F.lit(True)})
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two weight vectors of fixed size
    has = {c.lower(): c for c in docs.columns}
    at = [docs.columns.index(has[c]) if c in has else None for c in ("text", "lang", "source", "n_chars")]

    def run(batches):
        model = shared.value
        for whole in batches:
            for batch in slices(whole, whole.schema.names[at[0]]):
                own = [pa.nulls(batch.num_rows) if i is None else batch.column(i) for i in at]
                texts, *more = (c.to_pylist() for c in own)
                p = model.score(Rows.of([text_features(t or "") for t in texts]), Rows.of([meta_features(*x) for x in zip(*more, strict=True)]))
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, p), pa.array(p[2] >= model.threshold)], names=[*batch.schema.names, *names])

    added = [*(StructField(c, DoubleType()) for c in names[:3]), StructField(names[3], BooleanType())]
    return docs.mapInArrow(tidy(run), StructType([*docs.schema.fields, *added]))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return score(docs, train(docs, labels, **options))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the classifier keeps, with their columns."""
    scored = classify(docs, labels, **options)
    return scored.where(F.col(scored.columns[-1])).select(*docs.columns)
