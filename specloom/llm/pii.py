"""Personal data: exact patterns for seeds, then bootstrapped contextual extraction over the corpus.

Every whole text is read once for its base spans (e-mail, IP, card, phone) and for candidates: other
tokens that may be identifiers (with a digit and LEAST_CHARS characters, or an @ inside), and runs of
neighbouring tokens with 6 to 19 digits in all. Both carry the lexical patterns around them (the two
whole words before; the word before with the word after). Base values are the seeds. Spark then
scores the graph of patterns and distinct values in turns: a pattern's score for a kind is the score
of its values divided by their number (smoothed), a value's score is the chance that not all of its
patterns are wrong. Values that are confident after a turn join the seeds: they support patterns that
no seed stands in, which name further values in the next turn, and so on until a turn changes
nothing. Candidates whose best pattern is both supported and confident are then spans of that
pattern's kind. Base spans stay as they are.

Only candidates enter the graph, as (pattern, value) rows; texts do not shuffle, but for those whose
documents got spans that way (`redact`; a Bloom filter lets the others pass).
Defined cases: a null text counts as empty; rows that repeat a doc_id are documents of their own, and
their equal values count once in the graph; a value that is found as several kinds counts for each;
of kinds with equal scores the later one of KINDS wins; long texts and words are read whole (words of
over 64 characters stand in patterns by their hash); an empty table gives an empty result; further
columns are ignored or, by `redact`, carried. Documents are read once and stored with their spans
(by `redact` with all their columns), so rows keep their identity.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import bloom
from .common import by_shuffle, cut, free_name, slices, tidy

KINDS = ("email", "ip", "card", "phone")
# Possessive forms of the contract's patterns that start only where a leftmost match can: no start is tried twice.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A token that may be an identifier once blanks are around it.
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = "\"'.,;:!?()[]{}<>#*$%&|="
LEAST_CHARS, LEAST_DIGITS = 4, 6  # of a token with a digit; of the digits of a run
#: A run of tokens ends after one of these, and one of more digits than any card's is a table's numbers.
STOPS, MOST_DIGITS = ".,;:!?", 19

#: Turns end when nothing changes; MOST_TURNS bounds how far from a seed a pattern may be found.
MOST_TURNS, SUPPORT, CONFIDENT, PRIOR = 10, 5, 0.8, 1.0
NEAR, LONG_WORD = 80, 64


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: before an @ stands the run of local characters, as far back as the last match allows."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def is_octet(part: str) -> bool:
    value = part.lstrip("0")
    return len(value) <= 3 and int(value or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), in that order: leftmost matches of each kind, failing ones dropped."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(is_octet, m[0].split(".")))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return sorted(found)


def _plain(word: str) -> str:
    word = word.strip(EDGE).lower()
    return word if len(word) <= LONG_WORD else "#" + blake2b(word.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def _words_before(text: str, at: int) -> list[str]:
    """The last two words before a place, whole."""
    near = NEAR
    while True:
        start = max(0, at - near)
        words = TOKEN.findall(text, start, at)
        if start == 0 or len(words) > 2:  # of more than two, the last two began within the piece
            return [_plain(w) for w in words[-2:]]
        near *= 4


def _word_after(text: str, at: int) -> str:
    """The first word after a place, whole."""
    found = TOKEN.search(text, at)
    return _plain(found[0]) if found else ""


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a span; none where too little stands around it."""
    before = _words_before(text, start)
    out = []
    if len(before) == 2 and all(before):
        out.append(f"{before[0]} {before[1]} _")
    after = _word_after(text, end)
    if before and before[-1] and after:
        out.append(f"{before[-1]} _ {after}")
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Tokens that may be identifiers (with a digit and characters enough, or an @ inside), and runs of neighbouring tokens with digits; none touches a base span."""
    if not DIGIT.search(text) and "@" not in text:
        return []
    taken = sorted((a, b) for a, _, b in base)
    out, run, k = [], [], 0  # run: start, end and digits of each token of the run so far

    def whole_run() -> list[tuple[int, int]]:
        a, b, digits = run[0][0], run[-1][1], sum(n for _, _, n in run)
        run_found = len(run) > 1 and LEAST_DIGITS <= digits <= MOST_DIGITS
        a -= run_found and text[a - 1 : a] == "(" and ")" in text[a:b]
        return [(a, b)] if run_found else []

    for m in TOKEN.finditer(text):
        token = m[0]
        digits = len(DIGIT.findall(token))
        if digits or "@" in token[1:-1]:
            a = m.start() + len(token) - len(token.lstrip(EDGE))
            b = m.start() + len(token.rstrip(EDGE))
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            free = a < b and not any(s < b and a < e for s, e in taken[k : k + 8])
            if free and (digits and b - a >= LEAST_CHARS or "@" in token[1:-1]):
                out.append((a, b))
            if free and digits:
                run.append((a, b, digits))
                if token[-1] not in STOPS:
                    continue
        if run:
            out += whole_run()
            run.clear()
    return out + (whole_run() if run else [])


SPAN = "struct<start:int,kind:int,end:int>"
MENTION = "struct<start:int,end:int,kind:int,value:string,patterns:array<string>>"


def mentions(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, row (as read), base (spans) and mentions: base values (with kind) and candidates (without), with their patterns; with carry also doc, all columns as they are."""
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    mention = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))])

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                base, around = [], []
                for text in batch.column(2).to_pylist():
                    own = base_spans(text or "")
                    base.append([{"start": a, "kind": k, "end": b} for a, k, b in own])
                    both = [(a, b, k) for a, k, b in own] + [(a, b, None) for a, b in candidates(text or "", own)]
                    around.append([{"start": a, "end": b, "kind": k, "value": text[a:b].lower(), "patterns": p} for a, b, k in both if (p := patterns(text, a, b))])
                columns = [batch.column(0), batch.column(1), pa.array(base, pa.list_(span)), pa.array(around, pa.list_(mention)), *batch.columns[3:]]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "base", "mentions", *batch.schema.names[3:]])

    whole = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")] if carry else []
    rows = docs.select(F.col(id_column).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_column).alias("text"), *whole)
    own = StructType.fromDDL(f"base array<{SPAN}>, mentions array<{MENTION}>")
    return rows.mapInArrow(tidy(run), StructType([rows.schema["doc_id"], rows.schema["row"], *own.fields, *rows.schema.fields[3:]]))


def confident_patterns(seen: DataFrame, most_turns: int = MOST_TURNS, support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """(pattern, kind, score) of the patterns that may name new values; seen has mentions."""
    each = seen.select(F.explode("mentions").alias("m")).select(F.explode("m.patterns").alias("pattern"), "m.value", "m.kind")
    graph = cut(each.distinct(), "pii-graph")  # partial distinct first: hot values fold before they shuffle
    sizes = cut(graph.select("pattern", "value").distinct().groupBy("pattern").agg(F.count(F.lit(1)).alias("n")), "pii-sizes")
    seeds = cut(graph.where("kind is not null").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds")), "pii-seeds")
    edges = graph.where("kind is null").select("pattern", "value")

    def score(known: DataFrame, gained: Column) -> DataFrame:
        """Scores of the patterns that enough values support; known has pattern, kind, seeds. Rounded, so that no order of sums decides."""
        value = F.round((F.coalesce("seeds", F.lit(0)) + gained) / (F.col("n") + PRIOR), 9)
        return cut(known.join(by_shuffle(sizes), "pattern").select("pattern", "kind", value.alias("score")), "pii-scores")

    scored, before = score(seeds.where(f"seeds >= {support}"), F.lit(0.0)), None
    for _ in range(most_turns):
        now = scored.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("pattern", "kind", F.round("score", 6)))).first()
        if now == before or not now[0]:
            break
        before = now
        wrong = F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("score"))))
        values = edges.join(by_shuffle(scored), "pattern").groupBy("value", "kind").agg(F.round(1 - F.exp(wrong), 9).alias("value_score"))
        # any pattern gains from the values found so far, and those that are sure support it as seeds do
        sure = F.count_if(F.col("value_score") >= confident).alias("sure")
        gained = edges.join(by_shuffle(values), "value").groupBy("pattern", "kind").agg(F.sum("value_score").alias("gained"), sure)
        known = seeds.join(by_shuffle(gained), ["pattern", "kind"], "full").where(f"coalesce(seeds, 0) + coalesce(sure, 0) >= {support}")
        scored = score(known, F.coalesce("gained", F.lit(0.0)))
    best = scored.where(f"score >= {confident}").groupBy("pattern").agg(F.max(F.struct("score", "kind")).alias("b"))
    return best.select("pattern", "b.kind", "b.score")


class PersonalData:
    def __init__(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: bool = False, **options):
        self.docs, self.text_column = docs, text_column
        self.seen = cut(mentions(docs, id_column, text_column, carry), "pii-mentions")
        rules = cut(confident_patterns(self.seen, **options), "pii-confident")
        new = self.seen.select("row", F.explode("mentions").alias("m")).where("m.kind is null")
        found = new.select("row", "m.start", "m.end", F.explode("m.patterns").alias("pattern")).join(rules, "pattern")
        found = found.groupBy("row", "start", "end").agg(F.max(F.struct("score", "kind")).alias("b"))
        self.added = cut(found.groupBy("row").agg(F.collect_list(F.struct("start", "b.kind", "end")).alias("added")), "pii-added")  # of one document

    def spans(self, *more: str) -> DataFrame:
        """doc_id, row, base and spans (base and added): arrays of (start, kind, end) in that order. Rows without added spans do not shuffle."""
        rows = self.seen.select("doc_id", "row", "base", *more)
        clear, maybe = bloom.split(rows, "row", self.added)
        none = F.expr(f"cast(array() as array<{SPAN}>)")
        both = F.array_sort(F.concat("base", F.coalesce(F.col("added").cast(f"array<{SPAN}>"), none)))
        joined = maybe.join(by_shuffle(self.added), "row", "left").withColumn("spans", both)
        return clear.withColumn("spans", F.array_sort("base")).unionByName(joined.select(*rows.columns, "spans"))

    def redact(self, mask: str = "<{}>") -> DataFrame:
        """The documents (with carry), each span, merged where spans overlap, replaced by its first kind's mask; n_chars follows the text."""
        columns, text_column = self.docs.columns, self.text_column
        spans = free_name(columns, "_spans")
        at = columns.index(text_column)
        joined = self.spans("doc").select("doc.*", F.col("spans").alias(spans))

        def run(batches):
            for whole in batches:
                for batch in slices(whole, text_column):
                    texts = [t if not s else masked(t, [(x["start"], x["kind"], x["end"]) for x in s], mask) for t, s in zip(batch.column(at).to_pylist(), batch.column(spans).to_pylist(), strict=True)]
                    out = [*batch.columns[:-1]]
                    out[at] = pa.array(texts, pa.string())
                    yield pa.RecordBatch.from_arrays(out, names=columns)

        out = joined.mapInArrow(tidy(run), self.docs.schema)
        return out.withColumn("n_chars", F.char_length(F.col(text_column)).cast(self.docs.schema["n_chars"].dataType)) if "n_chars" in columns else out


def redact(docs: DataFrame, **options) -> DataFrame:
    return PersonalData(docs, carry=True, **options).redact()


def masked(text: str, spans: list[tuple[int, int, int]], mask: str = "<{}>") -> str:
    out, at, upto = [], 0, -1
    for start, kind, end in sorted(spans):
        if start >= upto:
            out += [text[at:start], mask.format(KINDS[kind].upper())]
        upto = max(upto, end)
        at = upto
    return "".join([*out, text[at:]])


def _joined(column: str):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: counts and hash of its base spans, and all spans as text."""
    found = PersonalData(docs, **options).spans()
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as bigint)").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
