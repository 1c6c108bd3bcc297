"""Phrase collocations: counts in tries of hash containers that burst and spill, scored exactly.

Texts are encoded once: a stored row holds some hundred thousand word numbers of one language, with
the words that they stand for. Phrases are then counted length by length. A phrase of k words can
reach the threshold only if both its parts of k - 1 words do, so positions are first looked up in a
bitmap of the frequent shorter phrases; false hits cost a count and change none.

A task counts in a trie over the digits of a phrase's word numbers, whose leaves are hash containers; one
that grows beyond `BURST` entries bursts into a node with a container for each next digit. Containers are
arrays and not Python dicts, whose small ones below second words took several times the room of their entries. At
`most_entries` the largest subtrees leave as runs, until half of the room is free; so memory is bounded
whatever the text. Runs go into the shuffle as they leave, dealt by phrase, and are summed there: a phrase
is in a run once, so that no group has more rows than there were runs.

Defined cases: a null text has no words, a null language is `und`; only A-Z is lowered; long texts are
encoded in segments cut between words, whose phrases are counted across the cut; ties go by phrase in
the order of its UTF-8 bytes; rows that repeat count again; an empty table gives an empty result;
columns other than those named are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bloom import CHUNK_BITS, bits_for
from .common import cut, tidy

LEAST, LONGEST, OVERLAP, TOP = 10, 3, 50, 2000
CHUNK_WORDS = 1 << 19  # word numbers of a stored row
SEGMENT = 2 << 20  # bytes that are split into words at once
BURST, MOST_ENTRIES, MOST_WORDS = 4096, 1_000_000, 1_000_000
WORD_BITS, DIGIT = 21, 3  # of a word number, three of which fit into a long, and of a level of the trie
FREE = np.int64(-1)  # a place of a container without a key
BREAK = 0  # stands between pieces
# The characters that end a piece become full stops, which no word can hold then; tabs become spaces. A-Z is lowered.
PLAIN = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t" + bytes(range(65, 91)), b"." * 9 + b" " + bytes(range(97, 123)))
MIX = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Numbers of words, from 1; 0 is the break."""

    def __init__(self):
        super().__init__({b".": BREAK})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _segments(text: bytes) -> Iterator[bytes]:
    """The text (with plain separators) in parts that end between words."""
    at = 0
    while len(text) - at > SEGMENT:
        end = 1 + max(text.rfind(b" ", at, at + SEGMENT), text.rfind(b".", at, at + SEGMENT))
        if end <= at:  # one long word: up to its end
            ends = [e for e in (text.find(b" ", at + SEGMENT), text.find(b".", at + SEGMENT)) if e >= 0]
            end = min(ends) if ends else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


class _Chunk:
    """Word numbers of a language that a task has read; the first `context` ones belong to the row before."""

    def __init__(self, carried: list[bytes] = ()):
        self.words = Words()
        self.parts = [np.array([self.words[w] for w in carried], np.int32)]
        self.context = self.n = len(carried)

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.n += len(ids)

    def row(self, lang: str, keep: int) -> tuple[pa.RecordBatch, list[bytes]]:
        """The chunk as a row, and its last `keep` words."""
        ids, spelt = np.concatenate(self.parts), list(self.words)
        counts = np.bincount(ids[self.context :], minlength=len(spelt))[1:]
        values = {"lang": [lang], "ids": [ids.tobytes()], "context": [self.context], "words": [spelt[1:]], "counts": [counts]}
        return pa.RecordBatch.from_pydict(values, ENCODED), [spelt[i] for i in ids[max(0, len(ids) - keep) :]]


ENCODED = pa.schema([("lang", pa.string()), ("ids", pa.binary()), ("context", pa.int32()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64()))])


def encode(docs: DataFrame, longest: int = LONGEST, lang_column: str = "lang", text_column: str = "text", chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """lang, ids (int32, 0 between pieces), context, words and their counts: a row for some chunk_words words of a language in a task.

    The first `context` ids repeat the end of the row before: phrases that end beyond them are this row's."""

    def run(batches):
        held: dict[str, _Chunk] = {}
        for batch in batches:
            for lang, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_buffer().to_pybytes().translate(PLAIN)
                for part in _segments(text):
                    chunk = held.setdefault(lang, _Chunk())
                    chunk.add(np.fromiter(map(chunk.words.__getitem__, part.replace(b".", b" . ").split()), np.int32))
                    if chunk.n >= chunk_words:
                        row, end = chunk.row(lang, longest - 1)
                        yield row
                        held[lang] = _Chunk(end)
                held[lang].add(np.zeros(1, np.int32))
        for lang, chunk in held.items():
            yield chunk.row(lang, 0)[0]

    rows = docs.select(F.coalesce(lang_column, F.lit("und")).alias("lang"), F.coalesce(text_column, F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(tidy(run), "lang string, ids binary, context int, words array<binary>, counts array<bigint>")


def _word_hashes(words: pa.Array) -> np.ndarray:
    """A number for each word, the same in every task; 0 for the break before them."""
    from xxhash import xxh64_intdigest

    return np.fromiter((0, *map(xxh64_intdigest, words.to_pylist())), np.uint64, len(words) + 1)


def _language_hash(lang: str) -> np.uint64:
    from xxhash import xxh64_intdigest

    return np.uint64(xxh64_intdigest(lang.encode()))


def _phrase_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A number for each run of k word hashes."""
    out = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    for i in range(k):
        out = (out ^ (out >> np.uint64(29))) * MIX + hashes[i : len(hashes) - k + 1 + i]
    return out ^ (out >> np.uint64(32))


class Bitmap:
    """A Bloom filter of at most 2^28 bits, for the tasks of one count: it is broadcast, and destroyed when that is done."""

    def __init__(self, frequent: DataFrame):
        def run(batches):
            for batch in batches:
                keys = [_phrase_hashes(_word_hashes(pa.array(p.split(b" ")))[1:], len(p.split(b" ")))[0] ^ _language_hash(g) for g, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64))], names=["key"])

        self.bits = bits_for(frequent.count())
        keys = frequent.select("lang", F.col("phrase").cast("binary").alias("phrase")).mapInArrow(run, "key bigint")
        slots = keys.select(F.explode(F.array(F.expr(f"key & {self.bits - 1}L"), F.expr(f"shiftrightunsigned(key, 32) & {self.bits - 1}L"))).alias("slot"))
        chunks = slots.groupBy(F.expr(f"slot div {CHUNK_BITS}").alias("chunk")).agg(F.expr(f"bitmap_construct_agg(slot % {CHUNK_BITS})").alias("bits"))
        data = bytearray(self.bits // 8)
        for chunk, bits in chunks.toLocalIterator():  # at most 2^28 bits, whatever the tables
            data[chunk * CHUNK_BITS // 8 : (chunk + 1) * CHUNK_BITS // 8] = bits
        self.data = frequent.sparkSession.sparkContext.broadcast(bytes(data))

    @staticmethod
    def holds(data: np.ndarray, keys: np.ndarray) -> np.ndarray:
        mask = np.uint64(8 * len(data) - 1)
        found = np.ones(len(keys), bool)
        for slot in (keys & mask, (keys >> np.uint64(32)) & mask):
            found &= (data[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return found


class Container:
    """Counts by key: a hash table of open addressing in two arrays, at most half full."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.n, self.keys, self.counts = 0, np.full(8, FREE, np.int64), np.zeros(8, np.int64)
        self.add(keys, counts)

    def __len__(self) -> int:
        return self.n

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys and their counts."""
        used = np.flatnonzero(self.keys != FREE)
        return self.keys[used], self.counts[used]

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Distinct keys; where several meet at a free place one stays, and the others go on to the next."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            held = self.entries()
            size = 1 << (2 * (self.n + len(keys))).bit_length()
            self.n, self.keys, self.counts = 0, np.full(size, FREE, np.int64), np.zeros(size, np.int64)
            self.add(*held)
        mask = len(self.keys) - 1
        at = ((keys.view(np.uint64) * MIX) >> np.uint64(32)).astype(np.int64) & mask
        while len(keys):
            free = self.keys[at] == FREE
            self.keys[at[free]] = keys[free]
            here = self.keys[at] == keys
            self.counts[at[here]] += counts[here]
            self.n += int(np.count_nonzero(free & here))
            left = ~here
            keys, counts, at = keys[left], counts[left], (at[left] + 1) & mask


class Trie:
    """Counts of phrases of k word numbers below 2^21, by DIGIT bits of these a level. Leaves are hash containers, held in the order
    of their prefixes; one that grows beyond `burst` entries bursts into leaves for each next digit."""

    def __init__(self, k: int, burst: int = BURST):
        self.k, self.burst, self.bits = k, burst, WORD_BITS * k
        self.lows, self.depths, self.leaves = [0], [0], [self._leaf()]  # a leaf's least key, and how many bits of it are fixed

    def __len__(self) -> int:
        return sum(map(len, self.leaves))

    @staticmethod
    def _leaf() -> Container:
        return Container(np.zeros(0, np.int64), np.zeros(0, np.int64))

    @property
    def burst_roots(self) -> set[int]:
        """First words whose phrases lie in several containers."""
        return {low >> (self.bits - WORD_BITS) for low, depth in zip(self.lows, self.depths, strict=True) if depth > WORD_BITS}

    def _burst(self, low: int, depth: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, Container]]:
        """Leaves for sorted keys below one prefix."""
        if len(keys) <= self.burst or depth == self.bits:
            yield low, depth, Container(keys, counts)
            return
        step = 1 << (self.bits - depth - DIGIT)
        at = np.searchsorted(keys, [low + i * step for i in range(1, 1 << DIGIT)]).tolist()
        for i, (a, b) in enumerate(zip([0, *at], [*at, len(keys)], strict=True)):
            yield from self._burst(low + i * step, depth + DIGIT, keys[a:b], counts[a:b])

    def add(self, phrases: np.ndarray, counts: np.ndarray) -> None:
        """Distinct phrases, a row each, and their counts."""
        if not len(phrases):
            return
        keys = _packed(phrases)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        at = np.searchsorted(keys, self.lows).tolist()
        leaves = []
        for low, depth, leaf, a, b in zip(self.lows, self.depths, self.leaves, at, [*at[1:], len(keys)], strict=True):
            leaf.add(keys[a:b], counts[a:b])
            if len(leaf) > self.burst:
                own, ns = leaf.entries()
                by_key = np.argsort(own)
                leaves += self._burst(low, depth, own[by_key], ns[by_key])
            else:
                leaves.append((low, depth, leaf))
        self.lows, self.depths, self.leaves = (list(x) for x in zip(*leaves, strict=True))

    def spill(self, upto: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Take out whole subtrees, the largest first, until at most `upto` entries are left: (phrases, counts). A first word's phrases leave together."""
        inner = (1 << (self.bits - WORD_BITS)) - 1
        starts = [i for i, low in enumerate(self.lows) if not low & inner]
        sizes = np.add.reduceat([len(leaf) for leaf in self.leaves], starts)
        left, gone = int(sizes.sum()), set()
        for i in np.argsort(-sizes, kind="stable").tolist():
            if left <= upto or not sizes[i]:
                break
            left -= int(sizes[i])
            gone.add(i)
        kept = []
        for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(self.lows)], strict=True)):
            if i not in gone:
                kept += zip(self.lows[a:b], self.depths[a:b], self.leaves[a:b], strict=True)
                continue
            for leaf in self.leaves[a:b]:
                keys, counts = leaf.entries()
                yield _unpacked(keys, self.k), counts
            kept.append((self.lows[a], min(self.depths[a], WORD_BITS), self._leaf()))
        self.lows, self.depths, self.leaves = (list(x) for x in zip(*kept, strict=True)) if left else ([0], [0], [self._leaf()])


def _packed(phrases: np.ndarray) -> np.ndarray:
    """Two or three word numbers as one long."""
    keys = phrases[:, 0].astype(np.int64)
    for i in range(1, phrases.shape[1]):
        keys = (keys << WORD_BITS) | phrases[:, i]
    return keys


def _unpacked(keys: np.ndarray, k: int) -> np.ndarray:
    return np.stack([(keys >> (WORD_BITS * (k - 1 - i))) & ((1 << WORD_BITS) - 1) for i in range(k)], axis=1)


def _distinct(ids: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The different phrases that start there, sorted, and their counts. A row's word numbers are below 2^21, so that three fit into a long."""
    keys, counts = np.unique(_packed(np.stack([ids[starts + i] for i in range(k)], axis=1)), return_counts=True)
    return _unpacked(keys, k), counts


def count_phrases(encoded: DataFrame, k: int, shorter: Bitmap, most_entries: int = MOST_ENTRIES, burst: int = BURST) -> DataFrame:
    """lang, phrase (bytes), n: runs of the counts of k-word phrases, k 2 or 3, whose parts may be frequent. A phrase comes once for each time that its subtree was spilled."""
    if k not in (2, 3):
        raise ValueError("phrases have two or three words")
    bits = shorter.data

    def run(batches):
        data = np.frombuffer(bits.value, np.uint8)
        state: dict[str, tuple[Trie, dict[bytes, int]]] = {}

        def runs(lang: str, upto: int) -> Iterator[pa.RecordBatch]:
            trie, known = state[lang]
            taken = list(trie.spill(upto))
            if not taken:
                return
            phrases, counts = (np.concatenate([t[i] for t in taken]) for i in (0, 1))
            spelt = pa.array(list(known), pa.binary())
            for at in range(0, len(counts), 1 << 16):
                part = slice(at, at + (1 << 16))
                words = [spelt.take(pa.array(phrases[part, i])) for i in range(k)]
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(words[0])), pc.binary_join_element_wise(*words, b" "), pa.array(counts[part])], names=["lang", "phrase", "n"])

        for batch in batches:
            for lang, buffer, context, words in zip(*(batch.column(i) for i in range(4)), strict=True):
                lang, ids, spelt = lang.as_py(), np.frombuffer(buffer.as_buffer(), np.int32), words.values
                hashes = _word_hashes(spelt)[ids]
                inside = np.concatenate([[0], np.cumsum(ids == BREAK)])
                starts = np.arange(max(0, context.as_py() - k + 1), max(0, len(ids) - k + 1))
                starts = starts[inside[starts + k] == inside[starts]]
                parts = Bitmap.holds(data, _phrase_hashes(hashes, k - 1) ^ _language_hash(lang))
                phrases, counts = _distinct(ids, starts[parts[starts] & parts[starts + 1]], k)
                trie, known = state.setdefault(lang, (Trie(k, burst), {}))
                used, where = np.unique(phrases, return_inverse=True)
                if len(known) + len(used) >= 1 << WORD_BITS:
                    yield from runs(lang, 0)
                    trie, known = state[lang] = (Trie(k, burst), {})
                numbers = np.fromiter((known.setdefault(w, len(known)) for w in spelt.take(pa.array(used - 1)).to_pylist()), np.int64, len(used))
                trie.add(numbers[where].reshape(phrases.shape), counts)
                if sum(len(t) for t, _ in state.values()) > most_entries:
                    for other in state:  # each gives back half of what it holds
                        yield from runs(other, len(state[other][0]) // 2)
                if len(known) > MOST_WORDS:
                    yield from runs(lang, 0)
                    del state[lang]
        for lang in state:
            yield from runs(lang, 0)

    return encoded.select("lang", "ids", "context", "words").mapInArrow(tidy(run), "lang string, phrase binary, n bigint")


def merged(runs: DataFrame, least: int) -> DataFrame:
    """lang, phrase, n of at least `least`: the runs dealt by phrase and summed there."""
    dealt = runs.withColumn("phrase", F.col("phrase").cast("string")).repartition("lang", "phrase")
    return dealt.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Collocations:
    """Counts of frequent phrases (lang, phrase, words, n) and of all words (lang, n); `candidates` scores them."""

    def __init__(self, docs: DataFrame, least: int = LEAST, longest: int = LONGEST, lang_column: str = "lang", text_column: str = "text", chunk_words: int = CHUNK_WORDS, most_entries: int = MOST_ENTRIES, burst: int = BURST):
        self.least, self.longest = least, longest
        encoded = cut(encode(docs, longest, lang_column, text_column, chunk_words), "collocations-encoded")
        totals = encoded.select("lang", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
        self.totals = totals.groupBy("lang").agg(F.sum("n").alias("total"))
        pairs = encoded.select("lang", F.explode(F.arrays_zip(F.col("words").alias("phrase"), F.col("counts").alias("n"))).alias("x")).select("lang", F.col("x.phrase").cast("string").alias("phrase"), "x.n")
        words = pairs.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        frequent = cut(words.withColumn("words", F.lit(1)), "collocations-words")
        self.counts = frequent
        for k in range(2, longest + 1):
            bitmap = Bitmap(frequent)
            runs = count_phrases(encoded, k, bitmap, most_entries, burst)
            frequent = cut(merged(runs, least).withColumn("words", F.lit(k)), "collocations-phrases")
            bitmap.data.destroy()
            self.counts = self.counts.unionByName(frequent)

    def candidates(self) -> DataFrame:
        """lang, phrase, a, l, r, score: every frequent phrase of two words or more, by its lowest-scoring cut."""
        phrases = self.counts.where("words > 1").select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
        cuts = phrases.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
        side = lambda name, part, n: self.counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(n))
        cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("left"), F.array_join(F.expr("slice(w, k + 1, size(w) - k)"), " ").alias("right"))
        both = cuts.join(side("l", "left", "l"), ["lang", "left"]).join(side("r", "right", "r"), ["lang", "right"])
        wide = lambda c: f"cast({c} as decimal(20, 0))"  # noqa: E731  products have up to 38 digits
        scored = both.withColumn("score", F.expr(f"cast(({wide('a')} * {wide('a')} * 1000000BD) div ({wide('l')} * {wide('r')}) as bigint)"))
        least = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
        return least.select("lang", "phrase", "a", "s.l", "s.r", "s.score")

    def absorbed(self, overlap: int = OVERLAP) -> DataFrame:
        """lang, phrase of candidates that mostly occur inside one longer candidate."""
        longer = self.counts.where("words > 2").select("lang", "n", F.split("phrase", " ").alias("w"))
        spans = [(i, k) for k in range(2, self.longest) for i in range(1, self.longest - k + 2)]
        if not spans:
            return longer.select("lang", F.lit("").alias("phrase")).limit(0)
        part = lambda i, k: F.when(F.size("w") >= max(i + k - 1, k + 1), F.array_join(F.slice("w", i, k), " "))
        inner = longer.select("lang", "n", F.explode(F.array(*(part(i, k) for i, k in spans))).alias("phrase")).where("phrase is not null")
        most = inner.groupBy("lang", "phrase").agg(F.max("n").alias("most"))
        return most.join(self.counts, ["lang", "phrase"]).where(F.expr(f"cast(most as decimal(20, 0)) * 100 >= cast(n as decimal(20, 0)) * {overlap}")).select("lang", "phrase")

    def top(self, top: int = TOP, overlap: int = OVERLAP) -> DataFrame:
        """lang, rank, phrase, a, l, r, n, score: each language's first `top`. Ranks are limited within tasks before rows of a language meet."""
        left = self.candidates().join(self.absorbed(overlap), ["lang", "phrase"], "left_anti")
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = left.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
        return ranked.join(F.broadcast(self.totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def collocations(docs: DataFrame, top: int = TOP, overlap: int = OVERLAP, **options) -> DataFrame:
    return Collocations(docs, **options).top(top, overlap)
