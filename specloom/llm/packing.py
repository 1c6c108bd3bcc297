"""Packing token pieces into sequences of fixed capacity by exact-complement hashing.

Documents are tokenized once; only longer ones are cut. What decides the packing is how many pieces
there are of each length, a table of at most `capacity` rows, so the plan is made from it alone. An
index of length sums is looked up for the gap that the longest waiting piece leaves: the single
length, else the pair, else the triple that fills it exactly, as long as counts last; the sequence
is then made as often as its counts allow. Among pairs, those of plentiful and of long pieces come
first, and pieces below LEAST_SHARE / 32 of the capacity join neither pairs nor triples, as short pieces are what later
gaps need; where nothing fills a gap, the best-fitting (longest) piece goes in and the rest of the
gap is looked up again. A plan is a list of rank ranges per length; Spark numbers the pieces of each
length from per-partition counts and joins them to the ranges.

Defined cases: a null text is an empty document, which is its end id alone; rows that repeat a
doc_id and equal texts are documents of their own; pieces of equal length are dealt in the order in
which they were read; long texts are tokenized whole, in parts whose ids do not depend on each other;
an empty table gives an empty result; `pieces` ignores further columns, `pack` carries them and
names its own with underscores where they clash.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, slices, tidy

#: White space other than [ \t\n\r], and characters that some tables count as such: no cutting in a text with any of them.
ODD = "[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: One match of the split pattern; between one of these letters and one of these other characters a match always ends.
WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
SPACE, LINE, LETTER, MARK, TAIL = 1, 2, 4, 8, 16
KIND = np.zeros(256, np.uint8)  # of a byte; À to ÿ are C3 and a TAIL
KIND[0x80:0xC0] = TAIL
KIND[[0x97, 0xB7]] = 0
for c in range(0x21, 0x7F):
    KIND[c] = LETTER if chr(c).isalpha() else MARK
KIND[[0x20, 0x09, 0x0A, 0x0D]] = SPACE, *[SPACE | LINE] * 3
#: How byte-level vocabularies write bytes.
WRITTEN = str.maketrans({chr(c): chr(256 + i) for i, c in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])})
#: Of 32 parts of the capacity: the least length in pairs and triples.
LEAST_SHARE = 5
UNITS_KEPT, UNIT_CHARS = 1_200_000, 48  # some 200 bytes of a worker's memory each
SLICE = 4 << 20  # bytes of text whose units are looked up together


def unit_bounds(data: np.ndarray, offsets: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Where units begin in texts that lie one after the other as UTF-8 bytes, and the end: the ids of a unit depend on it alone.

    A unit is white space, if any, and what follows it up to the next or to the end of a word; a single line end is one, too; odd texts are cut nowhere."""
    kind = KIND[data]
    letter = (kind & LETTER) > 0
    letter[1:] |= (data[:-1] == 0xC3) & ((kind[1:] & TAIL) > 0)
    space = (kind & SPACE) > 0
    begins = np.zeros(len(data) + 1, bool)
    begins[1:-1] = space[1:] & ~space[:-1] | letter[:-1] & ((kind[1:] & MARK) > 0)
    begins[2:-1] |= ~space[:-2] & ((kind[1:-1] & LINE) > 0) & ~space[2:]
    for i in np.flatnonzero(odd).tolist():
        begins[offsets[i] : offsets[i + 1]] = False
    begins[offsets] = True
    return np.flatnonzero(begins)


class UnitTokenizer:
    """Ids by the tokenizers library, which is asked once for each unit while it is kept (a bounded number)."""

    def __init__(self, path: str, units_kept: int = UNITS_KEPT):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        self.merge = self.lib.model.tokenize  # of one match, as the vocabulary writes it
        self.units_kept = units_kept
        self.kept: dict[str, bytes] = {}

    def _ask(self, asked: list[str]) -> dict[str, bytes]:
        words = [u for u in asked if WORD.fullmatch(u)]
        out = {u: array("I", [t.id for t in self.merge(u.encode().decode("latin-1").translate(WRITTEN))]).tobytes() for u in words}
        rest = [u for u in asked if u not in out]
        return out | {u: array("I", e.ids).tobytes() for u, e in zip(rest, self.lib.encode_batch_fast(rest, add_special_tokens=False), strict=True)}

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all the texts, one after the other; where each text's ids end)."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if offsets[0] == offsets[-1]:
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        bounds = unit_bounds(data, offsets, np.asarray(pc.match_substring_regex(texts, ODD)))
        units = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(data)).dictionary_encode()
        if len(self.kept) > self.units_kept:
            self.kept.clear()
        words = units.dictionary.to_pylist()
        found = [self.kept.get(u) for u in words]
        new = self._ask([u for u, b in zip(words, found, strict=True) if b is None])
        self.kept.update((u, b) for u, b in new.items() if len(u) <= UNIT_CHARS)
        found = [new[u] if b is None else b for u, b in zip(words, found, strict=True)]
        pool, end = np.frombuffer(b"".join(found), np.uint32), np.cumsum([len(b) // 4 for b in found])
        which = np.asarray(units.indices)
        size = np.diff(end, prepend=0)[which]
        upto = np.cumsum(size)
        ids = pool[np.repeat(end[which] - upto, size) + np.arange(upto[-1])]
        return ids, np.append(0, upto)[np.searchsorted(bounds, offsets[1:])]


@lru_cache(maxsize=2)
def unit_tokenizer(path: str, units_kept: int) -> UnitTokenizer:
    return UnitTokenizer(path, units_kept)


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: all but the first are full."""
    first = length - (length - 1) // capacity * capacity
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False, units_kept: int = UNITS_KEPT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids themselves."""

    def run(batches):
        lib = unit_tokenizer(tokenizer_path, units_kept)
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                ids, ends = lib.ids(batch.column(1))
                ids, ends = np.insert(ids, ends, np.uint32(end_id)), ends + np.arange(1, len(ends) + 1)
                at, rows, begin = [], [], 0
                for i, end in enumerate(ends.tolist()):
                    for n, (start, length) in enumerate(cuts(end - begin, capacity)):
                        own = ids[begin + start : begin + start + length]
                        at.append(i)
                        rows.append((n, start, length, zlib.crc32(own), own.astype(np.int32) if with_ids else None))
                    begin = end
                n, start, length, crc, own = zip(*rows, strict=True)
                out = [batch.column(0).take(pa.array(at)), pa.array(n, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([*out, *([pa.array(own, pa.list_(pa.int32()))] if with_ids else [])], names=names)

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(tidy(run), schema)


class SumIndex:
    """Which lengths add up to a gap: single lengths by direct address, pairs by their sum, triples as a length and a pair.

    Pairs are indexed once, sorted by sum; counts of what is left decide at each look-up. Pieces shorter than `least`
    are in no pair or triple: they are kept for the gaps that nothing fills exactly."""

    def __init__(self, have: np.ndarray, least: int):
        self.have = have
        lengths = np.flatnonzero(have)
        lengths = lengths[lengths >= least]
        i, j = np.tril_indices(len(lengths))
        longer, shorter = lengths[i], lengths[j]
        fits = longer + shorter < len(have)
        longer, shorter = longer[fits], shorter[fits]
        order = np.lexsort((-shorter, longer + shorter))
        self.longer, self.shorter = longer[order], shorter[order]
        self.at = np.searchsorted(self.longer + self.shorter, np.arange(len(have) + 1))
        self.lengths = lengths[::-1]

    def pair(self, total: int, most: int) -> tuple[int, int] | None:
        """The available pair (none longer than most) of which there are many and whose shorter piece is long."""
        own = slice(self.at[total], self.at[total + 1])
        longer, shorter = self.longer[own], self.shorter[own]
        if not len(longer):
            return None
        often = np.where(longer == shorter, self.have[longer] // 2, np.minimum(self.have[longer], self.have[shorter])) * (longer <= most)
        k = int(np.argmax(often * shorter))
        return (int(longer[k]), int(shorter[k])) if often[k] > 0 else None

    def find(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths, in this order, whose sum is the gap."""
        if self.have[gap]:
            return (gap,)
        if two := self.pair(gap, gap):
            return two
        for longest in self.lengths[np.searchsorted(-self.lengths, -gap) :].tolist():
            if 3 * longest < gap:
                break
            if not self.have[longest]:
                continue
            self.have[longest] -= 1
            two = self.pair(gap - longest, longest)
            self.have[longest] += 1
            if two:
                return (longest, *two)
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in one sequence, how many such sequences), from the number of pieces of each length."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    index, made = SumIndex(have, capacity * LEAST_SHARE // 32), []
    for longest in range(capacity, 0, -1):
        while have[longest] > 0:
            took, gap = [longest], capacity - longest
            have[longest] -= 1
            while gap > 0:
                more = index.find(gap)
                if not more:
                    fitting = np.flatnonzero(have[: gap + 1])
                    if not len(fitting):
                        break
                    more = (int(fitting[-1]),)
                for x in more:
                    have[x] -= 1
                took += more
                gap -= sum(more)
            each = Counter(took)
            again = min(int(have[x]) // n for x, n in each.items())
            for x, n in each.items():
                have[x] -= n * again
            made.append((tuple(took), 1 + again))
    return made


def ranges(made: list[tuple[tuple[int, ...], int]], counts: dict[int, int]) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """Where the pieces of each length go, by rank.

    (length, block size) and (length, block, first rank, end rank, first sequence, offset, pieces of it in one sequence, rank
    at which the first sequence begins): ranges are cut at the ends of blocks, so a block holds about two of them."""
    used: Counter = Counter()
    whole, sequence = [], 0
    for took, times in made:
        offset = 0
        for length, n in Counter(took).items():
            whole.append((length, used[length], used[length] + n * times, sequence, offset, n))
            used[length] += n * times
            offset += n * length
        sequence += times
    per_length = Counter(r[0] for r in whole)
    sizes = {length: -(-counts[length] // n) for length, n in per_length.items()}
    out = []
    for length, lo, hi, first, offset, n in whole:
        size = sizes[length]
        out += [(length, block, max(lo, block * size), min(hi, (block + 1) * size), first, offset, n, lo) for block in range(lo // size, (hi - 1) // size + 1)]
    return list(sizes.items()), out


def pack(rows: DataFrame, capacity: int = 1024) -> DataFrame:
    """rows (with `length`, 1 to capacity) plus sequence_id and offset (with underscores where rows have such columns)."""
    columns = rows.columns
    spark = rows.sparkSession
    names = {x: free_name(columns, x) for x in ("part", "row", "nth", "before", "size", "block", "lo", "hi", "first", "at", "each", "begin", "sequence_id", "offset")}
    part, row, nth, before, size, block, lo, hi, first, at, each, begin, sequence_id, offset = names.values()
    rows = cut(rows.withColumn(part, F.spark_partition_id()).withColumn(row, F.monotonically_increasing_id()), "packing-pieces")
    full = rows.where(F.col("length") == capacity).select(*columns, (-1 - F.col(row)).alias(sequence_id), F.lit(0).cast("long").alias(offset))
    rest = rows.where(F.col("length") < capacity)
    by_part = rest.groupBy("length", part).agg(F.count(F.lit(1)).alias(nth))
    earlier = Window.partitionBy("length").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    by_part = by_part.withColumn(before, F.coalesce(F.sum(nth).over(earlier), F.lit(0)))  # a row per length and partition
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum(nth).alias("n")).collect()}  # at most `capacity` rows
    sizes, places = ranges(plan(histogram, capacity), histogram)
    sizes = spark.createDataFrame(sizes, f"length bigint, {size} bigint")
    places = spark.createDataFrame(places, f"length bigint, {block} bigint, {lo} bigint, {hi} bigint, {first} bigint, {at} bigint, {each} bigint, {begin} bigint")
    numbered = rest.withColumn(nth, F.row_number().over(Window.partitionBy(part, "length").orderBy(row)) - 1)
    ranked = numbered.join(by_part.drop(nth), ["length", part]).withColumn(nth, F.col(nth) + F.col(before))
    # both tables follow from the histogram: a row per length, and a few ranges for each
    blocked = ranked.join(F.broadcast(sizes), "length").withColumn(block, F.expr(f"{nth} div {size}"))
    placed = blocked.join(F.broadcast(places), ["length", block]).where(f"{nth} >= {lo} and {nth} < {hi}")
    placed = placed.select(*columns, F.expr(f"{first} + ({nth} - {begin}) div {each}").alias(sequence_id), F.expr(f"{at} + ({nth} - {begin}) % {each} * length").alias(offset))
    return full.unionByName(placed)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the ids of each packed sequence; a sequence has at most `capacity` ids. Needs `ids`."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
