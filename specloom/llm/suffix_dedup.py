"""Substring dedup: every byte covered by a string of `length` bytes that also starts earlier goes.

A string can only repeat where its rarest inner piece repeats: each string of `length` bytes is
represented by its anchor, the inner piece with the least hash (the rightmost, among equals), so
equal strings have equal anchors at equal places. Strings that share an anchor are neighbours and
travel as one segment.

1. The anchors of all texts are counted; those met twice are marked in a bitmap of fixed size. An
   anchor of more than `hot_segments` segments would be too much for a task: its segments are split
   from here on. A string reaches so far on one side of the anchor that it holds half of the bytes
   left there, so segments split by the side and by those bytes, three times over: equal strings stay
   together under LEVELS more pieces of context.
2. Texts are read again; the places of segments with marked anchors leave, without their bytes but
   with a 128-bit BLAKE2 digest of them. Segments that are equal as a whole fold: within a chunk, byte
   by byte; then by anchor and digest, hot ones by a partial minimum before they shuffle. The earliest
   stays and the others are removed as they are. Anchors left with different segments go on.
3. Texts are read a third time; only the earliest of each of those segments leave, with their bytes,
   sharded by anchor. Each shard is suffix-sorted by external induced sorting (`induced_sort`), which
   carries common-prefix lengths; neighbours in suffix order that share `length` bytes or more are
   equal strings, and all but the earliest are removed. Anchors that have more than `hot_segments`
   different segments though split (those at the edge of a passage that goes on differently
   everywhere) send single strings instead, which fold by their digests as in step 2.
4. The removed runs of each document meet its text again and are cut out; documents without any do
   not shuffle (a Bloom filter lets them pass).

A shard closes at about `shard_bytes`, but an anchor group is never parted. The sorter's memory is
bounded by `memory` tuples, whatever the shard: its text, places and tuples lie in files of the task
beyond that. Beyond the bitmap's capacity more segments travel; the result stays the same.

Defined cases: a null text has no bytes; texts shorter than `length` keep all; long texts are read
whole, in chunks that overlap; null doc_ids come after all others; rows that repeat a doc_id are the
same document, so equal places in them are not earlier than each other; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import os
import struct
import tempfile
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import cut, order_key, slices, text_of
from .induced_sort import Memory, induced_sort

LENGTH = 100
CHUNK = 1 << 20  # bytes of text whose hashes are computed together
BLOCK = 1 << 16  # places whose arrays stay in a core's cache
MIN_FILTER_BITS, MAX_FILTER_BITS, BITMAP_BITS = 2**20, 2**28, 32768
SHARD_BYTES, SORT_MEMORY, HOT_SEGMENTS, LEVELS = 6 << 20, 8 << 20, 1_000, 3
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
RAISED = bytes((x + 2) % 256 for x in range(256))  # leaves 0 and 1 free: UTF-8 has no byte above 0xF4


def piece_sizes(length: int) -> tuple[int, int]:
    """(bytes of an inner piece, pieces in a string)."""
    k = max(1, length * 32 // 100)
    return k, length - k + 1


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64))]) for b in (BASE, INVERSE))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours."""
    have = 1
    while 2 * have <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - w + have], x[w - have :])


class Chunk:
    """The segments of the strings that lie within the parts (bounds: their ends) of data: hash and place of the anchor, first string's start, number of strings."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, length: int = LENGTH):
        n, (k, w) = len(data), piece_sizes(length)
        self.data, self.length, self.piece = data, length, k
        if n < length:
            self.h, self.anchor, self.start, self.n = np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
            return
        with np.errstate(over="ignore"):
            self.power, inverse = (p[: n + 1] for p in _powers(max(CHUNK + 4 * LENGTH, 1 << (n - 1).bit_length())))
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * inverse[:n], out=self.sums[1:])
            mask, strings = np.uint64((1 << max(24, n.bit_length())) - 1), n - length + 1
            least = np.empty(strings, np.uint64)  # of a string's pieces: the hash's upper bits, then its place from the right
            for a in range(0, strings, BLOCK):
                b = min(a + BLOCK, strings)
                upto = b + w - 1
                key = _mixed((self.sums[a + k : upto + k] - self.sums[a:upto]) * self.power[a:upto])
                key |= mask
                key -= np.arange(a, upto, dtype=np.uint64)
                least[a:b] = _least(key, w)
            whole = np.ones(strings, bool)  # strings that meet no end of a part
            cut_off = (bounds[:, None] - np.arange(1, length)).ravel()
            whole[cut_off[(cut_off >= 0) & (cut_off < strings)]] = False
            begins = whole & np.concatenate([[True], (least[1:] != least[:-1]) | ~whole[:-1]])
            self.start = np.flatnonzero(begins)
            last = whole & np.concatenate([begins[1:] | ~whole[1:], [True]])
            self.n = np.flatnonzero(last) - self.start + 1
            self.anchor = (mask - (least[self.start] & mask)).astype(np.int64)
            self.h = self.hashes(self.anchor, self.anchor + k)

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mixed((self.sums[end] - self.sums[begin]) * self.power[begin])

    def take(self, on: np.ndarray) -> None:
        self.h, self.anchor, self.start, self.n = self.h[on], self.anchor[on], self.start[on], self.n[on]

    def split(self, on: np.ndarray, levels: int = LEVELS) -> None:
        """Split the segments `on` by the context of their strings; h becomes a hash of all the context, which equal strings share."""
        calm = np.setdiff1d(np.arange(len(self.h)), on)
        first, end = self.start[on], self.start[on] + self.n[on]  # of the strings' starts
        lo, hi, path = self.anchor[on], self.anchor[on] + self.piece, np.ones(len(on), np.uint64)
        for _ in range(levels):
            left = self.length - (hi - lo)
            x = (left + 1) // 2
            turn = lo - x + 1  # strings that start before it hold x more bytes before, the others left - x + 1 more after
            first, end = np.append(first, np.maximum(first, turn)), np.append(np.minimum(end, turn), end)
            lo, hi = np.append(lo - x, lo), np.append(hi, hi + left - x + 1)
            path = np.append(2 * path, 2 * path + np.uint64(1))
            some = first < end
            first, end, lo, hi, path = first[some], end[some], lo[some], hi[some], path[some]
        with np.errstate(over="ignore"):
            key = _mixed(self.hashes(lo, hi) + path * np.uint64(INVERSE))
        self.h, self.anchor = np.append(self.h[calm], key), np.append(self.anchor[calm], lo)
        self.start, self.n = np.append(self.start[calm], first), np.append(self.n[calm], end - first)

    def singles(self) -> None:
        """Each string as a segment of its own; h becomes a hash of all its bytes."""
        row = np.repeat(np.arange(len(self.h)), self.n)
        self.start = self.start[row] + np.arange(len(row)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        self.anchor, self.n = self.anchor[row], np.ones(len(row), np.int64)
        self.h = self.hashes(self.start, self.start + self.length)

    def size(self) -> np.ndarray:
        return self.n + self.length - 1

    def bytes_of(self, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the segments `on`, one after the other; where each begins, and the end)."""
        size = self.size()[on]
        at = np.concatenate([[0], np.cumsum(size)])
        return self.data[np.repeat(self.start[on] - at[:-1], size) + np.arange(at[-1])], at

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the segments a[i] and b[i] have the same bytes."""
        out = self.n[a] == self.n[b]
        a, b = a[out], b[out]
        if len(a):
            left, at = self.bytes_of(a)
            out[out] = np.add.reduceat((left != self.bytes_of(b)[0]).astype(np.int64), at[:-1]) == 0
        return out

    def digests(self, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of BLAKE2 of each of the segments `on`."""
        raw, at = self.bytes_of(on)
        raw, at = raw.tobytes(), at.tolist()
        both = np.frombuffer(b"".join(blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(at, at[1:], strict=False)), np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]


def chunks(texts: list[str | None], length: int, most: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, ends of its parts, text of each part, place of each part in its text); long texts come in parts that overlap by a string less a byte."""
    held, owner, place, size = [], [], [], 0

    def flush():
        return np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(x) for x in held]), np.array(owner), np.array(place)

    for i, text in enumerate(texts):
        raw = (text or "").encode()
        if len(raw) < length:
            continue
        for a in range(0, max(1, len(raw) - length + 1), most):
            part = raw[a : a + most + length - 1]
            if held and size + len(part) > most + length:
                yield flush()
                held, owner, place, size = [], [], [], 0
            held.append(part)
            owner.append(i)
            place.append(a)
            size += len(part)
    if held:
        yield flush()


def counted_anchors(docs: DataFrame, length: int) -> DataFrame:
    """The hashes (h) of anchors that two or more segments have, and how many (n)."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                for data, bounds, _, _ in chunks(batch.column(0).to_pylist(), length):
                    h, n = np.unique(Chunk(data, bounds, length).h, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int32))], names=["h", "n"])

    counted = docs.select("text").mapInArrow(run, "h bigint, n int")
    return counted.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")


def bitmap(hashes: DataFrame, rows: int, most: int = MAX_FILTER_BITS) -> np.ndarray:
    """A bit for each marked slot of the hashes (column h): at most `most` bits, whatever the corpus."""
    bits = max(MIN_FILTER_BITS, min(most, 1 << max(1, 32 * rows - 1).bit_length()))
    slot = F.expr(f"pmod(h, {bits}L)")
    maps = hashes.select(slot.alias("slot")).groupBy(F.expr(f"slot div {BITMAP_BITS}").alias("part")).agg(F.expr(f"bitmap_construct_agg(slot % {BITMAP_BITS})").alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in maps.toLocalIterator():  # at most bits / BITMAP_BITS rows of 4 KB
        out[r["part"] * BITMAP_BITS // 8 : (r["part"] + 1) * BITMAP_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def marked(h: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Which hashes (unsigned) have their bit set."""
    slot = np.mod(h.view(np.int64), len(marks) * 8)
    return np.flatnonzero(marks[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)


FOUND = "kind int, h bigint, d1 bigint, d2 bigint, k bigint, v bigint, start bigint, n bigint"
NAMES = ["kind", "h", "d1", "d2", "k", "v", "start", "n"]
SEGMENT, REMOVED, DISTINCT, HOT = 0, 1, 2, 3


def _rows(kind, h, d1, d2, k, v, start, n) -> pa.RecordBatch:
    longs = [pa.array(np.asarray(x, np.int64)) if x is not None else pa.nulls(len(start), pa.int64()) for x in (h, d1, d2, k, v, start, n)]
    kinds = pa.array(np.broadcast_to(np.asarray(kind, np.int32), len(start)))
    return pa.RecordBatch.from_arrays([kinds, *longs], names=NAMES)


def _merged(k, v, start, end):
    """Runs of the same text that touch become one."""
    order = np.lexsort((end, start, v, k))
    k, v, start, end = k[order], v[order], start[order], end[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (v[1:] != v[:-1]) | (start[1:] > end[:-1])])
    at = np.flatnonzero(new)
    return k[at], v[at], start[at], np.maximum.reduceat(end, at)


def _placed(texts, ks, vs, length: int, marks: np.ndarray, hot: np.ndarray):
    """Chunks with the segments of marked anchors, those of hot ones split: (chunk, whether split, k, v, start in the text)."""
    for data, bounds, owner, place in chunks(texts, length):
        c = Chunk(data, bounds, length)
        c.take(marked(c.h, marks))
        busy = marked(c.h, hot)
        calm = len(c.h) - len(busy)
        if len(busy):
            c.split(busy)
        if len(c.h):
            part = np.searchsorted(bounds, c.start, side="right")
            where = c.start - np.concatenate([[0], bounds[:-1]])[part] + place[part]
            yield c, np.arange(len(c.h)) >= calm, ks[owner[part]], vs[owner[part]], where


def marked_segments(docs: DataFrame, marks: np.ndarray, hot: np.ndarray, length: int) -> DataFrame:
    """Segments with a marked anchor (kind 0; kind 3 where it is hot): the earliest of equal ones within a chunk, and the runs of the later ones (kind 1: start, end in n)."""
    shared = docs.sparkSession.sparkContext.broadcast((marks, hot))  # of fixed size

    def run(batches):
        marks, hot = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                ks, vs = (np.asarray(batch.column(i), np.int64) for i in (1, 2))
                for c, split, k, v, where in _placed(batch.column(0).to_pylist(), ks, vs, length, marks, hot):
                    seg = c.hashes(c.start, c.start + c.size())
                    order = np.lexsort((where, k, seg, c.h))
                    again = np.concatenate([[False], (c.h[order][1:] == c.h[order][:-1]) & (seg[order][1:] == seg[order][:-1])])
                    first = order[np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))]
                    again[again] = c.same(order[again], first[again])
                    keep, gone, first = order[~again], order[again], first[again]
                    yield _rows(np.where(split[keep], HOT, SEGMENT), c.h[keep].view(np.int64), *c.digests(keep), k[keep], v[keep], where[keep], c.n[keep])
                    gone = gone[(k[gone] != k[first]) | (where[gone] != where[first])]
                    if len(gone):
                        yield _rows(REMOVED, None, None, None, *_merged(k[gone], v[gone], where[gone], where[gone] + c.size()[gone]))

    return docs.select("text", "k", "v").mapInArrow(run, FOUND)


def compared_segments(docs: DataFrame, marks: np.ndarray, hot: np.ndarray, wanted: np.ndarray, crowded: np.ndarray, length: int) -> DataFrame:
    """The segments (kind 0, with bytes) whose anchor and place are wanted: the earliest of each of an anchor's different ones.

    Those of crowded anchors, which have too many different ones even though split, come as single strings (kind 3, with digests)."""
    shared = docs.sparkSession.sparkContext.broadcast((marks, hot, wanted, crowded))  # of fixed size

    def run(batches):
        marks, hot, wanted, crowded = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                ks, vs = (np.asarray(batch.column(i), np.int64) for i in (1, 2))
                for c, _, k, v, where in _placed(batch.column(0).to_pylist(), ks, vs, length, marks, hot):
                    on = marked(placed_hash(c.h, k, where), wanted)
                    c.take(on)
                    k, v, where = k[on], v[on], where[on]
                    busy = marked(c.h, crowded)
                    calm = np.setdiff1d(np.arange(len(c.h)), busy)
                    if len(calm):
                        raw, at = c.bytes_of(calm)
                        raw = pa.Array.from_buffers(pa.binary(), len(calm), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw.tobytes())])
                        rows = _rows(SEGMENT, c.h[calm].view(np.int64), None, None, k[calm], v[calm], where[calm], c.n[calm])
                        yield pa.RecordBatch.from_arrays([*rows.columns, raw], names=[*NAMES, "bytes"])
                    if len(busy):
                        c.take(busy)
                        row = np.repeat(busy, c.n)
                        at = where[row] + np.concatenate([np.arange(n) for n in c.n.tolist()])
                        c.singles()
                        rows = _rows(HOT, c.h.view(np.int64), *c.digests(np.arange(len(row))), k[row], v[row], at, c.n)
                        yield pa.RecordBatch.from_arrays([*rows.columns, pa.nulls(len(row), pa.binary())], names=[*NAMES, "bytes"])

    return docs.select("text", "k", "v").mapInArrow(run, f"{FOUND}, bytes binary")


def placed_hash(h: np.ndarray, k: np.ndarray, start: np.ndarray) -> np.ndarray:
    """One hash of a segment's anchor and place."""
    with np.errstate(over="ignore"):
        return _mixed(h ^ _mixed(k.view(np.uint64) * np.uint64(BASE) + start.view(np.uint64)))


def _placed_hashes(places: DataFrame) -> DataFrame:
    """placed_hash() of columns h, k and start, as column h."""

    def run(batches):
        for batch in batches:
            h, k, start = (np.asarray(c, np.int64) for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(placed_hash(h.view(np.uint64), k, start).view(np.int64))], names=["h"])

    return places.select("h", "k", "start").mapInArrow(run, "h bigint")


def by_anchor(found: DataFrame, *order: str) -> DataFrame:
    partitions = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(partitions, "h").sortWithinPartitions("h", *order)


def folded_segments(found: DataFrame, length: int) -> DataFrame:
    """Of the segments, the runs (kind 1) of all but the earliest of equal ones; the earliest ones (kind 2) where an anchor has several different."""

    def run(batches):
        held = np.empty((7, 0), np.int64)  # of the anchor that may go on: its first segment and its latest
        told = np.empty(0, bool)  # whether a held segment has been put out as one of several
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate([held, np.array([np.asarray(batch.column(i), np.int64) for i in range(1, 8)])], axis=1)
            old = np.zeros(rows.shape[1], bool)
            old[: len(told)] = True
            said = np.concatenate([told, np.zeros(batch.num_rows, bool)])
            h, d1, d2, k, v, start, n = rows
            new_h = np.concatenate([[True], h[1:] != h[:-1]])
            new = new_h | np.concatenate([[True], (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])])
            first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            again = np.flatnonzero(~new & ~old & ((k != k[first]) | (start != start[first])))
            group = np.cumsum(new_h) - 1
            several = np.bincount(group[new])[group] > 1
            out = np.flatnonzero(new & several & ~said)
            if len(again):
                yield _rows(REMOVED, None, None, None, *_merged(k[again], v[again], start[again], start[again] + n[again] + length - 1))
            if len(out):
                yield _rows(DISTINCT, *rows[:, out])
            mine = np.flatnonzero(new & (group == group[-1]))
            mine = np.unique(mine[[0, -1]])
            held, told = rows[:, mine], several[mine]

    return by_anchor(found.where(f"kind = {SEGMENT}"), "d1", "d2", "k", "start").select(*NAMES).mapInArrow(run, FOUND)


def folded_hot(found: DataFrame, length: int) -> DataFrame:
    """The same of hot anchors' segments: the earliest come from partial minima, and are written out, so that AQE may split the join with them."""
    hot = found.where(f"kind = {HOT}").drop("kind")
    least = F.min(F.struct("k", "start", "v", "n")).alias("least")
    first = cut(hot.groupBy("h", "d1", "d2").agg(least), "suffix-hot")
    later = hot.join(first, ["h", "d1", "d2"]).where("k <> least.k or start <> least.start")
    none = [F.lit(None).cast("bigint").alias(x) for x in ("h", "d1", "d2")]
    gone = later.select(F.lit(REMOVED).alias("kind"), *none, "k", "v", "start", (F.col("start") + F.col("n") + length - 1).alias("n"))
    several = first.groupBy("h").agg(F.count(F.lit(1)).alias("different")).where("different > 1").select("h")
    distinct = first.join(several, "h").select(F.lit(DISTINCT).alias("kind"), "h", "d1", "d2", "least.k", "least.v", "least.start", "least.n")
    return gone.unionByName(distinct)


class Shard:
    """Different segments of whole anchor groups; their text and places lie in files."""

    def __init__(self, length: int, folder: str, memory: int):
        self.length, self.allowance = length, Memory(memory, folder)
        self.path, self.places = os.path.join(folder, "text"), os.path.join(folder, "places")
        self.text, self.rows_file, self.size, self.rows = open(self.path, "wb"), open(self.places, "wb"), 0, 0  # noqa: SIM115

    def add(self, k: int, v: int, start: int, n: int, data: bytes) -> None:
        self.rows_file.write(struct.pack("=5q", k, v, start, n, self.size))
        self.text.write(data.translate(RAISED) + b"\x01")
        self.rows += 1
        self.size += len(data) + 1

    def close(self) -> None:
        self.text.close()
        self.rows_file.close()

    def removed(self) -> Iterator[tuple[np.ndarray, ...]]:
        """(k, v, start, end) of the runs of strings that have an earlier equal."""
        self.text.write(b"\x00")
        self.close()
        small = self.size < self.allowance.tuples
        text = np.fromfile(self.path, np.uint8) if small else np.memmap(self.path, np.uint8, "r")
        places = np.fromfile(self.places, np.int64) if small else np.memmap(self.places, np.int64, "r")
        k, v, start, n, at = places.reshape(-1, 5).T
        gone = self.allowance.array(self.size, bool)
        left = (np.empty(0, np.int64), np.empty(0, np.uint8))
        for positions, common in induced_sort(text, self.length, self.allowance.tuples, self.allowance.folder):
            # a group may go on in the next block: its earliest strings so far stay at hand
            positions, common = np.concatenate([left[0], positions]), np.concatenate([left[1], common])
            later, earliest = self._judged(positions, common, k, start, n, at)
            gone[later] = True
            left = earliest, np.full(len(earliest), self.length, np.uint8)
        size = self.allowance.block
        for a in range(0, self.size, size):
            marked = np.flatnonzero(gone[a : a + size])
            if not len(marked):
                continue
            marked += a
            row = np.searchsorted(at, marked, side="right") - 1
            new = np.concatenate([[True], (marked[1:] != marked[:-1] + 1) | (row[1:] != row[:-1])])
            b = np.flatnonzero(new)
            c = np.append(b[1:], len(marked)) - 1
            own = row[b]
            yield k[own], v[own], start[own] + marked[b] - at[own], start[own] + marked[c] - at[own] + self.length
        self.allowance.close()

    def _judged(self, positions, common, k, start, n, at) -> tuple[np.ndarray, np.ndarray]:
        """(positions of strings that have an equal which starts earlier, positions of the last group's earliest strings)."""
        group = np.cumsum(common < self.length)
        last = group[-1]
        crowded = (np.bincount(group)[group] > 1) | (group == last)
        positions, group = positions[crowded], group[crowded]
        row = np.searchsorted(at, positions, side="right") - 1
        inside = positions - at[row]
        string = inside < n[row]
        positions, group, row, inside = positions[string], group[string], row[string], inside[string]
        where = start[row] + inside
        order = np.lexsort((where, k[row], group))
        if not len(order):
            return order, positions
        g, o = group[order], row[order]
        new = np.concatenate([[True], g[1:] != g[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
        later = (k[o] != k[o][first]) | (where[order] != where[order][first])
        return positions[order][later], positions[order][~later & (g == last)]


def sorted_shards(compared: DataFrame, length: int, shard_bytes: int = SHARD_BYTES, memory: int = SORT_MEMORY) -> DataFrame:
    """Runs removed (kind 1) by comparing the different segments (with bytes) of each anchor by their suffixes."""

    def run(batches):
        with tempfile.TemporaryDirectory() as folder:
            shard = Shard(length, folder, memory)
            alone, group = None, None  # the group's only segment so far, and its anchor

            def emit(parts):
                for p in parts:
                    if len(p[0]):
                        yield _rows(REMOVED, None, None, None, *_merged(*p))

            for batch in batches:
                h, k, v, start, n = (np.asarray(batch.column(i), np.int64) for i in range(5))
                for i in range(len(h)):
                    own = (int(k[i]), int(v[i]), int(start[i]), int(n[i]), batch.column(5)[i].as_py())
                    if h[i] != group:
                        if shard.size >= shard_bytes:
                            yield from emit(shard.removed())
                            shard = Shard(length, folder, memory)
                        group, alone = h[i], own
                    else:
                        if alone:
                            shard.add(*alone)
                            alone = None
                        shard.add(*own)
            if shard.rows:
                yield from emit(shard.removed())
            else:
                shard.close()

    return by_anchor(compared.select("h", "k", "v", "start", "n", "bytes"), "k", "start").mapInArrow(run, FOUND)


def union_of(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(r) for r in out]


def kept_bytes(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in runs:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def substring_dedup(docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text", max_filter_bits: int = MAX_FILTER_BITS, shard_bytes: int = SHARD_BYTES, memory: int = SORT_MEMORY, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (removed runs of bytes) and kept (the remaining bytes): one row per document."""
    read = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"), order_key(id_column).alias("k"), F.xxhash64(text_of(text_column)).alias("v"))
    anchors = cut(counted_anchors(read, length), "suffix-anchors")
    hot = anchors.where(f"n > {hot_segments}").select("h")
    marks, hot = bitmap(anchors.select("h"), anchors.count(), max_filter_bits), bitmap(hot, hot.count(), max_filter_bits)
    found = cut(marked_segments(read, marks, hot, length), "suffix-segments")
    folded = cut(folded_segments(found, length).unionByName(folded_hot(found, length)), "suffix-folded")
    different = folded.where(f"kind = {DISTINCT}")
    wanted = bitmap(_placed_hashes(different), different.count(), max_filter_bits)
    crowded = different.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(f"n > {hot_segments}").select("h")
    crowded = bitmap(crowded, crowded.count(), max_filter_bits)
    compared = cut(compared_segments(read, marks, hot, wanted, crowded, length), "suffix-compared")
    runs = sorted_shards(compared.where(f"kind = {SEGMENT}"), length, shard_bytes, memory)
    for more in (found, folded, folded_hot(compared.drop("bytes"), length)):
        runs = runs.unionByName(more.where(f"kind = {REMOVED}"))
    key = F.xxhash64("k", "v").alias("key")
    spans = runs.groupBy("k", "v").agg(F.collect_set(F.struct("start", F.col("n").alias("end"))).alias("runs"))  # of one text
    spans = cut(spans.select("k", "v", "runs", key), "suffix-runs")
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = []
                for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    raw, merged = text.encode(), union_of([(r["start"], r["end"]) for r in own or []])
                    rows.append((len(raw), sum(b - a for a, b in merged), len(merged), [{"start": a, "end": b} for a, b in merged], kept_bytes(raw, merged)))
                parts = zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.list_(span), pa.binary()), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in parts)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    clear, maybe = bloom.split(read.select("*", key), "key", spans)
    clear = clear.select("doc_id", "text", F.lit(None).cast(spans.schema["runs"].dataType).alias("runs"))
    joined = maybe.join(spans.drop("key"), ["k", "v"], "left").select("doc_id", "text", "runs")
    return clear.unionByName(joined).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
