"""SimHash near-duplicates: segment-popcount embedding, grid range-join, exact verification.

A fingerprint is embedded as the bit counts of its segments. The Manhattan distance of two such
vectors never exceeds the Hamming distance of the fingerprints, so a range join on it loses no
link. The vectors lie on an integer grid: a vector is joined, by equality on a packed cell number,
to the cells within Manhattan distance `distance`, half of them in one direction, since a pair is
found from one of its ends. The join condition then verifies the Hamming distance exactly, and only
links come out. Equal fingerprints are one node, so copies are never expanded into pairs. More
segments make cells rarer and the probes of a fingerprint more; `choose_segments` weighs them by how
crowded the cells are.

Defined cases: a null text counts as empty and has fingerprint 0; a text of fewer words than a
shingle is one shingle; null doc_ids sort after all others; rows that repeat a doc_id are documents
of their own; long texts are read whole, in runs of bounded size; of equally near ones the smallest
doc_id gives a component's name; an empty table gives an empty result; further columns are ignored
or, by `near_dedup`, carried, whatever their names. Documents are read once and stored with their
fingerprints, so rows keep their identity.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import bloom
from .common import MAX_LONG, by_shuffle, cut, order_key, slices, tidy
from .components import connected_components

SHINGLE, SEED, DISTANCE = 3, 42, 2
RUN = 1 << 16  # shingles whose bits are unpacked together


def _hashes(text: str | None, shingle: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: lower() changes A-Z only, split() splits at [\x20\x09-\x0D]
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - k + 1)


def _fingerprints(texts: list[str | None], shingle: int) -> np.ndarray:
    """One 64-bit fingerprint per text; bits are counted over runs of bounded length."""
    counts, totals = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held: list[tuple[int, np.ndarray]] = []
    room = RUN

    def add() -> None:
        if held:
            bits = np.unpackbits(np.concatenate([h for _, h in held]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at = np.concatenate([[0], np.cumsum([len(h) for _, h in held])[:-1]])
            np.add.at(counts, [i for i, _ in held], np.add.reduceat(bits, at, axis=0, dtype=np.int64))
            held.clear()

    for i, text in enumerate(texts):
        h = _hashes(text, shingle)
        totals[i] = len(h)
        while len(h):
            held.append((i, h[:room]))
            h, room = h[room:], room - len(held[-1][1])
            if not room:
                add()
                room = RUN
    add()
    return np.packbits(2 * counts > totals[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, row (as read) and fp, the fingerprint as a signed long; with carry also doc, all columns as they are."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                fp = _fingerprints(batch.column(2).to_pylist(), shingle)
                columns = [batch.column(0), batch.column(1), pa.array(fp.view(np.int64)), *batch.columns[3:]]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "fp", *batch.schema.names[3:]])

    whole = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")] if carry else []
    rows = docs.select(F.col(id_column).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_column).alias("text"), *whole)
    schema = StructType([rows.schema["doc_id"], rows.schema["row"], StructField("fp", LongType()), *rows.schema.fields[3:]])
    return rows.mapInArrow(tidy(run), schema)


def choose_segments(nodes: DataFrame, distance: int = DISTANCE, options: tuple[int, ...] = (8, 16)) -> int:
    """The number of segments whose grid costs least: the probes that it sends out and the candidates that they meet, by the cells' measured sizes."""

    def cost(segments: int) -> float:
        sizes = nodes.select(F.expr(_cell(segments, distance)).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        found = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0))).first()
        steps = len(half_steps(segments, distance))
        return steps * (float(found[0]) + float(found[1]))  # a row's neighbours are about as crowded as its own cell

    return min(options, key=cost)


def _cell(segments: int, distance: int) -> str:
    """The packed cell number of column fp: a digit for each segment's bit count."""
    width = 64 // segments
    base = width + 2 * distance + 1  # of the cell number's digits: a bit count, moved by a step either way
    if base**segments >= 2**63:
        raise ValueError("the cells do not fit into a long")
    return " + ".join(f"(bit_count(shiftright(fp, {width * i}) & {(1 << width) - 1}L) + {distance}) * {base**i}L" for i in range(segments))


def half_steps(segments: int, distance: int) -> list[tuple[int, ...]]:
    """Grid steps within the Manhattan distance, one of each opposite pair, and the step of zero."""
    found = {()}
    for _ in range(segments):
        found = {(*s, d) for s, d in product(found, range(-distance, distance + 1)) if sum(map(abs, s)) + abs(d) <= distance}
    return sorted(s for s in found if next((d for d in s if d), 1) > 0)


def links(nodes: DataFrame, distance: int = DISTANCE, segments: int | None = None) -> DataFrame:
    """(u, v): pairs of different fingerprints (column fp, distinct) at Hamming distance of at most `distance`."""
    segments = segments or choose_segments(nodes, distance)
    base = 64 // segments + 2 * distance + 1
    packed = [sum(d * base**i for i, d in enumerate(s)) for s in half_steps(segments, distance)]
    grid = nodes.select("fp", F.expr(_cell(segments, distance)).alias("cell"))
    steps = F.explode(F.array(*(F.lit(p).cast("long") for p in packed)))
    probes = grid.select(F.col("fp").alias("u"), "cell", steps.alias("step")).select("u", F.expr("cell + step").alias("cell"), F.expr("step = 0").alias("same"))
    found = probes.join(by_shuffle(grid.withColumnRenamed("fp", "v")), "cell").where(f"bit_count(u ^ v) between 1 and {distance} and (not same or u < v)")
    return found.select("u", "v")


class NearDuplicates:
    def __init__(self, docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, segments: int | None = None, id_column: str = "doc_id", text_column: str = "text", carry: bool = False):
        self.fps = cut(fingerprints(docs, shingle, id_column, text_column, carry), "simhash-fingerprints")
        self.nodes = cut(self.fps.groupBy("fp").agg(F.min(order_key("doc_id")).alias("first")), "simhash-nodes")
        found = connected_components(links(self.nodes, distance, segments))
        rooted = self.nodes.join(by_shuffle(found.select(F.col("node").alias("fp"), "root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        labels = rooted.groupBy("root").agg(F.min("first").alias("component"))
        self.labels = cut(rooted.join(by_shuffle(labels), "root").select("fp", "component", "root"), "simhash-labels")

    def annotate(self) -> DataFrame:
        """doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable), root, row."""
        return self.fps.join(by_shuffle(self.labels), "fp").select(
            "doc_id",
            F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
            F.expr(f"if(component = {MAX_LONG}L, null, component)").alias("component_id"),
            "root",
            "row",
        )

    def dedup(self) -> DataFrame:
        """The documents (with carry) without all but one of each group: the one with the least doc_id (the first read, where it repeats).

        Only rows that a Bloom filter of the dropped ones does not clear shuffle."""
        rows = self.fps.select("fp", "row", "doc_id").join(by_shuffle(self.labels), "fp")
        stay = rows.groupBy("root").agg(F.min(F.struct(order_key("doc_id").alias("k"), "row")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        stay = cut(stay.select("root", F.col("first.row").alias("stay")), "simhash-stay")
        dropped = cut(rows.join(by_shuffle(stay), "root").where("row <> stay").select("row"), "simhash-dropped")
        clear, maybe = bloom.split(self.fps.select("row", "doc"), "row", dropped)
        return clear.select("doc.*").unionByName(maybe.join(by_shuffle(dropped), "row", "left_anti").select("doc.*"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    return NearDuplicates(docs, **options).annotate()


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    return NearDuplicates(docs, carry=True, **options).dedup()
