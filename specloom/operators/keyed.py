"""Stored tables in buckets by key: a merge reads and rewrites only the files that may hold a changed key.

A table's rows are dealt to buckets by a hash of some of their key columns, and a bucket is a few Parquet
files sorted by key. A manifest (a small Parquet table, a row for each file) says which files the table is,
with the range of their keys; beside it lie Bloom filters of 4 KB chunks. Looking for keys joins them with the
manifest by bucket and range, and with the filters by chunk: no data file is opened to find out that it
lacks a key. What a merge does not touch stays as it is, and is shared by both versions.

Entries of the store's log name the manifests, so that a commit of several tables shows all of them or none.
Writers conflict only where both change one bucket: otherwise the one that comes second puts its files into
the manifest that it then finds."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import held
from .snapshots import Conflict, Snapshots, delete, update, upsert

CHUNK_BITS, BITS_A_KEY = 32768, 12  # what one bitmap of bitmap_construct_agg holds
MOST_FILES = 8  # of a bucket, beyond those that its rows need; one more and they are written anew
FILE_ROWS = 1_000_000  # about so many rows go through one task and into one file; a bucket of more rows has several


@dataclass(frozen=True)
class Layout:
    """The key of a table, the key columns that deal its rows (all, unless some are given), the number of buckets, and over how
    many of them the rows of one value of these columns are spread (by their whole key), where a value may be hot."""

    keys: tuple[str, ...]
    buckets: int = 64
    by: tuple[str, ...] = ()
    spread: int = 1

    @property
    def dealt_by(self) -> list[str]:
        return list(self.by or self.keys)

    def _at(self, step: Column) -> Column:
        return F.pmod(F.pmod(F.xxhash64(*self.dealt_by), F.lit(self.buckets)) + step, F.lit(self.buckets)).cast("int")

    def bucket(self) -> Column:
        """The bucket of a row."""
        return self._at(F.pmod(F.xxhash64(*self.keys), F.lit(self.spread)))

    def buckets_of(self, keys: DataFrame) -> DataFrame:
        """keys (rows of the columns that deal) with each bucket that may hold them."""
        return keys.select("*", F.explode(F.sequence(F.lit(0), F.lit(self.spread - 1))).alias("_step")).withColumn("bucket", self._at(F.col("_step"))).drop("_step")


@dataclass
class Staged:
    """A change that is written but not committed: the rows of the files that it replaces, and those that take their place."""

    table: str
    buckets: list[int]
    seen: set[str]  # files of these buckets when the change was computed
    removed: list[str]
    added: list
    old: DataFrame
    new: DataFrame


class KeyedTables:
    def __init__(self, store: Snapshots, layouts: dict[str, Layout]):
        self.store, self.spark, self.layouts = store, store.spark, layouts

    # ---- reading -----------------------------------------------------------------------------

    def manifest(self, table: str) -> DataFrame:
        """bucket, file, rows, low, high, chunks, filters: a row for each file of the table as it stands."""
        return self._manifest(table, self.store._state()[1][table])

    def _manifest(self, table: str, state: dict) -> DataFrame:
        return self.spark.read.schema(self._manifest_schema(table, StructType.fromJson(state["schema"]))).parquet(state["manifest"])

    def _manifest_schema(self, table: str, schema: StructType) -> str:
        kind = schema[self.layouts[table].dealt_by[0]].dataType.simpleString()
        return f"bucket int, file string, rows bigint, low {kind}, high {kind}, chunks bigint, filters string"

    def read(self, table: str) -> DataFrame:
        state = self.store._state()[1][table]
        return self._files(state, [r["file"] for r in self._manifest(table, state).select("file").collect()])

    def _files(self, state: dict, files: Iterable[str]) -> DataFrame:
        """The rows of some files of a table; none for none."""
        files, schema = sorted(files), StructType.fromJson(state["schema"])
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def files_of(self, table: str, keys: DataFrame) -> list[str]:
        """Files that may hold one of the keys (rows of the columns that deal the table): by bucket, range and Bloom filter."""
        return self._files_of(table, self.manifest(table), keys)

    def _files_of(self, table: str, manifest: DataFrame, keys: DataFrame) -> list[str]:
        layout = self.layouts[table]
        by = layout.dealt_by
        wanted = layout.buckets_of(keys.select(*by).distinct()).withColumn("_h1", F.xxhash64(*by, F.lit(1))).withColumn("_h2", F.xxhash64(*by, F.lit(2)))
        near = wanted.join(manifest, "bucket").where(F.col(by[0]).between(F.col("low"), F.col("high")))
        folders = [r["filters"] for r in manifest.select("filters").distinct().collect()]  # a folder for each write
        if not folders:
            return []
        filters = self.spark.read.schema("file string, chunk bigint, bits binary").parquet(*folders)
        slots = near.select("file", "_h1", F.posexplode(F.array("_h1", "_h2")).alias("_i", "_h"), F.expr(f"chunks * {CHUNK_BITS}L").alias("_bits"))
        slots = slots.select("file", "_h1", F.expr("pmod(_h, _bits)").alias("_slot")).withColumn("chunk", F.expr(f"_slot div {CHUNK_BITS}"))
        byte = f"cast(conv(hex(substring(bits, cast((_slot % {CHUNK_BITS}) div 8 + 1 as int), 1)), 16, 10) as bigint)"
        hits = slots.join(filters, ["file", "chunk"]).where(F.expr(f"bit_get({byte}, cast(_slot % 8 as int)) = 1"))
        both = hits.groupBy("file", "_h1").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
        return [r["file"] for r in both.select("file").distinct().collect()]  # names of files, not rows

    def lookup(self, table: str, keys: DataFrame) -> DataFrame:
        """The rows of the given keys (all or some of the key columns, those that deal the table among them); other files are not opened."""
        state = self.store._state()[1][table]
        return self._files(state, self._files_of(table, self._manifest(table, state), keys)).join(keys.distinct(), keys.columns, "left_semi")

    # ---- writing -----------------------------------------------------------------------------

    def _write(self, table: str, rows: DataFrame, about: int, buckets: int) -> list:
        """Write rows, about so many in so many buckets, as new files, one for each of their buckets or more where these are large, and their filters: the manifest's rows."""
        layout, by = self.layouts[table], self.layouts[table].dealt_by
        folder, filters = (f"{self.store.root}/{table}/{kind}-{uuid.uuid4().hex}" for kind in ("data", "filters"))
        pieces = -(-about // (max(1, buckets) * FILE_ROWS)) or 1  # of a bucket, so that no task's rows grow with the table
        tasks = min(layout.buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions"))) if pieces == 1 else max(1, buckets) * pieces
        piece = F.pmod(F.xxhash64(*layout.keys, F.lit(3)), F.lit(pieces)).cast("int")
        dealt = rows.withColumn("_bucket", layout.bucket()).repartition(tasks, "_bucket", *([piece] if pieces > 1 else [])).sortWithinPartitions("_bucket", *layout.keys)
        dealt.write.partitionBy("_bucket").parquet(folder)
        path = self.store._path(folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not any(s.isDirectory() for s in fs.listStatus(path)):
            return []
        stored = self.spark.read.schema(StructType([*rows.schema.fields, StructField("_bucket", IntegerType())])).parquet(folder).select(*by, F.col("_bucket").alias("bucket"), F.input_file_name().alias("file"))
        chunks = F.ceil(F.count(F.lit(1)) * BITS_A_KEY / CHUNK_BITS).cast("bigint")
        files = stored.groupBy("bucket", "file").agg(F.count(F.lit(1)).alias("rows"), F.min(by[0]).alias("low"), F.max(by[0]).alias("high"), chunks.alias("chunks"))
        files = held(files.withColumn("filters", F.lit(filters)))
        bits = F.explode(F.array(*(F.pmod(F.xxhash64(*by, F.lit(seed)), F.col("chunks") * CHUNK_BITS) for seed in (1, 2)))).alias("_slot")
        slots = stored.join(files.select("file", "chunks"), "file").select("file", bits)
        slots.groupBy("file", F.expr(f"_slot div {CHUNK_BITS}").alias("chunk")).agg(F.expr(f"bitmap_construct_agg(_slot % {CHUNK_BITS})").alias("bits")).repartition(pieces, "file").sortWithinPartitions("file").write.parquet(filters)
        return files.collect()  # a row for each new file

    def _put_manifest(self, table: str, rows: DataFrame) -> str:
        path = f"{self.store.root}/{table}/manifest-{uuid.uuid4().hex}"
        rows.coalesce(1).write.parquet(path)
        return path

    def create(self, table: str, rows: DataFrame, about: int | None = None) -> None:
        """Write a table as a whole. Rows that are dear to compute twice come with about their number, others are counted."""
        added = self.spark.createDataFrame(self._write(table, rows, rows.count() if about is None else about, self.layouts[table].buckets), self._manifest_schema(table, rows.schema))
        manifest = self._put_manifest(table, added)
        while True:
            number, now = self.store._state()
            now[table] = {"version": now.get(table, {"version": 0})["version"] + 1, "folders": [], "manifest": manifest, "schema": rows.schema.jsonValue()}
            if self.store._put(number + 1, now):
                return

    def stage(self, table: str, changes: DataFrame, how: Callable[[DataFrame, DataFrame, list[str]], DataFrame] = upsert) -> Staged:
        """how(old, changes, keys) over the files that may hold a key of changes, written as new files. how must leave rows of other keys alone."""
        layout = self.layouts[table]
        changes = held(changes)
        state = self.store._state()[1][table]
        buckets = [r[0] for r in changes.select(layout.bucket()).distinct().collect()]  # at most as many as there are buckets
        manifest = [(r["bucket"], r["file"], r["rows"]) for r in self._manifest(table, state).select("bucket", "file", "rows").collect()]
        seen = {f for b, f, _ in manifest if b in set(buckets)}
        touched = set(self._files_of(table, self._manifest(table, state), changes))
        for bucket in buckets:
            own = {f: n for b, f, n in manifest if b == bucket}
            if len(own) >= MOST_FILES + sum(own.values()) // FILE_ROWS:
                touched |= set(own)
        old = self._files(state, touched)
        columns = StructType.fromJson(state["schema"])
        new = how(old, changes, list(layout.keys)).select(*(F.col(c.name).cast(c.dataType) for c in columns))
        added = self._write(table, new, sum(n for _, f, n in manifest if f in touched) + changes.count(), len(buckets))
        return Staged(table, buckets, seen, sorted(touched), added, old, self._files(state, [r["file"] for r in added]))

    def commit(self, *staged: Staged) -> None:
        """Make changes of different tables seen at once; Conflict if a bucket of one has changed since."""
        while True:
            number, now = self.store._state()
            for s in staged:
                rows = self._manifest(s.table, now[s.table])
                current = {r["file"] for r in rows.where(F.col("bucket").isin(s.buckets)).select("file").collect()}
                if current != s.seen:
                    raise Conflict(f"{s.table}: another writer has changed a bucket of these keys")
                kept = rows.where(~F.col("file").isin(s.removed)) if s.removed else rows
                added = self.spark.createDataFrame(s.added, rows.schema)
                now[s.table] |= {"version": now[s.table]["version"] + 1, "manifest": self._put_manifest(s.table, kept.unionByName(added))}
            if self.store._put(number + 1, now):
                return

    def merge(self, table: str, changes: DataFrame, how=upsert) -> Staged:
        staged = self.stage(table, changes, how)
        self.commit(staged)
        return staged

    def update(self, table: str, changes: DataFrame) -> Staged:
        return self.merge(table, changes, update)

    def delete(self, table: str, keys: DataFrame) -> Staged:
        return self.merge(table, keys, lambda old, gone, by: delete(old, gone.select(*by)))

    # ---- housekeeping ------------------------------------------------------------------------

    def vacuum(self, keep: int = 10, older_than: float = 86_400.0) -> int:
        """Remove what no entry of the newest `keep` names and no writer has touched for older_than seconds: files, filters, manifests, entries. The number removed."""
        return self.store.vacuum(keep, older_than)
