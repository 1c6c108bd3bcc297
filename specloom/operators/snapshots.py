"""Changes to stored tables as pure functions (old, changes) -> new, and snapshots that hold the results.

Parquet tables take no updates; a change writes a new snapshot folder and then moves the pointer to
it, so readers see the old table or the new one."""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import KEYS, REFERENCES
from .common import held


def upsert(old: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """old with changed and new rows; a null in changes keeps the old value. changes has one row per key and may lack columns."""
    c = changes.select(*keys, *(F.col(x).alias(f"_{x}") for x in changes.columns if x not in keys))
    joined = old.join(c, keys, "full_outer")
    return joined.select(*(F.col(x) if x in keys or x not in changes.columns else F.coalesce(f"_{x}", x).alias(x) for x in old.columns))


def update(old: DataFrame, changes: DataFrame, keys: list[str], blank_keeps: bool = False) -> DataFrame:
    """As upsert, but keys that old lacks are ignored; with blank_keeps an empty string keeps the old value too."""
    new = lambda x: F.nullif(F.col(f"_{x}"), F.lit("")) if blank_keeps and dict(changes.dtypes)[x] == "string" else F.col(f"_{x}")
    c = changes.select(*keys, *(F.col(x).alias(f"_{x}") for x in changes.columns if x not in keys))
    joined = old.join(c, keys, "left")
    return joined.select(*(F.col(x) if x in keys or x not in changes.columns else F.coalesce(new(x), F.col(x)).alias(x) for x in old.columns))


def append(old: DataFrame, new: DataFrame, ident: str = "id") -> DataFrame:
    """old and new rows; new ones get ids after the largest. Ids come from per-partition counts, so rows do not meet in one task."""
    top = old.agg(F.coalesce(F.max(ident), F.lit(0)).alias("_top"))
    rows = held(new.drop(ident).withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()))
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_row"))
    numbered = rows.withColumn("_i", within).join(F.broadcast(counts), "_part").join(F.broadcast(top), F.lit(True))
    numbered = numbered.withColumn(ident, (F.col("_top") + F.col("_before") + F.col("_i")).cast("bigint"))
    return old.unionByName(numbered.drop("_row", "_part", "_before", "_i", "_top"), allowMissingColumns=True)


def stamped(rows: DataFrame, new: bool, now: str | None = None) -> DataFrame:
    """rows with updated_at, and created_at if they are new, at a given time or now, in whole seconds."""
    at = F.date_trunc("second", F.lit(now).cast("timestamp") if now else F.current_timestamp())
    return rows.withColumns({c: at for c in (("created_at", "updated_at") if new else ("updated_at",))})


def delete(old: DataFrame, keys: DataFrame) -> DataFrame:
    """old without the rows whose key is in keys (all its columns)."""
    return old.join(keys.distinct(), keys.columns, "left_anti").select(*old.columns)


def cascade(tables: dict[str, DataFrame], table: str, keys: DataFrame) -> dict[str, DataFrame]:
    """All tables after a delete from one of them that follows references to children, and theirs."""
    out, queue = dict(tables), [(table, keys)]
    while queue:
        name, gone = queue.pop(0)
        if name not in out:
            continue
        rows = out[name].join(gone.distinct(), gone.columns, "left_semi")
        for child, column, parent, target in REFERENCES:
            if parent == name and child in out and target in rows.columns and column in out[child].columns:
                queue.append((child, rows.select(F.col(target).alias(column))))
        out[name] = delete(out[name], gone)
    return out


class Conflict(RuntimeError):
    """Another writer has moved a table that a commit was computed from."""


class Snapshots:
    """Tables under a folder: each write is a new Parquet folder, and an entry of the store's log says which folders each table is.

    An entry has the number after the newest one and is put in place only if there is none of that number yet, complete, by
    a rename that never overwrites. So a commit of several tables shows all of them or none, and of two writers one finds
    that it was overtaken: it goes on if the tables that it read still stand, and fails with Conflict otherwise."""

    MOST_FOLDERS = 100

    def __init__(self, spark: SparkSession, root: str, partition_by: dict[str, list[str]] | None = None):
        self.spark, self.root, self.partition_by = spark, root.rstrip("/"), partition_by or {}

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _state(self) -> tuple[int, dict[str, dict]]:
        """Number of the newest entry, and of each table its version and folders."""
        log = self._path(f"{self.root}/log")
        fs = log.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(log)] if fs.exists(log) else []
        numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit()]
        if not numbers:
            return 0, {}
        return max(numbers), self._entry(self._path(f"{self.root}/log/{max(numbers):012d}.json"))

    def _entry(self, path) -> dict[str, dict]:
        """An entry of the log, read on the driver: no job for a few lines."""
        stream = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, number: int, tables: dict[str, dict]) -> bool:
        """Put an entry in place; False if there is one of that number."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        temp, final = self._path(f"{self.root}/log/.{uuid.uuid4().hex}"), self._path(f"{self.root}/log/{number:012d}.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf)
        fs = final.getFileSystem(conf)
        out = fs.create(temp, False)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        try:
            context.rename(temp, final, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            fs.delete(temp, False)
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            return False
        return True

    def commit(self, tables: dict[str, DataFrame], read: dict[str, int] | None = None, added: dict[str, DataFrame] | None = None) -> None:
        """Write tables, and add rows to others, all at once. read has the versions of the tables that they were computed from.

        Rows are added as one more folder; every MOST_FOLDERS times the table is written anew with them."""
        tables, added, read, folders = dict(tables), dict(added or {}), dict(read or {}), {}
        for table, state in self._state()[1].items():
            if table in added and len(state["folders"]) >= self.MOST_FOLDERS:
                tables[table] = self.read(table).unionByName(added.pop(table))
                read.setdefault(table, state["version"])
        for table, df in [*tables.items(), *added.items()]:
            folders[table] = f"{self.root}/{table}/data-{uuid.uuid4().hex}"
            df.write.partitionBy(*self.partition_by.get(table, [])).parquet(folders[table])
        while True:
            number, now = self._state()
            for table, version in read.items():
                if now.get(table, {"version": 0})["version"] != version:
                    raise Conflict(f"{table} was version {version} when it was read and is version {now.get(table, {'version': 0})['version']} now")
            for table, folder in folders.items():
                old = now.get(table, {"version": 0, "folders": []})
                now[table] = {"version": old["version"] + 1, "folders": [*old["folders"], folder] if table in added else [folder]}
            if self._put(number + 1, now):
                return

    def write(self, table: str, df: DataFrame, version: int | None = None) -> None:
        """Write a table; with version only if that is the one that stands."""
        self.commit({table: df}, None if version is None else {table: version})

    def version(self, table: str) -> int:
        return self._state()[1].get(table, {"version": 0})["version"]

    def read(self, table: str) -> DataFrame:
        folders = self._state()[1][table]["folders"]
        if table not in self.partition_by:
            return self.spark.read.parquet(*folders)
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(f) for f in folders])  # each is the root of its own partitions

    def change(self, table: str, how, *args, **options) -> DataFrame:
        """Write how(table, ...) as the table's next snapshot; Conflict if another writer has changed the table meanwhile."""
        before = self.version(table)
        self.write(table, how(self.read(table), *args, **options), before)
        return self.read(table)

    def upsert(self, table: str, changes: DataFrame) -> DataFrame:
        return self.change(table, upsert, changes, KEYS[table])

    def vacuum(self, keep: int = 10, older_than: float = 86_400.0) -> int:
        """Remove log entries before the newest `keep`, and folders and files that none of those names and that are older than so many seconds
        (younger ones may be a writer's that has not committed yet). The number of things removed."""
        log, before, removed = self._path(f"{self.root}/log"), (time.time() - older_than) * 1000, 0
        fs = log.getFileSystem(self.spark._jsc.hadoopConfiguration())
        entries = sorted((f.getPath().getName(), f.getPath()) for f in fs.listStatus(log) if f.getPath().getName().endswith(".json"))
        named, tables = set(), set()
        for _, path in entries[-keep:]:
            for table, state in self._entry(path).items():
                tables.add(table)
                named |= {_name(x) for x in state["folders"]}
                if "manifest" in state and _name(state["manifest"]) not in named:
                    files = self.spark.read.parquet(state["manifest"]).select("file", "filters").collect()  # names of files
                    named |= {_name(state["manifest"])} | {_name(x) for r in files for x in r}
        for table in tables:
            for folder in fs.listStatus(self._path(f"{self.root}/{table}")):
                if _name(folder.getPath().toString()) in named or folder.getModificationTime() > before:
                    continue
                files = [f for b in fs.listStatus(folder.getPath()) if b.isDirectory() for f in fs.listStatus(b.getPath())]
                used = {f for f in files if _name(f.getPath().toString()) in named}
                gone = [f.getPath() for f in files if f not in used and not f.getPath().getName().startswith((".", "_"))] if used else [folder.getPath()]
                removed += sum(bool(fs.delete(path, True)) for path in gone)
        return removed + sum(bool(fs.delete(path, False)) for _, path in entries[:-keep])


def _name(path: str) -> str:
    """The last part of a path: names of folders and data files carry a random id of their own."""
    return path.rstrip("/").rsplit("/", 1)[-1]
