"""Converted pages packed into containers: a file of many pages with an index of their places at its end.

A store of an object per page is listed on the driver and opens a file for every page. Here a task writes one
container: contents one after the other, then an Arrow table of (spec_id, page_index, places), its length and a
mark. Its commit message carries the range of projects and pages in it; the driver adds them as one small file
to the list of containers, by which a write is seen whole or not at all. A reader takes from the list the
containers whose ranges meet the wanted projects and pages, a partition each; a task reads the index and then only the
places of pages that match.

`write_pages` deals pages by ranges of project and page, so that few containers hold a range."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "spec_id string, page_index int, text binary, image binary"
INDEX = pa.schema([("spec_id", pa.string()), ("page_index", pa.int32()), *((f"{c}_{x}", pa.int64()) for c in ("text", "image") for x in ("at", "bytes"))])
ROWS = pa.schema([("spec_id", pa.string()), ("page_index", pa.int32()), ("text", pa.binary()), ("image", pa.binary())])
MARK = b"PAGES1\n\0"
BATCH_BYTES = 16 << 20  # of contents in a batch that a reader hands on


@dataclass
class Written(WriterCommitMessage):
    """A container and the least and greatest of its projects and pages; no file for a task without pages."""

    file: str
    pages: int
    spec_id: tuple[str | None, str | None]
    page_index: tuple[int | None, int | None]


@dataclass
class Container(InputPartition):
    file: str


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class ContainerWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = _open(self.path)
        name, at, index = f"{uuid.uuid4().hex}.pages", 0, []
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/{name}", compression=None) as out:
            for batch in iterator:
                for row in batch.cast(ROWS).to_pylist():
                    places = []
                    for content in (row["text"], row["image"]):
                        places += (None, None) if content is None else (at, len(content))
                        if content:
                            out.write(content)
                            at += len(content)
                    index.append((row["spec_id"], row["page_index"], *places))
            table = pa.table([pa.array([r[i] for r in index], f.type) for i, f in enumerate(INDEX)], INDEX)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, INDEX) as stream:
                stream.write_table(table)
            footer = sink.getvalue()
            out.write(footer)
            out.write(len(footer).to_bytes(8, "little") + MARK)
        if not index:
            store.delete_file(f"{base}/{name}")
            return Written("", 0, (None, None), (None, None))
        ends = (pc.min_max(table[c]).as_py() for c in ("spec_id", "page_index"))
        return Written(name, len(index), *((e["min"], e["max"]) for e in ends))

    def commit(self, messages: list[Written | None]) -> None:
        store, base = _open(self.path)
        store.create_dir(f"{base}/list", recursive=True)
        old = [f.path for f in _lists(store, base)] if self.overwrite else []
        name = uuid.uuid4().hex
        with store.open_output_stream(f"{base}/list/.{name}") as out:
            out.write(json.dumps([asdict(m) for m in messages if m and m.pages]).encode())
        store.move(f"{base}/list/.{name}", f"{base}/list/{name}.json")
        for path in old:  # their containers are named by nothing then
            store.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        store, base = _open(self.path)
        for m in messages:
            if m and m.pages:
                store.delete_file(f"{base}/{m.file}")


def _lists(store, base: str) -> list:
    from pyarrow import fs

    return [f for f in store.get_file_info(fs.FileSelector(f"{base}/list", allow_not_found=True)) if f.path.endswith(".json")]


class ContainerReader(DataSourceReader):
    def __init__(self, path: str, only: list[str] | None = None, first: int | None = None, end: int | None = None):
        self.path, self.only, self.first, self.end = path.rstrip("/"), only, first, end

    def _meets(self, container: dict) -> bool:
        """The container's ranges meet the conditions."""
        if container["spec_id"][0] is None or container["page_index"][0] is None:
            return not self.only and self.first is None and self.end is None
        low, high = container["spec_id"]
        first, last = container["page_index"]
        return (self.only is None or any(low <= s <= high for s in self.only)) and (self.first is None or last >= self.first) and (self.end is None or first < self.end)

    def partitions(self) -> list[Container]:
        store, base = _open(self.path)
        found = [Container(c["file"]) for f in _lists(store, base) for c in json.loads(store.open_input_stream(f.path).read()) if self._meets(c)]
        return found or [Container("")]

    def read(self, partition: Container) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store, base = _open(self.path)
        with store.open_input_file(f"{base}/{partition.file}") as file:
            size = file.size()
            end = file.read_at(16, size - 16)
            if end[8:] != MARK:
                raise ValueError(f"{partition.file} is no container of pages")
            length = int.from_bytes(end[:8], "little")
            table = pa.ipc.open_stream(file.read_at(length, size - 16 - length)).read_all()
            if self.only is not None:
                table = table.filter(pc.is_in(table["spec_id"], pa.array(self.only, pa.string())))
            if self.first is not None:
                table = table.filter(pc.greater_equal(table["page_index"], self.first))
            if self.end is not None:
                table = table.filter(pc.less(table["page_index"], self.end))
            rows, held = [], 0
            for r in table.to_pylist():
                contents = [None if r[f"{c}_at"] is None else file.read_at(r[f"{c}_bytes"], r[f"{c}_at"]) for c in ("text", "image")]
                rows.append((r["spec_id"], r["page_index"], *contents))
                held += sum(map(len, filter(None, contents)))
                if held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(ROWS)], schema=ROWS)


class PageContainers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_containers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ContainerReader:
        return ContainerReader(self.options["path"], **json.loads(self.options.get("where", "{}")))

    def writer(self, schema, overwrite: bool) -> ContainerWriter:
        return ContainerWriter(self.options["path"], overwrite)


def write_pages(pages: DataFrame, path: str, containers: int = 0, mode: str = "append") -> None:
    """Pages (spec_id, page_index, text, image) as containers, by ranges of project and page: as many as the session's shuffle partitions, or as are given."""
    pages.sparkSession.dataSource.register(PageContainers)
    rows = pages.select("spec_id", "page_index", *(pages[c].cast("binary").alias(c) for c in ("text", "image")))
    by = ["spec_id", "page_index"]
    ranged = rows.repartitionByRange(containers, *by) if containers else rows.repartitionByRange(*by)
    ranged.sortWithinPartitions(*by).write.format("page_containers").option("path", path).mode(mode).save()


def read_pages(spark: SparkSession, path: str, only: list[str] | None = None, first: int | None = None, end: int | None = None) -> DataFrame:
    """spec_id, page_index, text, image (bytes) of the given projects (all by default) and pages first <= index < end.

    The conditions are the source's own, and no filters that Spark pushes: Spark 4.1 keeps pushed ones for later queries over the same DataFrame."""
    spark.dataSource.register(PageContainers)
    where = json.dumps({"only": only, "first": first, "end": end})
    return spark.read.format("page_containers").option("path", path).option("where", where).load()
