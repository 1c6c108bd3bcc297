"""Page and file stores: readers over folders of objects, and writers."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.common import scratch
from ..schemas import BATCH_RESULT, schema

# Where objects of a project lie below the store's root.
ORIGINAL = r"([^/]+)/original/(\d+)"
ORIGINAL_PAGE = r"([^/]+)/original_pages/page_(\d{4,})\.pdf"
CONVERTED = r"([^/]+)/converted/(\d+)/(TEXT\.txt|IMAGE\.(?:png|jpe?g))"
SUBMITTAL = r"([^/]+)/submittals/package_(\d+)/([^/]+)/([^/]+)"


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table by its schema; filters on its columns reach the files."""
    return spark.read.schema(schema(name)).parquet(f"{root}/{name}")


def lookup(df: DataFrame, **keys) -> DataFrame:
    """Rows whose columns equal the given values; a list means any of them, and an empty list none."""
    for column, value in keys.items():
        df = df.where(F.col(column).isin(*value)) if isinstance(value, (list, tuple, set)) else df.where(F.col(column) == value)
    return df


LISTED = "path string, is_folder boolean, length bigint, modificationTime timestamp"
TASK_OBJECTS = 1000  # folders that a task lists, and objects that it reads, about
BATCH_BYTES = 16 << 20  # of contents in a batch that a task hands on


def _listing(root: str):
    """For mapInArrow over folders (path below root): what lies in each. Names that Spark takes as hidden are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = [f for f in store.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"))) if not f.base_name.startswith(".") and (not f.base_name.startswith("_") or "=" in f.base_name)]
                below = [f.base_name if not folder else f"{folder}/{f.base_name}" for f in found]
                kinds = [f.type == fs.FileType.Directory for f in found]
                columns = [pa.array(below, pa.string()), pa.array(kinds, pa.bool_()), pa.array([f.size for f in found], pa.int64()), pa.array([f.mtime for f in found], pa.timestamp("us", "UTC"))]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "is_folder", "length", "modificationTime"])

    return run


def _reading(root: str):
    """For mapInArrow over objects (path below root first): the same rows with their contents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            at, held, size = 0, [], 0
            for i, name in enumerate(batch.column(0).to_pylist()):
                with store.open_input_stream(f"{base}/{name}", compression=None) as file:
                    held.append(file.read())
                size += len(held[-1])
                if size >= BATCH_BYTES or i == batch.num_rows - 1:
                    part = batch.slice(at, len(held))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], names=[*part.schema.names, "content"])
                    at, held, size = i + 1, [], 0

    return run


def _dealt(paths: DataFrame) -> DataFrame:
    return paths.repartition(max(1, -(-paths.count() // TASK_OBJECTS)), "path")


def objects(spark: SparkSession, root: str, pattern: str = "*", content: bool = True, like: str | None = None) -> DataFrame:
    """path, length, modificationTime and, if asked for, content of the objects below root whose names match pattern and whose paths match the
    regular expression like. Without content no object is opened.

    Tasks list the folders, level by level, and store what they find: the driver sees numbers of folders, never names of objects. A folder is listed by one task."""
    level, at = spark.createDataFrame([("",)], "path string"), []
    while not at or (level := spark.read.schema(LISTED).parquet(at[-1]).where("is_folder").select("path")).head(1):
        at.append(scratch(spark, "listing"))
        _dealt(level).mapInArrow(_listing(root), LISTED).write.parquet(at[-1])
    found = spark.read.schema(LISTED).parquet(*at).where("not is_folder").drop("is_folder").where(F.regexp_extract("path", "[^/]*$", 0).rlike(fnmatch.translate(pattern)))
    if like:
        found = found.where(F.concat(F.lit("/"), "path").rlike(like))
    if content:
        found = _dealt(found).mapInArrow(_reading(root), "path string, length bigint, modificationTime timestamp, content binary")
    return found.withColumn("path", F.concat(F.lit(root.rstrip("/") + "/"), "path"))


def original_parts(spark: SparkSession, root: str) -> DataFrame:
    """spec_id, part (a number, so that part 10 follows part 9) and content of uploaded files."""
    p = F.col("path")
    return objects(spark, root, like=ORIGINAL).select(F.regexp_extract(p, ORIGINAL, 1).alias("spec_id"), F.regexp_extract(p, ORIGINAL, 2).cast("int").alias("part"), "content")


def page_counts(spark: SparkSession, root: str) -> DataFrame:
    p = F.col("path")
    pages = objects(spark, root, "page_*.pdf", content=False, like=ORIGINAL_PAGE)
    return pages.groupBy(F.regexp_extract(p, ORIGINAL_PAGE, 1).alias("spec_id")).agg(F.count(F.lit(1)).alias("n_pages"))


def has_original(spark: SparkSession, root: str, spec_id: str) -> bool:
    found = objects(spark, root, content=False).where(F.col("path").contains(f"/{spec_id}/original/"))
    return not found.limit(1).isEmpty()


def lenient_text(content: Column) -> Column:
    """Bytes as UTF-8; what is none becomes the replacement character."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.make_valid_utf8(content.cast("string")))


def converted_pages(spark: SparkSession, root: str, first: int | None = None, end: int | None = None) -> DataFrame:
    """spec_id, page_index, text and image of pages first <= index < end; a missing object leaves null."""
    p = F.col("path")
    found = objects(spark, root, like=CONVERTED).select(F.regexp_extract(p, CONVERTED, 1).alias("spec_id"), F.regexp_extract(p, CONVERTED, 2).cast("int").alias("page_index"), F.regexp_extract(p, CONVERTED, 3).alias("kind"), "content")
    if first is not None:
        found = found.where(F.col("page_index") >= first)
    if end is not None:
        found = found.where(F.col("page_index") < end)
    is_text = F.col("kind") == "TEXT.txt"
    return found.groupBy("spec_id", "page_index").agg(lenient_text(F.max(F.when(is_text, F.col("content")))).alias("text"), F.max(F.when(~is_text, F.col("content"))).alias("image"))


def pages_with_content(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """wanted (spec_id, page_index, ...) with text and image, null where the store has none."""
    return wanted.join(store, ["spec_id", "page_index"], "left")


def batch_results(spark: SparkSession, path: str) -> DataFrame:
    """Results of a batch, a JSON object a line; lines that are none become failures with the text as error."""
    lines = spark.read.schema(f"{BATCH_RESULT}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    bad = F.col("_corrupt").isNotNull() | F.col("type").isNull()
    return lines.withColumn("error", F.when(bad, F.coalesce("_corrupt", F.lit("no type"))).otherwise(F.col("error"))).withColumn("type", F.when(bad, "errored").otherwise(F.col("type"))).drop("_corrupt")


def write_objects(df: DataFrame, root: str, key: str = "key", content: str = "content") -> DataFrame:
    """Write each row's content under root/key from the tasks; key, bytes and error (null if it was written). Lazy: write or count the result."""
    rows = df.select(F.col(key).alias("key"), F.col(content).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            done = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    store.create_dir(f"{base}/{name}".rpartition("/")[0], recursive=True)
                    with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                        out.write(data or b"")
                    done.append((name, len(data or b""), None))
                except OSError as e:
                    done.append((name, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["key", "bytes", "error"])

    return rows.mapInArrow(run, "key string, bytes bigint, error string")


def numbered_parts(files: DataFrame, spec: str = "spec_id", contents: str = "contents") -> DataFrame:
    """Keys and contents of a project's uploaded files (an array), numbered from 1."""
    return files.select(spec, F.posexplode(contents).alias("_i", "content")).select(F.concat(F.col(spec), F.lit("/original/"), (F.col("_i") + 1).cast("string")).alias("key"), "content")


def converted_objects(pages: DataFrame) -> DataFrame:
    """Keys and contents of converted pages: a text and an image object for each page that has them."""
    base = F.concat("spec_id", F.lit("/converted/"), F.col("page_index").cast("string"), F.lit("/"))
    text = pages.where("text is not null").select(F.concat(base, F.lit("TEXT.txt")).alias("key"), F.encode("text", "UTF-8").alias("content"), "page_index")
    image = pages.where("image is not null").select(F.concat(base, F.lit("IMAGE.png")).alias("key"), F.col("image").alias("content"), "page_index")
    return text.unionByName(image)


def upload_metrics(written: DataFrame) -> DataFrame:
    """One row: attempts, successes, success_rate in percent. Which keys failed is a table: failed_uploads()."""
    from ..functions.scores import success_rate

    out = written.agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("error").isNull()).alias("successes"))
    return out.withColumn("success_rate", success_rate(F.col("successes"), F.col("attempts")))


def write_observed(objects: DataFrame, root: str, failures: str) -> tuple[int, int, float, int]:
    """Write objects once, count while they are written and store what failed as a table at `failures`: attempts, successes, success_rate in percent, failures."""
    seen = Observation()
    written = write_objects(objects, root).observe(seen, F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("error").isNull()).alias("successes"))
    failed_uploads(written).write.parquet(failures)
    n, good = seen.get["attempts"], seen.get["successes"]
    return n, good, 100.0 * good / n if n else 0.0, n - good


def failed_uploads(written: DataFrame) -> DataFrame:
    """key and error of what was not written."""
    return written.where("error is not null").select("key", "error")


def submittal_key(spec_id: Column, package_id: Column, unique: Column, name: Column) -> Column:
    return F.concat(spec_id, F.lit("/submittals/package_"), package_id.cast("string"), F.lit("/"), unique, F.lit("/"), name)


def remove_objects(spark: SparkSession, root: str, prefix: str) -> bool:
    """Remove what lies under root/prefix; False if nothing did. Uses the file systems that pyarrow knows."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root)
    info = store.get_file_info(f"{base}/{prefix}")
    if info.type == fs.FileType.NotFound:
        return False
    (store.delete_dir if info.type == fs.FileType.Directory else store.delete_file)(info.path)
    return True
