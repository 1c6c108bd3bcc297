"""Batch results as they arrive: files of JSON lines read as a stream and applied exactly once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators import classification as C
from ..operators.common import held
from ..operators.keyed import KeyedTables, Layout
from ..operators.snapshots import Snapshots
from ..schemas import BATCH_RESULT

STATE = "primary_pages array<int>, reference_pages array<int>, seen array<string>"
FOLDED = "spec_id string, section_number string, primary_pages array<int>, reference_pages array<int>, n_results bigint"


def result_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(BATCH_RESULT).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def flat(results: DataFrame) -> DataFrame:
    """Results with their key and the fields that folding reads."""
    return C.with_key(results.withColumn("is_primary", F.col("content.is_primary")))


def folded_sections(results: DataFrame) -> DataFrame:
    """A running table of page lists per section, in update mode: lists grow as results arrive, a result that comes again is ignored.

    The state of a section holds its page lists and the ids of its results, of which there is one for each run of its pages."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        primary, reference, seen = (list(x) for x in (state.get if state.exists else ([], [], [])))
        rows = pd.concat(batches).sort_values("seq", kind="stable").drop_duplicates("custom_id")
        rows = rows[~rows["custom_id"].isin(seen)]
        for pages, own in ((primary, rows[rows["is_primary"]]), (reference, rows[~rows["is_primary"]])):
            n = np.maximum(0, own["end"].to_numpy() - own["start"].to_numpy() + 1)
            pages.extend((np.repeat(own["start"].to_numpy() - np.cumsum(n) + n, n) + np.arange(n.sum())).tolist())
        seen.extend(rows["custom_id"])
        state.update((primary, reference, seen))
        yield pd.DataFrame([{"spec_id": key[0], "section_number": key[1], "primary_pages": primary, "reference_pages": reference, "n_results": len(seen)}])

    rows = C.succeeded(flat(results)).select("spec_id", "section_number", "custom_id", "seq", F.coalesce("is_primary", F.lit(False)).alias("is_primary"), "start", "end")
    return rows.groupBy("spec_id", "section_number").applyInPandasWithState(step, FOLDED, STATE, "update", "NoTimeout")


def apply_batch(batch: DataFrame, number: int, store: Snapshots) -> DataFrame | None:
    """Fold one micro-batch into the store's `sections`, exactly once: one commit moves `sections` and adds the batch's requests,
    with its number, to `applied`. A batch that runs again finds its number there and changes nothing (None); the results that count otherwise."""
    read = {t: store.version(t) for t in ("sections", "applied")}
    rows = C.latest_attempt(C.succeeded(flat(batch)), ["custom_id"])
    if read["applied"]:
        applied = store.read("applied")
        if not applied.where(F.col("batch") == number).isEmpty():
            return None
        rows = rows.join(applied.select("custom_id"), "custom_id", "left_anti")
    rows = rows.persist()
    keys = ["spec_id", "section_number"]
    sections = C.fold_pages(store.read("sections"), C.page_lists(rows, keys), keys)
    store.commit({"sections": sections}, read, {"applied": rows.select("custom_id", F.lit(number).cast("bigint").alias("batch"))})
    return rows


#: How apply_keyed() keeps the two tables that it moves.
LAYOUTS = {"sections": Layout(("spec_id", "section_number")), "applied": Layout(("custom_id",))}


def apply_keyed(batch: DataFrame, number: int, tables: KeyedTables) -> DataFrame | None:
    """apply_batch() over tables in buckets by key: reads and rewrites the files of this batch's sections and requests alone.

    Both tables move in one commit, so a batch that runs again finds all its requests applied and changes nothing (None)."""
    rows = C.latest_attempt(C.succeeded(flat(batch)), ["custom_id"])
    rows = held(rows.join(tables.lookup("applied", rows.select("custom_id")).select("custom_id"), "custom_id", "left_anti"))
    if rows.isEmpty():
        return None
    tables.commit(
        tables.stage("sections", C.page_lists(rows, ["spec_id", "section_number"]), C.fold_pages),
        tables.stage("applied", rows.select("custom_id", F.lit(number).cast("bigint").alias("batch"))),
    )
    return rows


def apply_stream(results: DataFrame, store: Snapshots | KeyedTables, checkpoint: str, done: Callable[[int, DataFrame], None] | None = None, trigger: dict | None = None) -> StreamingQuery:
    """apply_batch(), or for tables in buckets apply_keyed(), on every micro-batch. done is told of each batch that counted; a crash between the two leaves it untold."""

    def apply(batch: DataFrame, number: int) -> None:
        rows = apply_keyed(batch, number, store) if isinstance(store, KeyedTables) else apply_batch(batch, number, store)
        if rows is not None:
            try:
                if done:
                    done(number, rows)
            finally:
                rows.unpersist()

    writer = results.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def page_keys_of(requests: DataFrame) -> DataFrame:
    return requests.select("*", F.transform(T.page_range(F.col("start"), F.col("end")), lambda p: T.page_key(F.col("spec_id"), p)).alias("page_keys"))
