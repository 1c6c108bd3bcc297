"""Runs that were asked, their answers as they arrive, retries, and page lists of finished sections, as keyed state.

A section's state is its runs with attempt and outcome in buckets of some `BUCKET` runs by a hash of their ids, a list of
the page ranges that were answered, and counts. A micro-batch reads and writes each bucket that it meets once, so a
new answer costs a look-up and a change of one bucket however many came before, and many answers share them; the
buckets double as runs are added. An answer that comes again finds its run closed. A failed run is asked again at once, a run without
an answer when its timer goes off, `most` times at the most. A section leaves when its last run closes, with
the pages of its primary and its other runs in the order of seq, in which they need not have arrived."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: type is `asked` for a run that was sent, `succeeded` for its result, anything else for a failure.
EVENTS = "spec_id string, section_number string, custom_id string, type string, attempt int, seq bigint, is_primary boolean, start int, end int"
#: kind `retry`: a run to ask again, as which attempt; kind `section`: the lists of a section without open runs.
TRACKED = "kind string, spec_id string, section_number string, custom_id string, attempt int, primary_pages array<int>, reference_pages array<int>, n_failed bigint"
COLUMNS = [c.split()[0] for c in TRACKED.split(", ")]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OPEN, DONE, FAILED = "open", "done", "failed"
BUCKET = 64


class Runs:
    """The runs of a section during one call: a bucket is read when it is first met, and written by save() if it has changed."""

    def __init__(self, state, n: int, buckets: int):
        self.state, self.n, self.buckets = state, n, buckets
        self.read: dict[int, dict[str, tuple[int, str]]] = {}
        self.changed: set[int] = set()

    def _at(self, run: str) -> int:
        return zlib.crc32((run or "").encode()) & (self.buckets - 1)

    def _bucket(self, at: int) -> dict[str, tuple[int, str]]:
        if at not in self.read:
            found = self.state.getValue((at,)) if self.n else None
            self.read[at] = self._runs(found) if found else {}
        return self.read[at]

    @staticmethod
    def _runs(value) -> dict[str, tuple[int, str]]:
        return dict(zip(value[0], zip(value[1], value[2], strict=True), strict=True))

    def get(self, run: str) -> tuple[int, str] | None:
        return self._bucket(self._at(run)).get(run)

    def put(self, run: str, attempt: int, outcome: str) -> None:
        at = self._at(run)
        bucket = self._bucket(at)
        self.n += run not in bucket
        bucket[run] = (attempt, outcome)
        self.changed.add(at)

    def all(self) -> dict[str, tuple[int, str]]:
        for at in range(self.buckets):
            self._bucket(at)
        return {run: state for bucket in self.read.values() for run, state in bucket.items()}

    def save(self) -> None:
        if self.n > BUCKET * self.buckets:
            runs = self.all()
            while self.n > BUCKET * self.buckets:
                self.buckets *= 2
            self.read = {at: {} for at in range(self.buckets)}
            for run, state in runs.items():
                self.read[self._at(run)][run] = state
            self.changed = set(self.read)
        for at in self.changed:
            bucket = self.read[at]
            self.state.updateValue((at,), (list(bucket), [a for a, _ in bucket.values()], [o for _, o in bucket.values()]))


class RunTracker(StatefulProcessor):
    def __init__(self, patience_ms: int = 3_600_000, most: int = 3):
        self.patience_ms, self.most = patience_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buckets = handle.getMapState("buckets", "bucket int", "ids array<string>, attempts array<int>, outcomes array<string>")
        self.pages = handle.getListState("pages", "seq bigint, is_primary boolean, start int, end int")
        self.counts = handle.getValueState("counts", "open bigint, failed bigint, runs bigint, buckets int")

    def _counts(self) -> tuple[int, int, Runs]:
        n_open, n_failed, n, buckets = self.counts.get() if self.counts.exists() else (0, 0, 0, 1)
        return n_open, n_failed, Runs(self.buckets, n, buckets)

    def _save(self, n_open: int, n_failed: int, runs: Runs) -> None:
        runs.save()
        self.counts.update((n_open, n_failed, runs.n, runs.buckets))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n_open, n_failed, runs = self._counts()
        answered, out, asked = [], [], False
        for e in chain.from_iterable(batch.itertuples(index=False) for batch in rows):
            run, attempt = e.custom_id, 0 if pd.isna(e.attempt) else int(e.attempt)
            state = runs.get(run)
            if e.type == "asked":
                if state is None:
                    runs.put(run, 0, OPEN)
                    n_open, asked = n_open + 1, True
                continue
            now, outcome = state or (0, OPEN)
            n_open += state is None  # an answer that came before its request, or without one
            if outcome == DONE or (e.type != "succeeded" and (outcome == FAILED or attempt < now)):
                continue  # it has come before
            if e.type == "succeeded":
                runs.put(run, attempt, DONE)
                n_open, n_failed = n_open - (outcome == OPEN), n_failed - (outcome == FAILED)
                answered.append((int(e.seq), bool(e.is_primary), int(e.start), int(e.end)))
            elif self._again(runs, run, attempt, out, key):
                asked = True
            else:
                n_open, n_failed = n_open - 1, n_failed + 1
        if answered:
            self.pages.appendList(answered)
        self._save(n_open, n_failed, runs)
        if asked:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)
        yield from self._rows(key, out, n_open, n_failed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n_open, n_failed, runs = self._counts()
        if not n_open:
            return
        if any(t > expiredTimerInfo.getExpiryTimeInMs() for t in self.handle.listTimers()):
            return  # something was asked later: its timer looks at all open runs
        out = []
        late = [(run, attempt) for run, (attempt, outcome) in runs.all().items() if outcome == OPEN]
        for run, attempt in late:
            if not self._again(runs, run, attempt, out, key):
                n_open, n_failed = n_open - 1, n_failed + 1
        self._save(n_open, n_failed, runs)
        if n_open:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)
        yield from self._rows(key, out, n_open, n_failed)

    def _again(self, runs: Runs, run: str, attempt: int, out: list, key) -> bool:
        """Ask a run for the next time; False (and it has failed) if it has been asked often enough."""
        again = attempt < self.most
        runs.put(run, *((attempt + 1, OPEN) if again else (attempt, FAILED)))
        if again:
            out.append(("retry", *key, run, attempt + 1, None, None, None))
        return again

    def _rows(self, key, out: list, n_open: int, n_failed: int) -> Iterator[pd.DataFrame]:
        if not n_open:
            ranges = sorted(tuple(r) for r in self.pages.get())
            lists = [[p for _, own, start, end in ranges if own == primary for p in range(start, end + 1)] for primary in (True, False)]
            out = [*out, ("section", *key, None, None, *lists, n_failed)]
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)


def events(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def tracked(stream: DataFrame, patience_ms: int = 3_600_000, most: int = 3) -> DataFrame:
    """Retries and finished sections of a stream of events. Its query needs the state store that start() sets."""
    return stream.groupBy("spec_id", "section_number").transformWithStateInPandas(RunTracker(patience_ms, most), TRACKED, "append", "ProcessingTime")


def start(rows: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Write tracked rows to Parquet files, each micro-batch exactly once, over a state store that holds maps and lists.

    Reads what there is and ends, or goes on `every` so often (as "10 seconds"). Timers go off in batches: one that ends runs
    none without new data, as a pending timer would keep it from ending; one that goes on runs them."""
    spark = rows.sparkSession
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "true" if every else "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
