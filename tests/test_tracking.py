"""Runs tracked as keyed state: order, repeats, retries after failures and after silence, and what a restart keeps."""

import json
import time

from specloom.streaming import tracking


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def event(run, kind, attempt=None, seq=0, primary=True, start=1, end=1, section="033000"):
    return {"spec_id": "s", "section_number": section, "custom_id": run, "type": kind, "attempt": attempt, "seq": seq, "is_primary": primary, "start": start, "end": end}


def run(spark, tmp_path, **options):
    rows = tracking.tracked(tracking.events(spark, f"file://{tmp_path}/in", 1), **options)
    tracking.start(rows, f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"file://{tmp_path}/out").collect()


def test_order_repeats_and_restart(spark, tmp_path):
    write(tmp_path / "in", "1.json", [event(r, "asked") for r in "abc"] + [event("c", "succeeded", 0, 3, True, 7, 8)])
    assert run(spark, tmp_path) == []  # two runs are open
    write(tmp_path / "in", "2.json", [event("c", "succeeded", 0, 3, True, 7, 8), event("a", "succeeded", 0, 1, True, 2, 4)])
    write(tmp_path / "in", "3.json", [event("b", "succeeded", 0, 2, False, 9, 9), event("x", "succeeded", 0, 1, section="01")])
    rows = {r["section_number"]: r for r in run(spark, tmp_path)}
    assert set(rows) == {"033000", "01"}  # a result that nobody asked for stands for itself
    assert (rows["033000"]["primary_pages"], rows["033000"]["reference_pages"], rows["033000"]["n_failed"]) == ([2, 3, 4, 7, 8], [9], 0)
    write(tmp_path / "in", "4.json", [event("b", "succeeded", 0, 2, False, 9, 9), event("a", "errored", 0)])
    again = run(spark, tmp_path)
    assert {tuple(r["reference_pages"]) for r in again if r["section_number"] == "033000"} == {(9,)}


def test_failures_are_asked_again_until_they_have_failed(spark, tmp_path):
    write(tmp_path / "in", "1.json", [event("a", "asked"), event("b", "asked"), event("b", "succeeded", 0, 1)])
    write(tmp_path / "in", "2.json", [event("a", "errored", 0), event("a", "errored", 0)])  # told twice, asked again once
    rows = run(spark, tmp_path, most=2)
    assert [(r["kind"], r["custom_id"], r["attempt"]) for r in rows] == [("retry", "a", 1)]
    write(tmp_path / "in", "3.json", [event("a", "expired", 1)])
    write(tmp_path / "in", "4.json", [event("a", "errored", 2)])
    rows = run(spark, tmp_path, most=2)
    assert sorted(r["attempt"] for r in rows if r["kind"] == "retry") == [1, 2]
    assert [(r["primary_pages"], r["n_failed"]) for r in rows if r["kind"] == "section"] == [([1], 1)]
    write(tmp_path / "in", "5.json", [event("a", "succeeded", 3, 2, True, 5, 5)])  # a late answer still counts
    assert ([1, 5], 0) in [(r["primary_pages"], r["n_failed"]) for r in run(spark, tmp_path, most=2)]


def test_silence_is_asked_again_by_timers(spark, tmp_path):
    write(tmp_path / "in", "1.json", [event("a", "asked"), event("b", "asked"), event("b", "succeeded", 0, 1)])
    rows = tracking.tracked(tracking.events(spark, f"file://{tmp_path}/in"), patience_ms=500, most=1)
    query = tracking.start(rows, f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint", "200 milliseconds")
    try:
        for _ in range(120):
            time.sleep(0.5)
            out = spark.read.schema(tracking.TRACKED).parquet(f"file://{tmp_path}/out").collect() if (tmp_path / "out").exists() else []
            if any(r["kind"] == "section" for r in out):
                break
    finally:
        query.stop()
    assert [(r["custom_id"], r["attempt"]) for r in out if r["kind"] == "retry"] == [("a", 1)]
    assert [(r["primary_pages"], r["n_failed"]) for r in out if r["kind"] == "section"] == [([1], 1)]


class Buckets(dict):
    """A map state that counts its calls."""

    calls = 0

    def getValue(self, key):  # noqa: N802
        self.calls += 1
        return self.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1
        self[key] = value


def test_many_answers_share_state_calls():
    state, n, buckets, truth = Buckets(), 0, 1, {}
    for part in range(4):
        runs = tracking.Runs(state, n, buckets)
        for i in range(part * 500, part * 500 + 1000):  # half of them again
            assert runs.get(f"r{i}") == truth.get(f"r{i}")
            runs.put(f"r{i}", part, tracking.OPEN)
            truth[f"r{i}"] = (part, tracking.OPEN)
        runs.save()
        n, buckets = runs.n, runs.buckets
    assert n == len(truth) == 2500 and state.calls < 400  # 8,000 one by one
    assert tracking.Runs(state, n, buckets).all() == truth
    one = tracking.Runs(state, n, buckets)
    before = state.calls
    one.put("r7", 9, tracking.DONE)
    one.save()
    assert state.calls == before + 2  # a look-up and a change, whatever came before

