"""Commits by two publishers at once, and manifests that wait for their shards."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from drawfield.schema import CELL, MONTH
from drawfield.sources import tables, writers
from drawfield.streaming import ingest


def test_one_of_two_publishers_wins(spark, posterior, tmp_path):
    base, results = str(tmp_path), []

    def publish(shift):
        frame = posterior.withColumn(CELL, F.col(CELL) + shift)
        results.append((shift, writers.publish_run(frame, "run_x", base)))

    threads = [threading.Thread(target=publish, args=(s,)) for s in (0, 1000, 2000)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    winners = [s for s, won in results if won]
    assert len(results) == 3 and len(winners) == 1
    assert writers.published(spark, base).count() == 1
    assert writers.read_published(spark, base, "run_x").agg(F.min(CELL)).first()[0] == 100 + winners[0]


def test_commits_of_different_runs_never_share_a_number(spark, tmp_path):
    base = str(tmp_path)
    threads = [threading.Thread(target=writers._commit, args=(spark, base, f"{base}/a{i}", {f"run_{i}": 1, "shared": 2})) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    rows = writers.published(spark, base).collect()
    assert sorted(r.run_id for r in rows) == sorted(["shared", *[f"run_{i}" for i in range(6)]])
    assert writers._next_version(spark, base) == 6


@pytest.mark.parametrize("number", [0, 1, 2, 3, 7, 8, 9, 20])
def test_the_next_number(spark, tmp_path, number):
    for i in range(number):
        assert writers.create_once(spark, writers._log_file(str(tmp_path), i), "{}")
    assert writers._next_version(spark, str(tmp_path)) == number
    if number:
        assert not writers.create_once(spark, writers._log_file(str(tmp_path), number - 1), "{}")


def test_several_runs_are_one_write_by_run_and_month(spark, posterior, tmp_path):
    base = str(tmp_path)
    frame = posterior.withColumn("run_id", F.explode(F.array(F.lit("7"), F.lit("a/b=c"), F.lit("007"))))
    assert writers.publish_runs(frame, base) == {"7", "a/b=c", "007"}
    assert writers.publish_runs(frame, base) == set()
    paths = {r.path for r in writers.published(spark, base).collect()}
    assert len(paths) == 1 and spark.read.json(f"{base}/log/00000000000000000000.json").count() == 3
    for run_id in ("7", "a/b=c", "007"):
        back = writers.read_published(spark, base, run_id)
        assert back.columns == posterior.columns and sorted(map(tuple, back.collect())) == sorted(map(tuple, posterior.collect()))
    plan = writers.read_published(spark, base, "7").filter(F.col(MONTH) == 600)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "run" in plan.split("PartitionFilters")[1][:200]


def test_a_publisher_lost_before_its_commit_leaves_nothing(spark, posterior, tmp_path, monkeypatch):
    base = str(tmp_path)
    with monkeypatch.context() as m:
        m.setattr(writers, "create_once", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            writers.publish_run(posterior, "r", base)
    assert writers.published(spark, base).count() == 0
    assert writers.publish_run(posterior, "r", base) and writers.published(spark, base).count() == 1


# --- waiting -----------------------------------------------------------------------------

@pytest.fixture
def desk(spark, sf_dir, tmp_path):
    """An inbox for manifests and one for files, with an ingest that can be started and stopped."""
    runs = tables.wire_runs(spark, sf_dir, ("ok", "dup"))
    manifests = {r["run_id"]: r for r in map(json.loads, runs.manifest.toJSON().collect())}

    class Desk:
        base, outcomes = str(tmp_path / "base"), {}

        def __init__(self):
            for name in ("manifests", "files", "base"):
                (tmp_path / name).mkdir()

        def manifest(self, run_id, name, **change):
            target = tmp_path / "manifests" / f"{name}.json"
            (tmp_path / "part").write_text(json.dumps(manifests[run_id] | change))
            (tmp_path / "part").rename(target)

        def files(self, run_id, keep=lambda n: True):
            m = manifests[run_id]
            (tmp_path / "files" / run_id).mkdir(exist_ok=True)
            for name in [s["name"] for s in m["shards"]] + [m["sidecar"]["name"]]:
                if keep(name):
                    (tmp_path / "files" / run_id / name).write_bytes(b"x")

        def load(self, manifest):
            ids = manifest.select("run_id")
            return type(runs)(runs.draws.join(ids, "run_id", "left_semi"), runs.headers.join(ids, "run_id", "left_semi"), manifest, runs.sidecar)

        def start(self, wait_ms):
            stream = ingest.waiting_runs(ingest.manifest_stream(spark, str(tmp_path / "manifests")),
                                         ingest.arrival_stream(spark, str(tmp_path / "files"), "*"), wait_ms)
            return ingest.run_waiting(stream, self.load, self.base, str(tmp_path / "progress"), self.outcomes.update)

        def until(self, condition, seconds=60):
            end = time.time() + seconds
            while not condition() and time.time() < end:
                time.sleep(0.5)
            assert condition(), self.outcomes

    return Desk()


def rounds(query, batches=2, seconds=60):
    """Wait for some more batches: a query with timers always has a next one, so it never counts as idle."""
    def batch():
        return query.lastProgress.batchId if query.lastProgress else -1
    first, end = batch(), time.time() + seconds
    while batch() < first + batches and time.time() < end:
        assert query.isActive, query.exception()
        time.sleep(0.2)
    assert batch() >= first + batches


def test_a_manifest_waits_for_its_shards(spark, desk):
    desk.manifest("run_ok", "a")
    desk.files("run_ok", lambda n: "lr_ged_os" not in n)
    query = desk.start(600_000)
    try:
        rounds(query)
        assert desk.outcomes == {} and writers.published(spark, desk.base).count() == 0
    finally:
        query.stop()
    desk.files("run_ok", lambda n: "lr_ged_os" in n)   # after the driver was lost
    desk.files("run_dup")                              # files before their manifest
    query = desk.start(600_000)
    try:
        desk.until(lambda: desk.outcomes == {"run_ok": "SERVABLE"})
        desk.manifest("run_ok", "c")                   # the same manifest again
        desk.manifest("run_dup", "b")
        desk.until(lambda: "run_dup" in desk.outcomes)
        rounds(query)
    finally:
        query.stop()
    assert desk.outcomes == {"run_ok": "SERVABLE", "run_dup": "NOT SERVABLE"}
    assert [r.run_id for r in writers.published(spark, desk.base).collect()] == ["run_ok"]


def test_late_runs_and_conflicts_are_told(spark, desk):
    query = desk.start(2_000)
    try:
        desk.manifest("run_ok", "a")
        desk.files("run_ok", lambda n: "m000258" in n)
        desk.until(lambda: desk.outcomes.get("run_ok") == "late")
        desk.files("run_ok", lambda n: "m000258" not in n)   # complete after all
        desk.until(lambda: desk.outcomes.get("run_ok") == "SERVABLE")
        desk.manifest("run_dup", "b")
        desk.manifest("run_dup", "c", expected_cell_count=3)
        desk.until(lambda: desk.outcomes.get("run_dup") == "conflict")
    finally:
        query.stop()
    assert [r.run_id for r in writers.published(spark, desk.base).collect()] == ["run_ok"]


def test_two_manifests_of_one_run_in_a_batch_are_refused(spark, sf_dir, tmp_path):
    runs = tables.wire_runs(spark, sf_dir, ("ok",))
    both = runs.manifest.unionByName(runs.manifest.withColumn("expected_cell_count", F.lit(1).cast("long")))
    got = ingest.ingest_manifests(both, lambda m: type(runs)(runs.draws, runs.headers, m, runs.sidecar), str(tmp_path))
    assert got == {"run_ok": ingest.CONFLICT} and writers.published(spark, str(tmp_path)).count() == 0
