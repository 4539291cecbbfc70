"""File hashes in pieces, and the states of a run's artifacts."""

import hashlib

import pytest

from drawfield.operators import gates
from drawfield.schema import MANIFEST_SCHEMA
from drawfield.sources import digests


@pytest.mark.parametrize("whole, piece", [(10, 64), (1 << 20, 64), (0, 1 << 20)])
def test_digests_are_those_of_the_bytes(spark, tmp_path, whole, piece):
    want = {}
    for i, size in enumerate((0, 1, 63, 64, 65, 5000)):
        folder = tmp_path / f"run {i % 2}"
        folder.mkdir(exist_ok=True)
        data = bytes((i * 7 + k) % 256 for k in range(size))
        (folder / f"file {i}.bin").write_bytes(data)
        if size:  # an empty file counts as not delivered
            want[f"file {i}.bin"] = (size, hashlib.sha256(data).hexdigest())
    got = {r.name: (r.length, r.actual) for r in digests.file_digests(spark, str(tmp_path), whole, piece).collect()}
    assert got == want


def test_a_large_file_is_read_in_pieces(spark, tmp_path):
    (tmp_path / "big.bin").write_bytes(b"abc" * 4_000_000)
    row = digests.file_digests(spark, str(tmp_path), whole=1 << 20).first()
    assert row.actual == hashlib.sha256(b"abc" * 4_000_000).hexdigest() and row.length == 12_000_000


def test_written_files_are_dealt_over_tasks_and_read_once(spark, tmp_path):
    rows = [(f"run_{i % 3}", f"f{i}.txt", "é" * i + "\n") for i in range(40)]
    files = spark.createDataFrame(rows, "directory string, name string, content string").coalesce(1)
    assert digests.write_files(files, str(tmp_path / "out")) == 40
    assert {str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file()} == {f"{d}/{n}" for d, n, _ in rows}
    found = digests.file_digests(spark, str(tmp_path / "out"), whole=20)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("binaryFile") == 2
    assert "RepartitionByExpression" in plan and ", 8" in plan  # a given number of tasks, which AQE does not merge into one
    assert {(r.directory, r.name): r.actual for r in found.collect()} == {(d, n): hashlib.sha256(c.encode()).hexdigest() for d, n, c in rows}


def manifest(spark, shards, sidecar):
    return spark.createDataFrame([{"run_id": "r", "shards": [{"name": n, "target": "t", "time_id": 1, "sha256": h} for n, h in shards],
                                   "sidecar": sidecar and {"name": sidecar[0], "sha256": sidecar[1]}}], MANIFEST_SCHEMA)


FILES = [("r", "a", "aa"), ("r", "b", "bb"), ("r", "c", "cc"), ("r", "d", "dd"), ("r", "d", "ee"), ("r", "side", "55"), ("other", "e", "ee")]


def test_states(spark):
    listed = manifest(spark, [("a", "AA"), ("b", "xx"), ("c", None), ("d", "dd"), ("e", "ee"), ("../a", "aa"), ("a", " aa ")], ("side", ""))
    files = spark.createDataFrame(FILES, "run_id string, name string, actual string")
    got = sorted((r.name, r.state) for r in digests.artifact_states(listed, files).collect())
    assert got == sorted([("a", "verified"), ("a", "verified"), ("b", "mismatch"), ("c", "unverified"), ("d", "mismatch"), ("e", "missing"),
                          ("../a", "missing"), ("side", "unverified")])


def test_states_carry_the_delivered_hash(spark):
    listed = manifest(spark, [("a", "AA"), ("b", "xx"), ("d", "dd"), ("e", "ee")], None)
    files = spark.createDataFrame(FILES, "run_id string, name string, actual string")
    assert {(r.name, r.actual) for r in digests.artifact_states(listed, files).collect()} == {("a", "aa"), ("b", "bb"), ("d", "dd"), ("e", None)}


@pytest.mark.parametrize("shards, sidecar, wrong, missing", [
    ([("a", "aa")], ("side", "55"), 0, 0), ([("a", "aa")], ("side", "54"), 1, 0), ([("a", None)], ("side", None), 0, 0),
    ([("a", "ab"), ("b", "bc")], ("side", "55"), 2, 0), ([("a", "aa")], ("absent", None), 0, 1), ([("a", "aa")], ("../side", "55"), 0, 1)])
def test_hash_and_presence_gates(spark, shards, sidecar, wrong, missing):
    files = spark.createDataFrame(FILES, "run_id string, name string, actual string")
    headers = spark.createDataFrame([("r", n) for n, _ in shards], "run_id string, shard string")
    run = gates.Run(None, headers, manifest(spark, shards, sidecar), None, files)
    assert gates.content_hash_gate(run).first().problems == wrong
    assert gates.missing_artifacts_gate(run).first().problems == missing
    assert gates.content_hash_gate(gates.Run(None, headers, run.manifest, None)).first().problems == 0


@pytest.mark.parametrize("value, ok", [(0.0, True), (3.5, True), (-0.1, False), (float("nan"), False), (float("inf"), False), (None, False)])
def test_plausible_draws(spark, value, ok):
    from pyspark.sql import functions as F
    assert spark.createDataFrame([(value,)], "v float").select(gates.plausible(F.col("v")).alias("p")).first().p is ok
