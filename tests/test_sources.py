"""Files, publication and the incremental ingest."""

import pytest
from pyspark.sql import functions as F

from drawfield.schema import MONTH
from drawfield.session import shared_dir
from drawfield.sources import readers, tables, writers
from drawfield.streaming.ingest import start_ingest


def test_format_cascade(spark, posterior):
    base = shared_dir(spark, "cascade")
    flat = posterior.select("month_id", "priogrid_id", F.get("pred_lr_ged_sb", F.lit(0)).alias("y"))
    flat.coalesce(1).write.parquet(f"{base}/unnamed")
    assert readers.read_any(spark, f"{base}/unnamed").count() == 8
    with pytest.raises(ValueError, match="pickled"):
        readers.read_any(spark, f"{base}/x.pkl")
    assert readers.format_of("a.bin", b"PAR1") == "parquet"
    with pytest.raises(ValueError, match="format"):
        readers.format_of("a.bin", b"abcd")


def test_damaged_parquet_is_an_error(spark, tmp_path):
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 this is not a table")
    with pytest.raises(Exception):
        readers.read_any(spark, str(tmp_path / "bad.parquet")).count()


def test_hash_states(spark):
    listed = spark.createDataFrame([("a", "AB"), ("b", "ff"), ("c", None), ("d", "00")], "name string, sha256 string")
    hashes = spark.createDataFrame([("a", "ab"), ("b", "ee"), ("c", "11")], "name string, actual string")
    got = {r["name"]: r["verdict"] for r in readers.verify_hashes(listed, hashes).collect()}
    assert got == {"a": "verified", "b": "mismatch", "c": "unverified", "d": "missing"}


def test_a_failed_publication_leaves_the_last_one(spark, posterior):
    base = shared_dir(spark, "publication")
    assert writers.published(spark, base).count() == 0
    assert writers.publish_run(posterior, "one", base, expected_rows=8)
    with pytest.raises(ValueError, match="expected 99"):
        writers.publish_run(posterior, "two", base, expected_rows=99)
    with pytest.raises(ValueError, match="duplicate"):
        writers.publish_run(posterior.unionByName(posterior), "three", base)
    assert [r["run_id"] for r in writers.published(spark, base).collect()] == ["one"]
    with pytest.raises(ValueError, match="not published"):
        writers.read_published(spark, base, "two")
    assert not writers.publish_run(posterior, "one", base)
    assert writers.publish_run(posterior, "two", base, expected_rows=8)
    assert writers.read_published(spark, base, "two").count() == 8


def test_dataset_roundtrip(spark, posterior, geo):
    path = writers.save_dataset(posterior, geo, shared_dir(spark, "set"))
    rows, places = writers.load_dataset(spark, path)
    assert rows.select(*posterior.columns).exceptAll(posterior).count() == 0 and places.count() == 4
    plan = rows.filter(F.col(MONTH) == 600)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month_id" in plan


def test_incremental_ingest(spark, sf_dir):
    runs = tables.wire_runs(spark, sf_dir, ("ok", "dup", "anon", "extra"))
    base, inbox = shared_dir(spark, "ingest"), shared_dir(spark, "inbox")

    def load(manifests):
        ids = manifests.select("run_id")
        return type(runs)(runs.draws.join(ids, "run_id", "left_semi"),
                          runs.headers.join(ids, "run_id", "left_semi"), manifests, runs.sidecar)

    def deliver(*names):
        runs.manifest.filter(F.col("run_id").isin(*names)).coalesce(1).write.mode("append").json(inbox)
        query = start_ingest(spark, inbox, load, base, f"{base}/progress")
        query.awaitTermination()

    deliver("run_dup", "run_ok", "run_extra")
    assert [r["run_id"] for r in writers.published(spark, base).collect()] == ["run_ok"]
    deliver("run_anon", "run_ok")      # delivered again: nothing is published twice
    assert [r["run_id"] for r in writers.published(spark, base).collect()] == ["run_ok"]
    want = tables.posterior(spark, sf_dir)
    got = writers.read_published(spark, base, "run_ok")
    assert got.select(*want.columns).exceptAll(want).count() == 0 and got.count() == want.count()


def test_manifests_shuffle_keys_only_and_are_stored_compressed(spark, sf_dir, tmp_path, monkeypatch):
    """Names and hashes of listed shards are made after the shuffle: they are most of a manifest's bytes."""
    from drawfield import plans
    from drawfield.plans import published
    monkeypatch.setattr(published, "shared_dir", lambda spark, purpose: str(tmp_path / purpose))
    jvm, store = spark._jvm, spark._jsc.sc().statusStore()

    def shuffled():
        none = jvm.java.util.ArrayList()
        stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = shuffled()
    rows = plans.queries()["manifest_shards"](spark, sf_dir).count()
    assert rows == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert shuffled() - before < 50 * rows
    assert {p.name[-8:] for p in (tmp_path / "manifest").glob("part-*")} == {".json.gz"}
