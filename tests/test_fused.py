"""One scan of the draws for gates and assembly: the same verdicts and vectors as the two separate passes."""

import random

import pytest
from pyspark.sql import functions as F

from drawfield.operators import assemble, fused, gates
from drawfield.schema import SERIES
from drawfield.sources import tables

TARGETS = [f"lr_ged_{s}" for s in SERIES]


def shape(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def runs(spark, sf_dir):
    return tables.wire_runs(spark, sf_dir)


@pytest.fixture(scope="module")
def placed(runs, tmp_path_factory):
    return fused.Placed(runs, str(tmp_path_factory.mktemp("placed")))


def test_verdicts_are_those_of_the_separate_pass(runs, placed):
    assert shape(placed.gate_rows().collect()) == shape(gates.gate_rows(runs).collect())


def test_profile_is_that_of_the_draws(runs, placed):
    mine = placed.profile()
    assert shape(mine.collect()) == shape(gates.cell_profile(runs).select(*mine.columns).collect())


@pytest.mark.parametrize("chunk, tasks, shuffled", [(1, 5, False), (700, 3, True), (1 << 17, 4, True)])
def test_cells_cut_by_tasks_and_batches_are_put_together(spark, sf_dir, monkeypatch, tmp_path, chunk, tasks, shuffled):
    monkeypatch.setattr(fused, "CHUNK", chunk)
    run = tables.wire_runs(spark, sf_dir, ("ok", "half"))
    draws = run.draws.filter("priogrid_id < 6")
    draws = draws.repartition(tasks, F.rand(7)) if shuffled else draws.repartitionByRange(tasks, "shard", "priogrid_id", "sample")
    run = gates.Run(draws, run.headers, run.manifest, run.sidecar)
    placed = fused.Placed(run, str(tmp_path / "p"))
    keys = ("run_id", "target", "month_id", "priogrid_id")
    want = assemble.to_vectors(assemble.with_declared(gates.listed_draws(run), run.headers), keys)
    assert shape(placed.vectors(keys).collect()) == shape(want.collect())
    if shuffled:
        assert placed.split.count() > 0


def test_the_draws_are_scanned_once(spark, sf_dir, tmp_path):
    run = tables.wire_runs(spark, sf_dir, ("ok", "gap"))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    counted = gates.Run(run.draws.mapInArrow(count, run.draws.schema), run.headers, run.manifest, run.sidecar)
    placed = fused.Placed(counted, str(tmp_path / "p"))
    verdicts = {r.run_id: r.verdict for r in placed.verdicts().collect()}
    rows = placed.assemble(TARGETS, [r for r, v in verdicts.items() if v == "SERVABLE"]).count()
    assert verdicts == {"run_ok": "SERVABLE", "run_gap": "NOT SERVABLE"} and rows > 0
    assert seen.value == run.draws.count()


def test_runs_of_an_uneven_grid_are_assembled(spark, sf_dir, tmp_path):
    """Vectors that do not fill the last month's cells, and cells beyond the globe, leave a run as whole as it was."""
    import duckdb

    import oracle
    from drawfield import plans
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("vec_id < 48")
    far = vectors.filter("vec_id < 3").withColumn("vec_id", F.col("vec_id") + 5 * 10 ** 6)
    vectors.unionByName(far).write.parquet(str(tmp_path / "embeddings.parquet"))
    for name in ("nation", "region"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf_dir}/{name}.parquet")
    con = duckdb.connect()
    for name in ("embeddings.parquet/*", "nation", "region"):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    frame = plans.queries()["fused_assembly"](spark, str(tmp_path))
    assert frame.count() == 2 * 51
    assert oracle.compare(frame, con, plans.oracle_sql()["fused_assembly"]) is None


@pytest.mark.parametrize("samples, message", [([0, 1, 1], "missing or repeated"), ([0, 2], "missing or repeated"), ([0, 1, 2, 3], "missing or repeated|of declared")])
def test_faulty_vectors_are_an_error(spark, tmp_path, samples, message):
    draws = spark.createDataFrame([("r", "s", "t", 1, 7, i, 1.0) for i in samples],
                                  "run_id string, shard string, target string, month_id int, priogrid_id long, sample int, value float")
    headers = spark.createDataFrame([("r", "s", 3)], "run_id string, shard string, sample_count int")
    manifest = spark.createDataFrame([("r", [("s", "t", 1, None)])],
                                     "run_id string, shards array<struct<name:string,target:string,time_id:int,sha256:string>>")
    placed = fused.Placed(gates.Run(draws, headers, manifest, None), str(tmp_path / "p"))
    with pytest.raises(Exception, match=message):
        placed.vectors().collect()


def test_null_values_and_keys_and_no_rows(spark, tmp_path):
    kinds = "run_id string, shard string, target string, month_id int, priogrid_id long, sample int, value double"
    rng = random.Random(2)
    rows = [("r", None, "t", 1, 7, i, None if i == 1 else float(i)) for i in range(3)] + [("r", "s", "t", 1, None, i, 2.0) for i in range(2)]
    rng.shuffle(rows)
    pieces = fused.place(spark.createDataFrame(rows, kinds).coalesce(1)).collect()
    assert shape((r.shard, r.priogrid_id, r.rows, r.draws, r.loose) for r in pieces) == shape(
        [(None, 7, 3, [0.0, None, 2.0], None), ("s", None, 2, [2.0, 2.0], None)])
    assert fused.place(spark.createDataFrame([], kinds)).count() == 0
    broken = fused.place(spark.createDataFrame([("r", "s", "t", 1, 7, None, 1.0)], kinds)).first()
    assert broken.draws is None and broken.rows == 1


def test_no_draw_declared_gives_no_zeros(spark):
    """A width of 0 gives empty vectors, not two zeros."""
    frame = spark.createDataFrame([(1, [], None)], "id int, a array<float>, b array<float>")
    assert assemble.zero_fill(frame, ["a", "b"]).first()["b"] == []
    rows = spark.createDataFrame([(0, 0)], "low int, high int").select(assemble._upto(F.col("high")).alias("v"))
    assert rows.first()["v"] == []
