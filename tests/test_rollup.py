"""Joint sums, summaries per unit, and the published table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from drawfield.functions.ladder import collapse_matrix
from drawfield.operators import publish, rollup, subset, summarize
from drawfield.session import shared_dir

SB = ["pred_lr_ged_sb"]


def sums(frame):
    return {(r["month_id"], r["unit"]): r["draws"] for r in frame.collect()}


def test_hand_sum(spark, geo):
    rows = [(600, 100, [1.0, 2.0, 3.0]), (600, 101, [4.0, 5.0, 6.0]),
            (601, 100, [7.0, 8.0, 9.0]), (601, 101, [10.0, 11.0, 12.0])]
    frame = spark.createDataFrame(rows, "month_id int, priogrid_id long, pred_lr_ged_sb array<float>")
    got = sums(rollup.joint_sum(frame, geo, "gaul0", SB))
    assert got == {(600, 10): [5.0, 7.0, 9.0], (601, 10): [17.0, 19.0, 21.0]}


@pytest.mark.parametrize("level, units", [("country", {"AAA", "BBB"}), ("gaul0", {10, 20}), ("gaul1", {1, 2}),
                                          ("gaul2", {100, 101, 200, 201})])
def test_totals_are_conserved(posterior, geo, level, units):
    got = sums(rollup.joint_sum(posterior, geo, level, SB))
    assert {u for _, u in got} == units
    for month in (600, 601):
        cells = [r[0] for r in posterior.filter(F.col("month_id") == month).select(*SB).collect()]
        assert np.allclose(np.sum(cells, axis=0), np.sum([v for (m, _), v in got.items() if m == month], axis=0))


def test_cells_without_a_code_are_left_out(spark, posterior, geo):
    holes = geo.withColumn("admin2_gaul2_code", F.when(F.col("priogrid_id") != 101, F.col("admin2_gaul2_code")))
    assert {u for _, u in sums(rollup.joint_sum(posterior, holes, "gaul2", SB))} == {100, 200, 201}
    doubles = geo.withColumn("admin2_gaul2_code", F.when(
        F.col("priogrid_id") == 101, F.lit(float("nan"))).otherwise(F.col("admin2_gaul2_code").cast("double")))
    assert {u for _, u in sums(rollup.joint_sum(posterior, doubles, "gaul2", SB))} == {100, 200, 201}


@pytest.mark.parametrize("width", [128, 129, 300])
def test_wide_vectors_are_summed_in_blocks(spark, geo, width):
    rng = np.random.default_rng(width)
    values = rng.integers(0, 1000, (4, width)).astype(float)
    frame = spark.createDataFrame([(600, 100 + i, v.tolist()) for i, v in enumerate(values)],
                                  "month_id int, priogrid_id long, pred_lr_ged_sb array<float>")
    got = sums(rollup.joint_sum(frame, geo, "country", SB))
    assert got[(600, "AAA")] == (values[0] + values[1]).tolist()
    assert got[(600, "BBB")] == (values[2] + values[3]).tolist()


def test_ragged_vectors_are_an_error(spark, geo):
    frame = spark.createDataFrame([(600, 100, [1.0, 2.0]), (600, 101, [1.0])],
                                  "month_id int, priogrid_id long, pred_lr_ged_sb array<float>")
    with pytest.raises(Exception, match="expected 2 draws"):
        rollup.joint_sum(frame, geo, "country", SB, 2).collect()


def test_summary_is_the_collapse_of_the_sum(posterior, geo):
    got = {(r["month_id"], r["unit"]): r for r in
           summarize.summarize_level(posterior, geo, "country", SB).collect()}
    for key, draws in sums(rollup.joint_sum(posterior, geo, "country", SB)).items():
        want = collapse_matrix(np.array([draws]))
        for name, vector in want.items():
            assert got[key][f"pred_lr_ged_sb_{name}"] == vector[0]


def test_names_conflict(posterior, geo):
    torn = geo.withColumn("country_iso_a3", F.when(F.col("priogrid_id") == 100, "ZZZ").otherwise(F.col("country_iso_a3")))
    with pytest.raises(Exception, match="more than one"):
        summarize.summarize_level(posterior, torn, "gaul1", SB).collect()
    assert [r["unit"] for r in rollup.level_conflicts(torn, "gaul1").collect()] == [1]
    with pytest.raises(Exception, match="more than one identity"):
        publish.bulk_table(posterior, torn, SB).collect()
    assert [r["admin1_code"] for r in publish.hierarchy_conflicts(torn).collect()] == [1]


def test_unmapped_cells_are_no_conflict(posterior, geo):
    loose = geo.withColumn("admin1_gaul1_code", F.when(F.col("priogrid_id") < 102, F.lit(None).cast("long"))
                           .otherwise(F.col("admin1_gaul1_code")))
    assert publish.hierarchy_conflicts(loose).count() == 0
    assert {r["admin1_code"] for r in publish.bulk_table(posterior, loose, SB).collect()} == {2}


def test_bulk_shape(spark, posterior, geo):
    history = spark.createDataFrame([(600, 100, 3.0), (600, 101, 4.0)],
                                    "month_id int, priogrid_id long, lr_ged_sb double")
    rows = publish.bulk_table(posterior, geo, SB, history, ["lr_ged_sb"]).collect()
    assert len(rows[0]) == 45 and len(rows) == 4
    actual = {(r["month_id"], r["admin1_code"]): r["sb_actual"] for r in rows}
    assert actual == {(600, 1): 7.0, (600, 2): None, (601, 1): None, (601, 2): None}
    assert all(r["ns_map"] is None for r in rows)


def test_two_targets_of_one_series(posterior, geo):
    twice = posterior.withColumnRenamed(SB[0], "pred_lr_ged_sb_best").withColumn(
        "pred_lr_ged_sb_prob", F.col("pred_lr_ged_sb_best"))
    with pytest.raises(ValueError, match="more than one variable"):
        publish.bulk_table(twice, geo, ["pred_lr_ged_sb_best", "pred_lr_ged_sb_prob"])


def test_observed_sums_stay_in_double(spark, geo):
    big = 2.0 ** 24
    frame = spark.createDataFrame([(600, 100, big + 1), (600, 101, 1.0)], "month_id int, priogrid_id long, lr_ged_sb double")
    row = summarize.summarize_observed(frame, geo, "country", ["lr_ged_sb"]).first()
    assert row["lr_ged_sb_map"] == row["lr_ged_sb_hdi95_lower"] == row["lr_ged_sb_severe_scenario"] == big + 2


def test_summary_parameters(posterior, geo, spark):
    with pytest.raises(ValueError, match="alpha"):
        summarize.summarize_cells(posterior, SB, alpha=1.0)
    with pytest.raises(ValueError, match="scalars"):
        summarize.summarize_cells(spark.createDataFrame([(1, 1, 1.0)], "month_id int, priogrid_id long, y double"), ["y"])
    with pytest.raises(ValueError, match="unknown targets"):
        summarize.summarize_cells(posterior, SB, features=["nope"])
    with pytest.raises(ValueError, match="draw positions"):
        rollup.aggregated_subset(posterior, geo, "country", SB, draws=[-1])
    with pytest.raises(ValueError, match="level"):
        rollup.aggregated_subset(posterior, geo, None, SB)
    with pytest.raises(KeyError, match="unknown month_id"):
        summarize.summarize_cells(posterior, SB, months=[999], strict=True)
    assert summarize.summarize_cells(posterior, SB, months=[999]).count() == 0
    one = summarize.summarize_level(posterior, geo, "country", SB, draws=[0], codes=["AAA"]).collect()
    assert all(r["pred_lr_ged_sb_hdi95_lower"] == r["pred_lr_ged_sb_hdi95_upper"] for r in one) and len(one) == 2


def test_subset_rules(posterior, geo):
    assert subset.subset(posterior, SB, months=[]).count() == 0
    assert subset.subset(posterior, SB, months=600).count() == 4
    assert subset.cells_of_unit(geo, "country", ["XXX"]).count() == 0
    with pytest.raises(ValueError, match="unknown level"):
        subset.cells_of_unit(geo, "gaul9", [1])
    # a level alone only filters: rows stay cells
    assert subset.subset_at_level(posterior, geo, SB, "country", ["AAA"]).count() == 4
    with pytest.raises(Exception, match="outside a vector"):
        subset.subset(posterior, SB, draws=[5]).collect()


def test_empty_selection_keeps_its_columns(posterior, geo):
    empty = summarize.summarize_level(posterior, geo, "gaul1", SB, months=[1])
    assert empty.count() == 0 and "pred_lr_ged_sb_map" in empty.columns


def test_only_the_roll_up_shuffles_draws(spark, posterior, geo):
    """A small stored geography is checked per cell and broadcast; the draws move once, summed map-side."""
    base = shared_dir(spark, "plan")
    posterior.write.parquet(f"{base}/rows")
    geo.write.parquet(f"{base}/geo")
    posterior, geo = spark.read.parquet(f"{base}/rows"), spark.read.parquet(f"{base}/geo")
    plan = rollup.joint_sum(posterior, geo, "country", SB, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(month_id") == 1 and "partial_sum" in plan
    # The other exchange is the geography's: a cell and its code, no draws.
    assert plan.count("Exchange hashpartitioning") == plan.count("Exchange hashpartitioning(priogrid_id") + 1 == 2
    cells = summarize.summarize_cells(posterior, SB)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in cells


def test_a_large_geography_is_joined_without_broadcast(spark, posterior, geo):
    """Beyond the size limit the same plan falls back to a shuffled join with the same result."""
    want = sums(rollup.joint_sum(posterior, geo, "country", SB, 5))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        summed = rollup.joint_sum(posterior, geo, "country", SB, 5)
        assert sums(summed) == want
        assert "BroadcastHashJoin" not in summed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
