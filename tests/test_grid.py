"""Dense fill, backfill, normalisation and validation."""

import pytest
from pyspark.sql import functions as F

from drawfield.operators import grid, normalize, validate

KEYS = "month_id int, priogrid_id long"


def test_missing_cell_gets_a_full_vector(spark):
    frame = spark.createDataFrame([(600, 1, [1.0] * 8), (601, 1, [2.0] * 8), (601, 2, [3.0] * 8)],
                                  f"{KEYS}, pred_x array<float>")
    got = {(r[0], r[1]): r[2] for r in grid.dense_fill(frame).collect()}
    assert got[(600, 2)] == [0.0] * 8 and len(got) == 4


def test_cell_only_in_an_early_month_is_an_error(spark):
    frame = spark.createDataFrame([(600, 1, 1.0), (600, 2, 1.0), (601, 1, 2.0)], f"{KEYS}, y double")
    with pytest.raises(Exception, match="absent from the last month"):
        grid.dense_fill(frame).collect()
    assert [r["priogrid_id"] for r in grid.entities_absent_last_step(frame).collect()] == [2]


def test_dense_input_is_left_alone(spark):
    dense = spark.createDataFrame([(m, c, 1.0) for m in (1, 2) for c in (1, 2)], f"{KEYS}, y double")
    assert grid.is_dense(dense) and grid.dense_fill_if_needed(dense) is dense
    # one pair twice and one missing: the row count alone would look dense
    torn = spark.createDataFrame([(1, 1, 1.0), (1, 1, 1.0), (2, 1, 1.0), (2, 2, 1.0)], f"{KEYS}, y double")
    assert not grid.is_dense(torn)
    assert grid.dense_fill_if_needed(torn, 5.0).filter("y = 5.0").count() == 1


def test_fill_does_not_shuffle_the_vectors(spark):
    frame = spark.createDataFrame([(600, 1, [1.0]), (601, 1, [2.0]), (601, 2, [3.0])], f"{KEYS}, pred_x array<float>")
    plan = grid.dense_fill(frame)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert not any("pred_x" in line for line in exchanges)


def test_backfill_overwrites_the_whole_cell(spark):
    frame = spark.createDataFrame([(1, 1, None, "x"), (2, 1, "b", None), (3, 1, "c", "z"), (1, 2, "p", "q"), (2, 2, "r", "s")],
                                  f"{KEYS}, g string, h string")
    got = {(r[0], r[1]): (r[2], r[3]) for r in grid.geo_backfill(frame, ["g", "h"]).collect()}
    assert got[(1, 1)] == got[(2, 1)] == got[(3, 1)] == ("b", "x")
    assert got[(1, 2)] == ("p", "q") and got[(2, 2)] == ("r", "s")


def test_month_block(spark):
    frame = spark.createDataFrame([(1, 1, [1.0, 2.0]), (2, 1, [3.0, 4.0]), (2, 2, [5.0, 6.0])], f"{KEYS}, d array<float>")
    got = dict(grid.month_block(frame, 1, "d", positions=[1]).collect())
    assert got == {1: [2.0], 2: None}


def test_names_and_keys(spark, posterior):
    old = spark.createDataFrame([(1, 2, 3.0)], "month_id int, priogrid_gid long, y double")
    assert normalize.alias_key(old).columns == ["month_id", "priogrid_id", "y"]
    with pytest.raises(ValueError, match="key columns"):
        normalize.require_keys(old)
    assert normalize.targets_of(posterior) == ["pred_lr_ged_sb"]
    with pytest.raises(ValueError, match="no other values"):
        normalize.targets_of(posterior.withColumn("extra", F.lit(1)))
    plain = normalize.alias_key(old)
    with pytest.raises(ValueError, match="no target named"):
        normalize.targets_of(plain)
    assert normalize.targets_of(plain, ["y"]) == ["y"] and normalize.observed_targets(plain) == ["y"]
    with pytest.raises(ValueError, match="missing"):
        normalize.targets_of(plain, ["z"])
    with pytest.raises(ValueError, match="missing"):
        normalize.require_geography(plain)


def test_enforcement(spark, posterior, geo):
    validate.require_unique_keys(posterior)
    with pytest.raises(ValueError, match="duplicate"):
        validate.require_unique_keys(posterior.unionByName(posterior))
    validate.require_uniform_draws(posterior, ["pred_lr_ged_sb"])
    ragged = posterior.withColumn("pred_lr_ged_sb", F.when(
        F.col("priogrid_id") == 100, F.slice("pred_lr_ged_sb", 1, 2)).otherwise(F.col("pred_lr_ged_sb")))
    with pytest.raises(ValueError, match="different length"):
        validate.require_uniform_draws(ragged, ["pred_lr_ged_sb"])
    validate.require_plausible_values(posterior, ["pred_lr_ged_sb"])
    for bad in (float("nan"), float("inf"), -1.0):
        spoiled = posterior.withColumn("pred_lr_ged_sb", F.transform(
            "pred_lr_ged_sb", lambda x, i: F.when(i == 2, F.lit(bad).cast("float")).otherwise(x)))
        with pytest.raises(ValueError, match="implausible draws"):
            validate.require_plausible_values(spoiled, ["pred_lr_ged_sb"])


@pytest.mark.parametrize("column, value, ok", [
    ("pg_xcoord", 181.0, False), ("pg_xcoord", 180.0, True), ("pg_ycoord", -90.5, False),
    ("country_iso_a3", "A1B", False), ("country_iso_a3", "ABCD", False), ("country_iso_a3", "-99", True),
    ("country_iso_a3", None, True), ("admin1_gaul1_code", -3727, True)])
def test_geography(geo, column, value, ok):
    changed = geo.withColumn(column, F.lit(value).cast(geo.schema[column].dataType))
    if ok:
        validate.require_plausible_geography(changed)
    else:
        with pytest.raises(ValueError, match="implausible geography"):
            validate.require_plausible_geography(changed)
