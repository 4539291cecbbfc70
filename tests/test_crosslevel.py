"""All levels from one sum of leaves: the same units and draws as level by level, for nested and for split units."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import GEO
from drawfield.operators import crosslevel, rollup, summarize
from drawfield.schema import LEVELS

TARGETS = ["pred_lr_ged_sb", "pred_lr_ged_ns"]


def geography(spark, split, seed=3):
    rng, rows = random.Random(seed), []
    for cell in range(60):
        district = cell // 3
        gaul1 = district // 2 if not split else (district + cell % 2) // 2
        iso = "ABC"[gaul1 // 4 % 3] * 3 if not split else rng.choice(["AAA", "BBB", "-99", None])
        rows.append((cell, 0.0, 0.0, iso, gaul1 if cell != 50 else None, f"G{gaul1}", gaul1 // 4, f"P{gaul1 // 4}",
                     None if split and cell % 11 == 0 else district, f"D{district}"))
    return spark.createDataFrame(rows + rows[:5], GEO)


def grid(spark, width, seed=4):
    rng = random.Random(seed)
    rows = [(m, c, *[[float(rng.randrange(50)) for _ in range(width)] for _ in TARGETS]) for m in (1, 2, 3) for c in range(62)]
    return spark.createDataFrame(rows, "month_id int, priogrid_id long, " + ", ".join(f"{t} array<float>" for t in TARGETS))


def as_dict(frame):
    return {(r.month_id, r.unit, r.target): list(r.draws) for r in frame.collect()}


@pytest.mark.parametrize("split, width, drop", [(False, 5, ()), (True, 5, ()), (True, 5, ("-99",)), (True, 300, ())])
def test_leaves_give_the_sums_of_every_level(spark, split, width, drop):
    geo, frame = geography(spark, split), grid(spark, width)
    got = crosslevel.joint_sum_levels(frame, geo, TARGETS, drop_codes=drop)
    assert set(got.columns) == {"month_id", "level", "unit", "target", "draws"}
    for level in LEVELS:
        alone = rollup.joint_sum(frame, geo, level, TARGETS, drop_codes=drop).withColumn("unit", F.col("unit").cast("string"))
        assert as_dict(got.filter(F.col("level") == level)) == as_dict(alone)


def test_nesting_tells_levels_of_single_leaves(spark):
    codes = crosslevel.leaf_codes(geography(spark, False).filter("admin1_gaul1_code IS NOT NULL"))
    assert crosslevel.nesting(codes) == ("gaul2",)
    assert crosslevel.nesting(codes.select("priogrid_id", "country"), ("country",)) == ("country",)
    assert crosslevel.nesting(crosslevel.leaf_codes(geography(spark, True))) == ()


def test_cells_are_shuffled_once_and_combined_first(spark):
    geo, frame = geography(spark, True), grid(spark, 4)
    plan = crosslevel.joint_sum_levels(frame, geo, TARGETS, width=4)._jdf.queryExecution().executedPlan().toString()
    # One aggregate reads cells, one adds up leaves; each is combined before its exchange.
    assert plan.count("HashAggregate(keys=[month_id") == 4 and plan.count("Exchange hashpartitioning(month_id") == 2
    assert sum("Scan" in line and "pred_lr_ged_sb" in line for line in plan.splitlines()) == 1


def test_summaries_of_all_levels(spark):
    geo, frame = geography(spark, False), grid(spark, 40)
    got = crosslevel.summarize_levels(frame, geo, TARGETS, months=[1, 3])
    for level in LEVELS:
        alone = summarize.summarize_level(frame, geo, level, TARGETS, months=[1, 3]).withColumn("unit", F.col("unit").cast("string"))
        mine = got.filter(F.col("level") == level).select(*alone.columns)
        assert sorted(map(tuple, mine.collect()), key=str) == sorted(map(tuple, alone.collect()), key=str)
    assert crosslevel.summarize_levels(frame, geo, TARGETS, ("country",)).columns[:3] == ["month_id", "level", "unit"]


def test_two_codes_of_one_cell_are_an_error(spark):
    geo = spark.createDataFrame([(1, 0.0, 0.0, "AAA", 1, "a", 1, "a", 1, "a"), (1, 0.0, 0.0, "AAA", 1, "a", 1, "a", 2, "b")], GEO)
    with pytest.raises(Exception, match="more than one gaul2 code"):
        crosslevel.joint_sum_levels(grid(spark, 3), geo, TARGETS, width=3).collect()


def test_a_vector_of_another_width_is_an_error(spark):
    frame = grid(spark, 3).unionByName(grid(spark, 4))
    with pytest.raises(Exception, match="expected 3 draws"):
        crosslevel.joint_sum_levels(frame, geography(spark, False), TARGETS, width=3).collect()


def test_empty_tables(spark):
    geo, frame = geography(spark, False), grid(spark, 3)
    assert crosslevel.joint_sum_levels(frame.limit(0), geo, TARGETS, width=3).count() == 0
    assert crosslevel.joint_sum_levels(frame, geo.limit(0), TARGETS, width=3).count() == 0
