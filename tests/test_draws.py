"""Hand-made vectors with known answers."""

import pytest
from pyspark.sql import functions as F

from drawfield.functions import calendar, draws
from drawfield.operators import raster


def value(spark, vector, make, kind="array<double>"):
    return spark.createDataFrame([(vector,)], f"d {kind}").select(make(F.col("d")).alias("v")).first()["v"]


@pytest.mark.parametrize("vector, tail, want", [
    (list(map(float, range(100))), 0.05, 97.0), (list(map(float, range(10))), 1.0, 4.5),
    ([3.0, 9.0, 1.0], 0.05, 9.0)])
def test_expected_shortfall(spark, vector, tail, want):
    assert value(spark, vector, lambda c: draws.expected_shortfall(c, tail)) == want


@pytest.mark.parametrize("tail", [0, -0.1, 1.5])
def test_tail_range(tail):
    with pytest.raises(ValueError):
        draws.expected_shortfall(F.col("d"), tail)


@pytest.mark.parametrize("vector, threshold, want", [
    ([10.0, 20.0, 30.0, 40.0], 5, 1.0), ([10.0, 20.0, 30.0, 40.0], 25, 0.5),
    ([10.0, 20.0, 30.0, 40.0], 40, 0.0), ([0.0, 0.0, 0.0, 7.0], 0, 0.25), ([1.0, 50.0, 200.0], 25, 2 / 3)])
def test_exceedance(spark, vector, threshold, want):
    assert value(spark, vector, lambda c: draws.exceedance(c, threshold)) == want


def test_nan_is_cleaned_before_it_is_compared(spark):
    assert value(spark, [float("nan"), 1.0], lambda c: draws.exceedance(draws.clean(c), 25)) == 0.0
    assert value(spark, [float("nan")] * 2, lambda c: draws.exceedance(draws.clean(c), 25)) is None


@pytest.mark.parametrize("vector, how, want", [
    ([1.0, float("nan"), 3.0], "mean", 2.0), ([4.0, 1.0, None, 3.0, 2.0], "median", 2.5),
    ([5.0, 1.0], "first", 5.0), ([], "mean", None), ([], "median", None), ([], "first", None)])
def test_reduce(spark, vector, how, want):
    assert value(spark, vector, lambda c: draws.reduce_draws(c, how)) == want


def test_pick_draws(spark):
    pick = lambda idx: value(spark, [1.0, 2.0, 3.0], lambda c: draws.pick_draws(c, idx))
    assert pick([2, 0, 2]) == [3.0, 1.0, 3.0]
    with pytest.raises(ValueError):
        draws.pick_draws(F.col("d"), [-1])
    with pytest.raises(ValueError):
        draws.pick_draws(F.col("d"), [3], width=3)
    with pytest.raises(Exception, match="outside a vector"):
        pick([3])


def test_cycle(spark):
    assert value(spark, [1.0, 2.0], lambda c: draws.cycle_to(c, 5)) == [1.0, 2.0, 1.0, 2.0, 1.0]


def test_bad_draw_counts(spark):
    nan, inf = float("nan"), float("inf")
    for vector, bad, negative in [([1.0, 2.0], 0, 0), ([nan, -1.0, inf], 2, 1), ([None, -2.0, -3.0], 1, 2),
                                  ([-inf, 0.0], 1, 0)]:
        assert value(spark, vector, draws.count_non_finite) == bad
        assert value(spark, vector, draws.count_negative) == negative


def test_months(spark):
    got = spark.createDataFrame([(540,), (1,), (12,), (13,)], "m int").select(
        calendar.month_label(F.col("m")).alias("l"), calendar.year_of(F.col("m")).alias("y")).collect()
    assert [r["l"] for r in got] == ["2024-12", "1980-01", "1980-12", "1981-01"] and got[3]["y"] == 1981
    assert spark.range(1).select(calendar.month_id(F.lit(2024), F.lit(12)).alias("m")).first()["m"] == 540


def test_value_column(spark):
    frame = spark.createDataFrame([(1, 2.0)], "a int, b double")
    assert raster.value_column(frame, exclude=("a",)) == "b"
    with pytest.raises(ValueError):
        raster.value_column(frame)


def test_shared_range_is_never_empty(spark):
    flat = spark.createDataFrame([([3.0],), ([3.0],)], "d array<double>")
    got = raster.shared_range([flat], "d").first()
    assert got["vmax"] > got["vmin"]


def test_raster_keeps_gaps(spark):
    cells = spark.createDataFrame([(1, 10.25, 0.25), (2, 10.75, 0.25), (3, 12.25, 1.25), (4, 11.25, 0.75)],
                                  "priogrid_id long, pg_xcoord double, pg_ycoord double")
    got = {r["priogrid_id"]: (r["row"], r["col"]) for r in raster.raster_index(cells).collect()}
    assert got == {1: (0, 0), 2: (0, 1), 4: (1, 2), 3: (2, 4)}
