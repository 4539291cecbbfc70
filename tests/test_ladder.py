"""The ladder: its definition by brute force, its properties, and both of its forms."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from drawfield.functions import ladder
from drawfield.functions.ladder import LADDER, collapse, collapse_matrix, ladder_by_expression, rung_of


def brute(draws):
    window, bounds = sorted(draws), {}
    for m in LADDER:
        k = max(1, math.ceil(m * len(draws) - 1e-9))
        start = min(range(len(window) - k + 1), key=lambda i: (window[i + k - 1] - window[i], i))
        window = window[start:start + k]
        bounds[m] = window[0], window[-1]
    n = len(window)
    return bounds, (window[(n - 1) // 2] + window[n // 2]) / 2


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=90))
def test_kernel_is_the_definition(draws):
    got = collapse_matrix(np.array([draws, draws[::-1]], dtype=float))
    bounds, point = brute(draws)
    assert got["map"].tolist() == [point, point]
    for m in (0.5, 0.9, 0.95):
        pct = round(m * 100)
        assert (got[f"hdi{pct}_lower"][0], got[f"hdi{pct}_upper"][1]) == bounds[m]


@pytest.mark.parametrize("width", [1, 2, 3, 5, 64, 65, 100, 257])
def test_nested_and_ordered(width):
    rng = np.random.default_rng(width)
    got = collapse_matrix(np.floor(rng.gamma(0.4, 60, (300, width))))
    order = ["hdi95_lower", "hdi90_lower", "hdi50_lower", "map", "hdi50_upper", "hdi90_upper", "hdi95_upper"]
    for a, b in zip(order, order[1:]):
        assert (got[a] <= got[b]).all()
    assert (got["p_gt25"] >= got["p_gt100"]).all()


def test_many_zeros_give_zero():
    rng = np.random.default_rng(7)
    draws = np.where(rng.random((50, 1000)) < 0.95, 0, rng.gamma(2, 30, (50, 1000)))
    got = collapse_matrix(draws)
    assert (got["map"] == 0).all() and (got["hdi90_lower"] == 0).all()


def test_interval_does_not_depend_on_the_others_asked_for():
    draws = np.random.default_rng(3).gamma(2, 30, (40, 64))
    alone, among = collapse_matrix(draws, masses=(0.9,)), collapse_matrix(draws)
    assert (alone["hdi90_lower"] == among["hdi90_lower"]).all()


def test_rungs():
    assert rung_of(0.72) == 0.70 and rung_of(0.75) == 0.80 and rung_of(0.99) == 0.95
    for bad in (0, 1.5, -1):
        with pytest.raises(ValueError):
            rung_of(bad)


def test_two_clusters():
    rng = np.random.default_rng(1)
    one, two = rng.normal(5, 1, 400), np.concatenate([rng.normal(0, 1, 200), rng.normal(20, 1, 200)])
    assert collapse_matrix(np.stack([one, two]))["bimodality_flag"].tolist() == [0, 1]


def test_clip_touches_the_point_only():
    got = collapse_matrix(np.full((1, 30), -5.0), non_negative=True)
    assert got["map"][0] == 0 and got["hdi50_lower"][0] == -5


def test_long_batches_are_split():
    draws = np.random.default_rng(5).gamma(1, 9, (ladder.CHUNK + 3, 8))
    whole = collapse_matrix(draws)
    assert len(whole["map"]) == len(draws)
    assert whole["map"][-1] == collapse_matrix(draws[-1:])["map"][0]


def test_missing_and_ragged_rows_in_spark(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0, 3.0]), (1, [nan, nan]), (2, None), (3, []), (4, [nan, 50.0, inf, 200.0]),
            (5, [7.0]), (6, [None, 4.0]), (7, [inf, inf])]
    frame = spark.createDataFrame(rows, "i int, d array<double>").coalesce(1)
    got = {r["i"]: r["s"] for r in frame.select("i", collapse(F.col("d")).alias("s")).collect()}
    assert got[0]["map"] == 2.0 or got[0]["map"] in (1.0, 3.0)
    for i in (1, 2, 3):
        assert all(v is None for v in got[i])
    assert got[4]["p_gt25"] == 0.5 and got[4]["severe_scenario"] == 200.0
    assert got[5]["map"] == got[5]["hdi95_upper"] == 7.0 and got[6]["hdi95_lower"] == 0.0
    assert got[7]["map"] == 0.0


def test_collapse_checks_its_parameters():
    with pytest.raises(ValueError):
        collapse(F.col("d"), masses=())
    with pytest.raises(ValueError):
        collapse(F.col("d"), tail=0)


@pytest.mark.parametrize("width", [1, 2, 7, 64, 65])
def test_expression_form_agrees(spark, width):
    rng = np.random.default_rng(width)
    rows = [(i, np.floor(rng.gamma(0.5, 40, width)).tolist()) for i in range(60)]
    frame = spark.createDataFrame(rows, "i int, d array<double>")
    both = frame.select(ladder_by_expression(F.col("d")).alias("e"), collapse(F.col("d")).alias("k"))
    for e, k in both.collect():
        assert e.asDict() == {n: k[n] for n in e.asDict()}


def test_kernel_needs_no_installed_package(tmp_path):
    """An executor without this package can still run the pickled kernel."""
    import subprocess
    import sys

    from pyspark import cloudpickle
    code = ("import sys, pickle, numpy as np\n"
            "f = pickle.loads(sys.stdin.buffer.read())\n"
            "print(f(np.array([[1.0, 2.0, 2.0, 9.0]]))['map'][0])")
    done = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(collapse_matrix),
                          cwd=tmp_path, capture_output=True, timeout=60, env={"PATH": "/usr/bin:/bin"})
    assert done.returncode == 0, done.stderr.decode()
    assert float(done.stdout) == 2.0
