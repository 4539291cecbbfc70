"""One fault per run, and the gate that has to see it."""

import pytest
from pyspark.sql import functions as F

from drawfield.operators import assemble, gates
from drawfield.plans.gating import _FUNCTIONS
from drawfield.schema import MANIFEST_SUFFIX
from drawfield.sources import tables

FAILS = {
    "run_ok": set(), "run_dup": {"sample_order"}, "run_gap": {"sample_count", "uniform_s"},
    "run_header": {"header"}, "run_short": {"cell_count", "rectangular"},
    "run_width": {"sample_count", "uniform_s"}, "run_geo": {"coverage"},
    "run_month": {"missing_artifacts"}, "run_version": {"contract_version"}, "run_anon": {"identifiable"},
    "run_twice": {"duplicates"}, "run_declared": {"self_consistent"},
    "run_extra": {"unlisted"}, "run_again": {"repeated_entries"}, "run_tamper": {"content_hash"},
    "run_negative": {"plausible_draws"}, "run_bare": {"missing_artifacts"},
}


@pytest.fixture(scope="module")
def runs(spark, sf_dir):
    return tables.wire_runs(spark, sf_dir)


@pytest.fixture(scope="module")
def rows(runs):
    return gates.gate_rows(runs).collect()


def test_every_fault_is_seen_by_its_gate_only(rows):
    failed = {}
    for r in rows:
        failed.setdefault(r["run_id"], set()).update([] if r["passed"] else [r["gate"]])
    assert failed == FAILS


def test_single_gates_agree_with_the_shared_pass(runs, rows):
    together = {(r["run_id"], r["gate"]): r["passed"] for r in rows}
    for name, gate in _FUNCTIONS.items():
        for r in gate(runs).collect():
            assert together[(r["run_id"], name)] == (r["problems"] == 0), (r["run_id"], name)


def test_verdicts(runs, spark):
    got = {r["run_id"]: r for r in gates.verdict(gates.evaluated(gates.gate_rows(runs))).collect()}
    assert got["run_ok"]["verdict"] == "SERVABLE" and got["run_ok"]["checked"] == len(gates.GATES)
    assert all(r["verdict"] == "NOT SERVABLE" for k, r in got.items() if k != "run_ok")
    # a terminal failure stops what follows it
    assert got["run_version"]["checked"] == 1
    few = spark.createDataFrame([("r", "header", 6, True, False)],
                                "run_id string, gate string, step int, passed boolean, terminal boolean")
    assert gates.verdict(few).first()["verdict"] == "INCOMPLETE"


@pytest.mark.parametrize("version, ok", [("1.5", True), ("1.4", True), ("1", True), ("", True), ("  ", True),
                                         (None, True), ("1.6", False), ("2.0", False), ("x", False), ("1.x", False)])
def test_contract_versions(spark, version, ok):
    frame = spark.createDataFrame([(version,)], "v string")
    assert frame.select(gates.can_render(F.col("v")).alias("r")).first()["r"] is ok


@pytest.mark.parametrize("name, out", [("a/b", False), ("../a", True), ("/etc/x", True), ("a/../b", True),
                                       ("", True), ("a..b", False)])
def test_names_stay_inside(spark, name, out):
    assert spark.createDataFrame([(name,)], "n string").select(gates.escapes(F.col("n")).alias("e")).first()["e"] is out


def test_find_manifest(spark):
    documents = spark.createDataFrame([
        ("a", "x.json", ["s"], None), ("a", "t.json", ["s"], "sb"), ("a", "other.json", None, None),
        ("b", "one.json", ["s"], None), ("b", "two" + MANIFEST_SUFFIX, ["s"], None),
        ("c", "one.json", ["s"], None), ("c", "two.json", ["s"], None)],
        "directory string, filename string, shards array<string>, target string")
    got = {r["directory"]: r["filename"] for r in gates.find_manifest(documents, MANIFEST_SUFFIX).collect()}
    assert got == {"a": "x.json", "b": "two" + MANIFEST_SUFFIX, "c": None}


LONG = "target string, month_id int, priogrid_id long, sample int, value float, sample_count int"


@pytest.mark.parametrize("width", [4, 130, 260])
def test_vectors_of_any_width(spark, width):
    rows = [("t", 1, c, s, float(1000 * c + s), width) for c in (1, 2) for s in reversed(range(width)) if (c, s) != (2, 1)]
    long = spark.createDataFrame(rows + rows[:3], LONG)
    got = {r["priogrid_id"]: r["draws"] for r in assemble.to_vectors(long, strict=False).collect()}
    assert got[1] == [1000.0 + s for s in range(width)]
    assert got[2] == [None if s == 1 else 2000.0 + s for s in range(width)]
    one = spark.createDataFrame([r for r in rows if r[2] == 1], LONG)
    assert assemble.to_vectors(one).first()["draws"] == got[1]


@pytest.mark.parametrize("samples, declared, message", [
    ((0, 1, 2), (2, 2, 2), "declared"), ((0, 1), (4, 4), "missing or repeated"), ((0, 1, 1), (3, 3, 3), "missing or repeated"),
    ((0, 1, -1), (3, 3, 3), "declared"), ((0, 1), (2, 3), "different numbers"), ((0, 1), (None, None), "declared")])
def test_a_wrong_width_neither_cuts_nor_pads(spark, samples, declared, message):
    long = spark.createDataFrame([("t", 1, 1, s, 0.5, d) for s, d in zip(samples, declared)], LONG)
    with pytest.raises(Exception, match=message):
        assemble.to_vectors(long).collect()


def test_order_of_any_number_of_draws(spark):
    """Draw numbers are marked without a declared width."""
    rows = [("r", "s", "t", 1, c, s) for c, n in ((1, 300), (2, 300), (3, 1)) for s in range(n) if (c, s) != (2, 150)]
    rows += [("r", "s", "t", 1, 2, 151), ("r", "s", "t", 1, 4, -1), ("r", "s", "t", 1, 4, 0)]
    draws = spark.createDataFrame(rows, "run_id string, shard string, target string, month_id int, priogrid_id long, sample int")
    got = {r["priogrid_id"]: (r["rows"], r["ordered"]) for r in gates.cell_profile(gates.Run(draws, None, None, None)).collect()}
    assert got == {1: (300, True), 2: (300, False), 3: (1, True), 4: (2, False)}


def test_many_copies_of_a_draw_are_one_mark(spark):
    """A third of all rows being copies of one draw costs a counter, not a list."""
    copies = spark.range(20000).select(F.lit("r").alias("run_id"), F.lit("s").alias("shard"), F.lit("t").alias("target"),
                                       F.lit(1).alias("month_id"), F.lit(1).cast("long").alias("priogrid_id"),
                                       F.lit(0).alias("sample"), F.lit(1.0).alias("value"))
    assert gates.shard_profile(gates.Run(copies, None, None, None)).first()["disordered"] == 1


def test_draws_are_unfolded_once_and_last(spark, sf_dir):
    """Shard names are built once a vector, not once a draw, and the shards no manifest lists come from the same scan."""
    plan = tables.wire_runs(spark, sf_dir).draws._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("posexplode") == 1
    above = plan[:plan.index("posexplode")]
    assert "concat" not in above and "lpad" not in above
