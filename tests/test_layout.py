"""Order in blocks, fingerprints, mergeable sketches and pages by cursor."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from drawfield.operators import catalog, grid, validate
from drawfield.session import shared_dir
from drawfield.sources import writers

LINES = "file string, at long, month_id int, priogrid_id long"
VECTORS = "month_id int, priogrid_id long, pred_x array<float>"


def broken(rows):
    """By hand: for each file its rows, and the rows that do not follow the one before."""
    found = {}
    for file in {r[0] for r in rows}:
        placed = sorted((r[1], r[2:]) for r in rows if r[0] == file and r[1] is not None)
        found[file] = (sum(r[0] == file for r in rows), sum(a[1] >= b[1] for a, b in zip(placed, placed[1:])))
    return found


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_blocks_give_what_one_window_gives(spark, size):
    rng = random.Random(size)
    rows = [(f, at, rng.randint(1, 4), rng.randint(1, 3)) for f, n in (("a", 300), ("b", 1), ("c", 40)) for at in range(n)]
    rows += [("a", None, 1, 1)] * 5 + [("d", None, 2, 2)]
    got = validate.order_violations(spark.createDataFrame(rows, LINES), "at", "file", F.floor(F.col("at") / size))
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == broken(rows)


def test_a_break_at_the_edge_of_a_block_is_seen(spark):
    step = validate.ORDER_BLOCK
    rows = [("a", step - 1, 5, 1), ("a", step, 5, 1), ("a", 5 * step, 4, 9), ("a", 5 * step + 1, 4, 10)]
    got = validate.order_violations(spark.createDataFrame(rows, LINES), "at", "file").collect()
    assert [(r["rows"], r["violations"]) for r in got] == [(4, 2)]
    assert validate.order_violations(spark.createDataFrame([], LINES), "at", "file").count() == 0


def test_one_file_is_checked_by_many_tasks(spark):
    rows = spark.createDataFrame([("a", 1, 1, 1)], LINES)
    plan = validate.order_violations(rows, "at", "file")._jdf.queryExecution().executedPlan().toString()
    first = [line for line in reversed(plan.splitlines()) if "Exchange hashpartitioning" in line][0]
    assert "block" in first


@pytest.mark.parametrize("seed", range(4))
def test_rows_of_one_position_break_alike_inside_and_at_the_edges(spark, seed):
    rows = [("a", 1, 1, 1), ("a", 2, 5, 1), ("a", 4, 3, 1), ("a", 4, 8, 1), ("a", 7, 6, 1), ("b", 2, 5, 1), ("b", 3, 3, 1), ("b", 3, 8, 1)]
    random.Random(seed).shuffle(rows)
    got = validate.order_violations(spark.createDataFrame(rows, LINES).coalesce(1), "at", "file", F.floor(F.col("at") / 3))
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == broken(rows) == {"a": (5, 2), "b": (3, 1)}


def test_larger_files_take_more_tasks_and_one_sort_each(spark, monkeypatch):
    monkeypatch.setattr(validate, "ORDER_TASK", 10)
    rows = [("ab"[at % 2], at if at % 9 else None, at % 4, at % 3) for at in range(300)]
    got = validate.order_violations(spark.createDataFrame(rows, LINES), "at", "file", F.floor(F.col("at") / 5))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 30), REPARTITION_BY_NUM") == 2 and plan.count("Sort [") == 2
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == broken(rows)


def test_lines_with_missing_values_match_the_sql(spark, tmp_path):
    import oracle
    from drawfield import plans
    rng, day = random.Random(5), datetime(2024, 1, 1)
    seen = set()
    while len(seen) < 300:
        seen.add((rng.choice([1, 2, None]), rng.choice([1, 2, 3, None]), rng.choice([1, 2, 3, 4, 6, 7, None]), rng.choice([1, 2, 3, None])))
    rows = [(*line[:2], line[3], line[2], rng.choice([None, day, datetime(2024, 2, 1), datetime(2024, 3, 1)])) for line in sorted(seen, key=repr)]
    path = str(tmp_path / "lineitem.parquet")
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate timestamp_ntz").write.parquet(path)
    duck = oracle.duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}/*.parquet'")
    name = "order_violations"
    message = oracle.compare(plans.queries()[name](spark, str(tmp_path)), duck, plans.oracle_sql()[name])
    assert message is None, message


def test_roundtrip_shuffles_no_vector_for_the_comparison(spark):
    rows = [(m, c, [float(m), float(c), 0.5]) for m in (1, 2) for c in range(5)] + [(3, 1, None), (3, 2, [])]
    frame = spark.createDataFrame(rows, VECTORS)
    got = grid.integrity_roundtrip(frame, ["pred_x"])
    assert [tuple(r) for r in got.collect()] == [("pred_x", 12, 1)]  # the empty vector alone
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_fingerprints_tell_tables_apart(spark):
    def mark(rows):
        return [tuple(r) for r in grid.fingerprint(spark.createDataFrame(rows, VECTORS), ["month_id", "priogrid_id", "pred_x"]).collect()]
    rows = [(1, 1, [1.0, 2.0]), (1, 2, [3.0, None]), (2, 1, None), (2, 2, []), (2, 2, [])]
    base = mark(rows)
    assert mark(rows[::-1]) == base
    for at, other in ((0, [2.0, 1.0]), (1, [None, 3.0]), (2, []), (3, None), (0, [1.0, 2.0, None]), (0, [1.0])):
        changed = list(rows)
        changed[at] = (*rows[at][:2], other)
        assert mark(changed) != base
    assert mark(rows[:-1]) != base
    assert mark([(1, 1, [0.0])]) == mark([(1, 1, [-0.0])])


def test_a_damaged_data_set_is_not_loaded(spark, posterior, geo):
    path = writers.save_dataset(posterior, geo, shared_dir(spark, "marked"))
    writers.load_dataset(spark, path)
    changed = posterior.withColumn("pred_lr_ged_sb", F.when(
        (F.col("month_id") == 601) & (F.col("priogrid_id") == 102), F.slice("pred_lr_ged_sb", 1, 4)).otherwise(F.col("pred_lr_ged_sb")))
    for rows, places, message in (
            (changed, geo, "month 601"), (posterior.filter("month_id = 600"), geo, "month 601"),
            (posterior, geo.filter("priogrid_id < 103"), "geography"),
            (posterior.unionByName(posterior.filter("month_id = 600").withColumn("month_id", F.lit(602))), geo, "month 602")):
        other = writers.save_dataset(rows, places, shared_dir(spark, "damaged"))
        broken_path = shared_dir(spark, "mixed")
        for part, source in (("grid", other), ("geo", other), ("fingerprint", path)):
            spark.read.parquet(f"{source}/{part}").write.partitionBy(*["month_id"] if part == "grid" else []).parquet(f"{broken_path}/{part}")
        with pytest.raises(ValueError, match=message):
            writers.load_dataset(spark, broken_path)
        assert writers.load_dataset(spark, broken_path, check=False)[0].count()


def test_an_empty_data_set_comes_back(spark, posterior, geo):
    path = writers.save_dataset(posterior.limit(0), geo.limit(0), shared_dir(spark, "none"))
    assert spark.read.parquet(f"{path}/fingerprint").filter("part = 'geo'").count() == 1


def test_sketches_merge_over_runs(spark):
    # run 0 holds a third of the rows, and cells overlap between runs
    rows = spark.range(60_000).select(
        F.when(F.col("id") < 20_000, 0).otherwise(F.col("id") % 50).alias("run_id"), (F.col("id") % 17_001).alias("priogrid_id"))
    stored = grid.cell_sketches(rows, ("run_id",))
    got = grid.merge_sketches(stored).first()
    assert got["rows"] == 60_000 and abs(got["cells"] - 17_001) <= grid.SKETCH_BOUND * 17_001
    again = grid.merge_sketches(stored.filter("run_id < 25").unionByName(stored)).first()
    assert again["cells"] == got["cells"]
    nothing = grid.merge_sketches(stored.limit(0)).first()
    assert nothing["rows"] == 0 and not nothing["cells"]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_pages_by_cursor_are_the_whole_listing(spark, kind):
    stamps = [datetime(2024, 1, 1, 0, 0, s // 4, 7 * (s % 2)) for s in range(30)] + [None] * 5
    rows = [(s, f"f{i:02d}", f"name_{i % 2}") for i, s in enumerate(stamps)]
    frame = spark.createDataFrame(rows, "created_at timestamp, file_id string, filename string").withColumn(
        "created_at", F.col("created_at").cast(kind))
    whole = [r["file_id"] for r in catalog.page(frame, limit=100).collect()]
    for size in (4, 7, 35):
        seen, cursor = [], None
        while True:
            page = catalog.page_after(frame, cursor, limit=size)
            got = [r["file_id"] for r in page.collect()]
            if not got:
                break
            seen, cursor = seen + got, catalog.cursor_of(page)
        assert seen == whole
    odd = catalog.page_after(frame, limit=100, text="_1").collect()
    assert len(odd) == 17 and catalog.cursor_of(frame.limit(0)) is None
    plan = catalog.page_after(frame, (0, "f"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
