"""Unnamed files, map and interval forms, ordered blocks and carried columns."""

import json
import pickle

import pytest
from pyspark.sql import functions as F

from drawfield.operators import grid, rollup, subset
from drawfield.sources import readers

ROWS = [(600, c, c / 2) for c in range(8)]


def read(spark, path):
    got = readers.read_any(spark, str(path)).select("month_id", "priogrid_id", "y").collect()
    return sorted((int(a), int(b), float(c)) for a, b, c in got)


def records():
    return [dict(zip(("month_id", "priogrid_id", "y"), r)) for r in ROWS]


@pytest.mark.parametrize("content", [
    "month_id,priogrid_id,y\n" + "".join(f"{a},{b},{c}\n" for a, b, c in ROWS),
    'month_id,"priogrid_id",y\r\n' + "".join(f'"{a}",{b},{c}\r\n' for a, b, c in ROWS),
    "\n".join(json.dumps(r) for r in records()),
    json.dumps(records()),
    json.dumps(records(), indent=2)])
def test_unnamed_text_is_read_by_its_content(spark, tmp_path, content):
    (tmp_path / "delivery").write_text(content, newline="")
    assert read(spark, tmp_path / "delivery") == ROWS


@pytest.mark.parametrize("name, content", [
    ("csv", "a,b\n" + '1,"x, \u00e9"\n' * 20_000), ("json", '{"a": 1, "b": "\u00e9"}\n' * 20_000),
    ("json", json.dumps([{"a": 1, "b": "\u00e9 x"}] * 20_000)), ("json", json.dumps([{"a": 1.25, "b": None}] * 9_000, indent=1))])
def test_files_longer_than_the_sample(name, content):
    data = content.encode()
    for size in range(readers.SAMPLE_BYTES - 40, readers.SAMPLE_BYTES):
        assert readers.format_of("delivery", data[:size], False) == name


@pytest.mark.parametrize("content, message", [
    (b"\xff\xfe\x00garbage", "not UTF-8"), ("a,b\nf\u00e9,1\n".encode("latin-1"), "not UTF-8"),
    (b"only words here", "fewer than two"), (b"a,b\n1,2\n1,2,3\n", "record 2"), (b"a,a\n1,2\n", "repeated"),
    (b'{"a": 1', "CSV: .*JSON: "), (b"", "fewer than two"), (b"   \n", "fewer than two"), (b"a,b\n1,\x002\n", "fewer than two")])
def test_what_no_format_fits_is_refused(content, message):
    with pytest.raises(ValueError, match=f"format of .*{message}"):
        readers.format_of("delivery", content)


def test_pickles_are_refused_by_their_bytes(spark, tmp_path):
    class Trap:
        def __reduce__(self):
            return (pytest.fail, ("the pickle was loaded",))
    for protocol in range(2, pickle.HIGHEST_PROTOCOL + 1):
        (tmp_path / f"p{protocol}").write_bytes(pickle.dumps(Trap(), protocol))
        with pytest.raises(ValueError, match="pickled"):
            readers.read_any(spark, str(tmp_path / f"p{protocol}"))


def test_parquet_head_is_not_tried_otherwise(spark, tmp_path):
    (tmp_path / "bad").write_bytes(b"PAR1,b\n1,2\n")
    with pytest.raises(Exception) as raised:
        readers.read_any(spark, str(tmp_path / "bad")).count()
    assert "format of" not in str(raised.value)


def test_map_form_drops_unknown_and_interval_form_keeps(spark):
    kind = "struct<map:double,lower:double,upper:double>"
    frame = spark.createDataFrame([(1, 1, (1.0, 0.0, 2.0)), (1, 2, (None, 0.5, None)), (1, 3, (float("nan"), 0.0, 1.0)), (1, 4, None)],
                                  f"month_id int, priogrid_id long, y {kind}")
    assert [tuple(r) for r in grid.map_to_long(frame, ["y"]).collect()] == [(1, 1, "y", 1.0)]
    got = sorted((tuple(r)[1], r["hdi_lower"], r["hdi_upper"]) for r in grid.interval_to_long(frame, ["y"]).collect())
    assert got == [(1, 0.0, 2.0), (2, 0.5, None), (3, 0.0, 1.0), (4, None, None)]


def request(spark, ids):
    return spark.createDataFrame(list(enumerate(ids)), "position int, id long")


def test_block_in_the_order_of_both_requests(spark, posterior):
    got = subset.subset_ordered_block(posterior, request(spark, [601, 600]), request(spark, [103, 100, 103]), strict=True)
    keys = [(r["month_id"], r["priogrid_id"]) for r in got.orderBy("month_position", "cell_position").collect()]
    assert keys == [(m, c) for m in (601, 600) for c in (103, 100, 103)]
    assert subset.subset_ordered_block(posterior, request(spark, [601, 7]), request(spark, [5, 100, None])).count() == 1
    assert subset.subset_ordered_block(posterior, request(spark, []), request(spark, [100]), strict=True).count() == 0


@pytest.mark.parametrize("months, cells, message", [([600, 7], [100], "month_id"), ([600], [100, 5], "priogrid_id")])
def test_strict_block_names_the_unknown(spark, posterior, months, cells, message):
    with pytest.raises(KeyError, match=f"unknown {message}"):
        subset.subset_ordered_block(posterior, request(spark, months), request(spark, cells), strict=True)


def test_only_constants_are_carried(spark):
    rows = spark.createDataFrame([(1, 2, "a", 1.5, None, None), (1, 2, "a", 1.5, "x", None), (1, 3, "a", 1.5, "x", None)],
                                 "month_id int, n int, same string, rate double, gap string, none string")
    units = rows.groupBy("month_id").agg(F.count("*").alias("rate_rows"))
    names = ["same", "n", "gap", "none", "rate", "month_id", "same"]
    got = rollup.carry_constants(units, rows, names)
    assert got.dtypes == [("month_id", "int"), ("rate_rows", "bigint"), ("same", "string"), ("rate", "double")]
    assert [tuple(r) for r in got.collect()] == [(1, 3, "a", 1.5)]
    assert rollup.carry_constants(units, rows.limit(0), names).columns == units.columns
    assert rollup.carry_constants(units, rows, []).columns == units.columns
