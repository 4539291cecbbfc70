"""Requests of ids, of everything and of nothing known, answered over all months."""

from drawfield.operators import subset


def test_every_valid_request_has_one_row(spark):
    frame = spark.createDataFrame([(m, c, float(10 * m + c)) for m in (1, 2, 3) for c in (7, 8)], "month_id int, priogrid_id long, y double")
    asked = spark.createDataFrame([(1, "7, 8,7"), (2, "8"), (3, ""), (4, "99"), (5, "x,7"), (6, "null"), (7, "7,99")], "id int, request string")
    parsed = subset.parse_requests(asked, "request")
    got = {r.id: (r.rows, r.y, r.first_month, r.last_month)
           for r in subset.summarize_requests(frame, parsed, "priogrid_id", ["id"], "y").collect()}
    whole = (6, 165.0, 1, 3)
    assert got == {1: whole, 2: (3, 84.0, 1, 3), 3: whole, 4: (0, None, None, None), 6: whole, 7: (3, 81.0, 1, 3)}


def test_requests_over_an_empty_frame(spark):
    frame = spark.createDataFrame([], "month_id int, priogrid_id long, y double")
    asked = subset.parse_requests(spark.createDataFrame([(1, "7"), (2, "")], "id int, request string"), "request")
    got = sorted((r.id, r.rows, r.y) for r in subset.summarize_requests(frame, asked, "priogrid_id", ["id"], "y").collect())
    assert got == [(1, 0, None), (2, 0, None)]
