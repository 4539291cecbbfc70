"""Subset queries, request parsing, coverage, and the data behind a map."""

from pyspark.sql import functions as F

from drawfield.operators import catalog, raster, subset
from drawfield.plans.core import TARGETS_SQL, query, stacked, text_of, vectors_as_text, with_tables
from drawfield.schema import CELL, GEO_COLUMNS, LEVELS, MONTH
from drawfield.sources import tables
from drawfield.sources.tables import TARGETS

_VECTORS = ", ".join(text_of(t) for t in TARGETS_SQL)
_WANTED_SQL = "SELECT s_suppkey FROM supplier WHERE s_acctbal < 5000"
_PICK = (5, 0, 5, 63)


def _wanted_cells(spark, sf_dir):
    """Requested cell ids: the keys of the suppliers with a lower balance."""
    supplier = tables.table(spark, sf_dir, "supplier")
    return supplier.filter(F.col("s_acctbal") < 5000).select(F.col("s_suppkey").alias("id"))


def _picked(t):
    return text_of("[" + ", ".join(f"{t}[{i + 1}]" for i in _PICK) + "]", t)


@query("subset_time", f"{with_tables('g')} SELECT month_id, priogrid_id, {_VECTORS} FROM g WHERE month_id IN (258, 262)")
def subset_time(spark, sf_dir):
    return vectors_as_text(subset.subset(tables.posterior(spark, sf_dir), TARGETS, months=[258, 262]))


@query("subset_entity", f"""{with_tables('g')}
SELECT month_id, priogrid_id, {_VECTORS} FROM g WHERE priogrid_id IN ({_WANTED_SQL})""")
def subset_entity(spark, sf_dir):
    return vectors_as_text(subset.subset(tables.posterior(spark, sf_dir), TARGETS,
                                         cells=_wanted_cells(spark, sf_dir)))


@query("subset_time_entity", f"""{with_tables('h')} SELECT month_id, priogrid_id, lr_ged_sb, lr_ged_ns, lr_ged_os
FROM h WHERE priogrid_id IN ({_WANTED_SQL}) AND month_id IN (200, 240, 250, 260)""")
def subset_time_entity(spark, sf_dir):
    return subset.subset(tables.observed(spark, sf_dir), tables.OBSERVED, months=[200, 240, 250, 260],
                         cells=_wanted_cells(spark, sf_dir))


@query("subset_features", f"{with_tables('g')} SELECT month_id, priogrid_id, {text_of('pred_lr_ged_ns')} FROM g")
def subset_features(spark, sf_dir):
    return vectors_as_text(subset.subset(tables.posterior(spark, sf_dir), TARGETS, features=TARGETS[1]))


@query("subset_samples", f"""{with_tables('g')}
SELECT month_id, priogrid_id, {', '.join(_picked(t) for t in TARGETS_SQL)} FROM g""")
def subset_samples(spark, sf_dir):
    """Draws 5, 0, 5 and 63: order and repeats are kept."""
    return vectors_as_text(subset.subset(tables.posterior(spark, sf_dir), TARGETS, draws=list(_PICK)))


@query("subset_full", f"""{with_tables('g')} SELECT month_id, priogrid_id, {_picked('pred_lr_ged_os')}, {_picked('pred_lr_ged_sb')}
FROM g WHERE month_id IN (259, 261) AND priogrid_id IN ({_WANTED_SQL})""")
def subset_full(spark, sf_dir):
    return vectors_as_text(subset.subset(
        tables.posterior(spark, sf_dir), TARGETS, months=[259, 261], cells=_wanted_cells(spark, sf_dir),
        features=[TARGETS[2], TARGETS[0]], draws=list(_PICK)))


@query("subset_ordered", f"""{with_tables('g')}, q AS (
  SELECT s_suppkey AS priogrid_id, (SELECT max(s_suppkey) FROM supplier) - s_suppkey AS position
  FROM supplier WHERE s_acctbal < 5000)
SELECT priogrid_id, month_id, {text_of('pred_lr_ged_sb')}, position FROM g JOIN q USING (priogrid_id)""")
def subset_ordered(spark, sf_dir):
    """The place of each cell in the request travels with its rows."""
    supplier = tables.table(spark, sf_dir, "supplier")
    last = supplier.agg(F.max("s_suppkey")).scalar()
    requested = supplier.filter(F.col("s_acctbal") < 5000).select(
        F.col("s_suppkey").alias("id"), (last - F.col("s_suppkey")).alias("position"))
    rows = tables.posterior(spark, sf_dir).select(MONTH, CELL, TARGETS[0])
    return vectors_as_text(subset.subset_ordered(rows, requested))


@query("subset_ordered_block", f"""{with_tables('g')}, q AS (
  SELECT s_suppkey AS priogrid_id, (SELECT max(s_suppkey) FROM supplier) - s_suppkey AS cell_position
  FROM supplier WHERE s_acctbal < 5000),
m AS (SELECT DISTINCT month_id, CAST(-month_id AS BIGINT) AS month_position FROM g WHERE month_id % 2 = 0)
SELECT priogrid_id, month_id, {text_of('pred_lr_ged_sb')}, month_position, cell_position FROM g JOIN q USING (priogrid_id) JOIN m USING (month_id)""")
def subset_ordered_block(spark, sf_dir):
    """Even months, the latest first, of cells asked for in descending order."""
    supplier = tables.table(spark, sf_dir, "supplier")
    last = supplier.agg(F.max("s_suppkey")).scalar()
    cells = supplier.filter(F.col("s_acctbal") < 5000).select(
        F.col("s_suppkey").alias("id"), (last - F.col("s_suppkey")).alias("position"))
    rows = tables.posterior(spark, sf_dir).select(MONTH, CELL, TARGETS[0])
    months = rows.filter(F.col(MONTH) % 2 == 0).select(F.col(MONTH).alias("id")).distinct().withColumn(
        "position", (-F.col("id")).cast("long"))
    return vectors_as_text(subset.subset_ordered_block(rows, months, cells))


@query("unknown_ids", """SELECT DISTINCT o_custkey AS priogrid_id FROM orders
WHERE o_custkey NOT IN (SELECT vec_id // 5 FROM embeddings)""")
def unknown_ids(spark, sf_dir):
    """Customers of all orders as requested cells, without those that are cells of the posterior."""
    requested = tables.table(spark, sf_dir, "orders").select("o_custkey")
    return subset.unknown_ids(tables.posterior(spark, sf_dir), CELL, requested)


@query("cells_of_unit", f"""{with_tables('geo')} SELECT priogrid_id FROM geo WHERE admin1_gaul1_code IN (3, 7, 999)""")
def cells_of_unit(spark, sf_dir):
    return subset.cells_of_unit(tables.geography(spark, sf_dir), "gaul1", [3, 7, 999])


@query("subset_by_country", f"""{with_tables('g', 'geo')} SELECT month_id, priogrid_id, {_VECTORS}
FROM g WHERE priogrid_id IN (SELECT priogrid_id FROM geo WHERE country_iso_a3 IN ('AAA', 'DDD'))""")
def subset_by_country(spark, sf_dir):
    return vectors_as_text(subset.subset_at_level(
        tables.posterior(spark, sf_dir), tables.geography(spark, sf_dir), TARGETS, "country",
        ["AAA", "DDD"], with_geo=False))


@query("subset_with_geo", f"""{with_tables('g', 'geo')} SELECT month_id, priogrid_id, {text_of('pred_lr_ged_sb')},
{', '.join(GEO_COLUMNS)} FROM g LEFT JOIN geo USING (priogrid_id) WHERE month_id = 260""")
def subset_with_geo(spark, sf_dir):
    return vectors_as_text(subset.subset_at_level(
        tables.posterior(spark, sf_dir), tables.geography(spark, sf_dir), TARGETS, months=260,
        features=TARGETS[0]))


for _level, _column in LEVELS.items():
    def _encoded(spark, sf_dir, level=_level):
        return subset.unit_encoding(tables.geography(spark, sf_dir, unmapped=True, sentinel=True), level)

    query(f"unit_encoding_{_level}", f"""{with_tables('geo', 'geo_u')}
SELECT {_column} AS code, CAST(row_number() OVER (ORDER BY {_column}) AS INTEGER) AS unit_id
FROM (SELECT DISTINCT {_column} FROM geo_u WHERE {_column} IS NOT NULL)""")(_encoded)


@query("parse_requests", """
SELECT event_id, request, a AS selects_all, a OR NOT bad AS valid,
       CASE WHEN NOT a AND NOT bad THEN array_to_string(list_transform(parts, lambda p: CAST(CAST(p AS BIGINT) AS VARCHAR)), ',') END AS ids
FROM (SELECT *, trim(request) IN ('', '[]', 'null', 'None') AS a,
        len(list_filter(parts, lambda p: TRY_CAST(p AS BIGINT) IS NULL)) > 0 AS bad
      FROM (SELECT *, list_filter(list_transform(string_split(request, ','), lambda p: trim(p)), lambda p: p <> '') AS parts
            FROM (SELECT event_id, CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN '[]' WHEN 2 THEN 'null' WHEN 3 THEN 'None'
                    WHEN 4 THEN user_id || ', ' || event_id || ',' WHEN 5 THEN user_id || ',x' ELSE '' || user_id END AS request
                  FROM events)))""")
def parse_requests(spark, sf_dir):
    kind, user = F.col("event_id") % 7, F.col("user_id").cast("string")
    text = (F.when(kind == 0, "").when(kind == 1, "[]").when(kind == 2, "null").when(kind == 3, "None")
            .when(kind == 4, F.concat(user, F.lit(", "), F.col("event_id").cast("string"), F.lit(",")))
            .when(kind == 5, F.concat(user, F.lit(",x"))).otherwise(user))
    requests = tables.table(spark, sf_dir, "events").select("event_id", text.alias("request"))
    return vectors_as_text(subset.parse_requests(requests, "request"))


_TEXT_REQUEST = "CASE event_id % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'AAA, CCC,AAA' ELSE 'ZZZ,BBB' END"


@query("answer_requests", f"""{with_tables('h', 'hgeo')},
asked AS (SELECT DISTINCT event_id, unnest(CASE event_id % 3 WHEN 1 THEN ['AAA', 'CCC'] ELSE ['ZZZ', 'BBB'] END) AS country_iso_a3
          FROM events WHERE event_id % 3 > 0),
units AS (SELECT month_id, country_iso_a3, sum(lr_ged_sb) AS lr_ged_sb FROM h JOIN hgeo USING (priogrid_id) GROUP BY 1, 2)
SELECT event_id, count(month_id) AS rows, sum(lr_ged_sb) AS lr_ged_sb, min(month_id) AS first_month, max(month_id) AS last_month
FROM asked LEFT JOIN units USING (country_iso_a3) GROUP BY event_id
UNION ALL SELECT event_id, w.* FROM (SELECT DISTINCT event_id FROM events WHERE event_id % 3 = 0),
  (SELECT count(*), sum(lr_ged_sb), min(month_id), max(month_id) FROM units) w""")
def answer_requests(spark, sf_dir):
    """Text lists of countries and requests of everything, each answered over all months."""
    from drawfield.operators import rollup
    from drawfield.plans.rollups import history_geography
    requests = tables.table(spark, sf_dir, "events").select("event_id", F.expr(_TEXT_REQUEST).alias("request"))
    parsed = subset.parse_requests(requests.withColumn("request", F.nullif("request", F.lit("all"))), "request", "string")
    units = rollup.observed_rollup(tables.observed(spark, sf_dir), history_geography(spark, sf_dir), "country",
                                   ["lr_ged_sb"]).withColumnRenamed("unit", "country_iso_a3")
    return subset.summarize_requests(units, parsed, "country_iso_a3", ["event_id"], "lr_ged_sb")


@query("latest_run_rows", f"""{with_tables('g')}, runs AS (SELECT 'run_' || month_id AS run_id, max(priogrid_id) AS made FROM g
  WHERE month_id <> 262 GROUP BY 1)
SELECT month_id, priogrid_id, {text_of('pred_lr_ged_sb')} FROM g
WHERE 'run_' || month_id = (SELECT run_id FROM runs ORDER BY made DESC, run_id DESC LIMIT 1)""")
def latest_run_rows(spark, sf_dir):
    """The whole table of the newest run: months stand in for runs, and 262 is quarantined."""
    rows = tables.posterior(spark, sf_dir).withColumn(
        "file_id", F.concat(F.lit("run_"), F.col(MONTH).cast("string")))
    runs = rows.groupBy("file_id").agg(F.max(CELL).alias("created_at"))
    withdrawn = rows.filter(F.col(MONTH) == 262).select("file_id")
    live = catalog.newest(catalog.without(runs, withdrawn), [])
    return vectors_as_text(rows.join(live.select("file_id"), "file_id", "left_semi").select(MONTH, CELL, TARGETS[0]))


@query("coverage", f"""{with_tables('h', 'hgeo')}
SELECT month_id, country_iso_a3, count(*) AS rows, count(DISTINCT priogrid_id) AS cells
FROM h LEFT JOIN hgeo USING (priogrid_id) GROUP BY 1, 2""")
def coverage(spark, sf_dir):
    from drawfield.plans.rollups import history_geography
    return subset.coverage(tables.observed(spark, sf_dir), history_geography(spark, sf_dir))


@query("country_present", f"""{with_tables('h', 'hgeo')}
SELECT month_id, count(*) AS rows, coalesce(bool_or(country_iso_a3 = 'CCC'), false) AS present
FROM h LEFT JOIN hgeo USING (priogrid_id) GROUP BY 1""")
def country_present(spark, sf_dir):
    from drawfield.plans.rollups import history_geography
    return subset.country_present(tables.observed(spark, sf_dir), history_geography(spark, sf_dir), "CCC")


# --- the data behind a map ------------------------------------------------------------------

@query("log1p_mean", f"""{with_tables('g')}, s AS ({stacked('g', 'month_id, priogrid_id')})
SELECT target, month_id, priogrid_id, round(ln(1 + list_sum(draws) / len(draws)), 6) AS value FROM s""")
def log1p_mean(spark, sf_dir):
    from drawfield.operators.grid import target_frames
    frames = raster.prepared(target_frames(tables.posterior(spark, sf_dir), TARGETS), "draws")
    return frames.select("target", MONTH, CELL, F.round("value", 6).alias("value"))


@query("shared_range", f"""{with_tables('g')}, s AS ({stacked('g', 'month_id, priogrid_id')})
SELECT round(min(ln(1 + list_median(draws))), 6) AS vmin, round(max(ln(1 + list_median(draws))), 6) AS vmax FROM s""")
def shared_range(spark, sf_dir):
    rows = tables.posterior(spark, sf_dir)
    frames = [rows.select(F.col(t).alias("draws")) for t in TARGETS]
    return raster.shared_range(frames, "draws", how="median").select(
        F.round("vmin", 6).alias("vmin"), F.round("vmax", 6).alias("vmax"))


@query("raster_index", """
SELECT c AS priogrid_id, CAST((c // 720) AS INTEGER) AS row, CAST(c % 720 AS INTEGER) AS col
FROM (SELECT DISTINCT vec_id // 5 AS c FROM embeddings)""")
def raster_index(spark, sf_dir):
    return raster.raster_index(tables.geography(spark, sf_dir))
