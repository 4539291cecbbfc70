"""Grid, normalisation and validation queries."""

from pyspark.sql import functions as F

from drawfield.functions import calendar
from drawfield.operators import grid, normalize, validate
from drawfield.plans.core import query, stacked, text_of, vectors_as_text, with_tables
from drawfield.schema import CELL, GEO_COLUMNS, LEGACY_CELL, MONTH
from drawfield.sources import tables
from drawfield.sources.tables import OBSERVED, TARGETS


_PRODUCT = """p AS (SELECT month_id, priogrid_id FROM (SELECT DISTINCT month_id FROM {0}),
                (SELECT DISTINCT priogrid_id FROM {0}))"""


@query("dense_fill", f"""{with_tables('h')}, {_PRODUCT.format('h')}
SELECT month_id, priogrid_id, {', '.join(f'coalesce({t}, 0.0) AS {t}' for t in OBSERVED)}
FROM p LEFT JOIN h USING (month_id, priogrid_id)""")
def dense_fill(spark, sf_dir):
    """All of the history: the cells of any month, as the last months are not complete."""
    return grid.dense_fill(tables.observed(spark, sf_dir), entities="all")


@query("dense_fill_vectors", f"""{with_tables('h')}, {_PRODUCT.format('h')}
SELECT month_id, priogrid_id, CASE WHEN lr_ged_sb IS NULL THEN '-1,-1,-1' ELSE
  CAST(lr_ged_sb AS BIGINT) || ',' || CAST(lr_ged_ns AS BIGINT) || ',' || CAST(lr_ged_os AS BIGINT) END AS draws
FROM p LEFT JOIN h USING (month_id, priogrid_id)""")
def dense_fill_vectors(spark, sf_dir):
    vectors = tables.observed(spark, sf_dir).select(MONTH, CELL, F.array(*OBSERVED).alias("draws"))
    return vectors_as_text(grid.dense_fill(vectors, -1.0, entities="all"))


@query("entities_absent_last_step", f"""{with_tables('h')}
SELECT priogrid_id, max(month_id) AS last_seen FROM h GROUP BY 1
HAVING max(month_id) < (SELECT max(month_id) FROM h)""")
def entities_absent_last_step(spark, sf_dir):
    return grid.entities_absent_last_step(tables.observed(spark, sf_dir))


@query("tensor_long", f"""{with_tables('h')}, {_PRODUCT.format('h')},
t AS ({stacked('(SELECT p.*, [lr_ged_sb, lr_ged_ns] AS pred_a, [lr_ged_os] AS pred_b FROM p JOIN h USING (month_id, priogrid_id))',
               'month_id, priogrid_id', ('pred_a', 'pred_b'))})
SELECT target, month_id, priogrid_id, CAST(i AS INTEGER) AS sample, draws[i + 1] AS value
FROM p CROSS JOIN (SELECT 'pred_a' AS target, unnest([0, 1]) AS i UNION ALL SELECT 'pred_b', 0) x
LEFT JOIN t USING (month_id, priogrid_id, target)""")
def tensor_long(spark, sf_dir):
    vectors = tables.observed(spark, sf_dir).select(
        MONTH, CELL, F.array("lr_ged_sb", "lr_ged_ns").alias("pred_a"), F.array("lr_ged_os").alias("pred_b"))
    return grid.tensor_long(vectors, ["pred_a", "pred_b"])


@query("month_block", f"""{with_tables('h')}, last AS (SELECT max(month_id) AS m FROM h)
SELECT a.priogrid_id, CASE WHEN h.lr_ged_sb IS NULL THEN NULL ELSE
  CAST(lr_ged_os AS BIGINT) || ',' || CAST(lr_ged_sb AS BIGINT) END AS draws
FROM (SELECT DISTINCT priogrid_id FROM h) a
LEFT JOIN (SELECT * FROM h WHERE month_id = (SELECT m FROM last)) h USING (priogrid_id)""")
def month_block(spark, sf_dir):
    vectors = tables.observed(spark, sf_dir).select(MONTH, CELL, F.array(*OBSERVED).alias("draws"))
    last = vectors.select(MONTH).agg(F.max(MONTH)).scalar()
    return vectors_as_text(grid.month_block(vectors, last, "draws", positions=[2, 0]))


@query("target_frames", f"""{with_tables('g')}, s AS ({stacked('g', 'month_id, priogrid_id')})
SELECT target, {text_of('draws')}, month_id, priogrid_id FROM s""")
def target_frames(spark, sf_dir):
    return vectors_as_text(grid.target_frames(tables.posterior(spark, sf_dir), TARGETS))


@query("grid_profile", f"""{with_tables('g')}
SELECT count(DISTINCT priogrid_id) AS cells, count(DISTINCT month_id) AS months, count(*) AS rows,
       CAST(3 AS BIGINT) AS targets, max(len(pred_lr_ged_sb)) AS draws FROM g""")
def grid_profile(spark, sf_dir):
    return grid.grid_profile(tables.posterior(spark, sf_dir), TARGETS)


@query("grid_profile_approximate", f"""{with_tables('g')}
SELECT count(DISTINCT month_id) AS months, count(*) AS rows, count(DISTINCT priogrid_id) AS cells, true AS within_bound FROM g""")
def grid_profile_approximate(spark, sf_dir):
    """A sketch for each month, merged; beside the exact count, whether the estimate is within its bound."""
    frame = tables.posterior(spark, sf_dir)
    merged = grid.merge_sketches(grid.cell_sketches(frame, (MONTH,)))
    cells, months = (frame.agg(F.countDistinct(c)).scalar() for c in (CELL, MONTH))
    close = F.abs(F.col("cells") - cells) <= F.ceil(grid.SKETCH_BOUND * cells)
    return merged.select(months.alias("months"), "rows", cells.alias("cells"), close.alias("within_bound"))


@query("geo_backfill", f"""{with_tables('h', 'hgeo')},
r AS (SELECT month_id, priogrid_id, lr_ged_sb,
        CASE WHEN (month_id + priogrid_id) % 3 = 0 THEN country_iso_a3 || month_id END AS iso,
        CASE WHEN (month_id + priogrid_id) % 4 <> 0 THEN n + month_id END AS code
      FROM h JOIN hgeo USING (priogrid_id)),
f AS (SELECT priogrid_id, arg_min(iso, month_id) FILTER (iso IS NOT NULL) AS fi,
             arg_min(code, month_id) FILTER (code IS NOT NULL) AS fc,
             bool_or(iso IS NULL OR code IS NULL) AS inc FROM r GROUP BY 1)
SELECT month_id, priogrid_id, lr_ged_sb, CASE WHEN inc THEN fi ELSE iso END AS iso,
       CASE WHEN inc THEN fc ELSE code END AS code FROM r JOIN f USING (priogrid_id)""")
def geo_backfill(spark, sf_dir):
    from drawfield.plans.rollups import history_geography
    geo = history_geography(spark, sf_dir).select(CELL, "country_iso_a3", F.col("admin1_gaul1_code").alias("n"))
    month, cell = F.col(MONTH), F.col(CELL)
    rows = tables.observed(spark, sf_dir).join(geo, CELL).select(
        MONTH, CELL, "lr_ged_sb",
        F.when((month + cell) % 3 == 0, F.concat("country_iso_a3", month.cast("string"))).alias("iso"),
        F.when((month + cell) % 4 != 0, (F.col("n") + month).cast("int")).alias("code"))
    return grid.geo_backfill(rows, ["iso", "code"])


@query("matrix_to_long", f"""{with_tables('g')}, s AS ({stacked('g', 'month_id, priogrid_id')})
SELECT month_id, priogrid_id, target, list_sum(draws) / len(draws) AS map,
       list_min(draws) AS hdi_lower, list_max(draws) AS hdi_upper FROM s""")
def matrix_to_long(spark, sf_dir):
    def matrix(t):
        d = F.col(t).cast("array<double>")
        return F.struct((F.aggregate(d, F.lit(0.0), lambda a, x: a + x) / F.size(d)).alias("map"),
                        F.array_min(d).alias("lower"), F.array_max(d).alias("upper")).alias(t)

    wide = tables.posterior(spark, sf_dir).select(MONTH, CELL, *[matrix(t) for t in TARGETS])
    return grid.matrix_to_long(wide, TARGETS)


_PART_KNOWN = """SELECT month_id, priogrid_id, target, {} FROM s"""


def _partly_known(spark, sf_dir):
    """Matrices whose point estimate is unknown for every fourth cell."""
    def matrix(t):
        d = F.col(t).cast("array<double>")
        return F.struct(F.when(F.col(CELL) % 4 != 0, F.array_max(d)).alias("map"), F.array_min(d).alias("lower"),
                        F.when(F.col(CELL) % 3 != 0, F.array_max(d)).alias("upper")).alias(t)
    return tables.posterior(spark, sf_dir).select(MONTH, CELL, *[matrix(t) for t in TARGETS])


@query("matrix_map_long", f"""{with_tables('g')}, s AS ({stacked('g', 'month_id, priogrid_id')})
{_PART_KNOWN.format('CAST(list_max(draws) AS DOUBLE) AS map')} WHERE priogrid_id % 4 <> 0""")
def matrix_map_long(spark, sf_dir):
    return grid.map_to_long(_partly_known(spark, sf_dir), TARGETS)


@query("matrix_interval_long", f"""{with_tables('g')}, s AS ({stacked('g', 'month_id, priogrid_id')})
{_PART_KNOWN.format('CAST(list_min(draws) AS DOUBLE) AS hdi_lower, CASE WHEN priogrid_id % 3 <> 0 THEN CAST(list_max(draws) AS DOUBLE) END AS hdi_upper')}""")
def matrix_interval_long(spark, sf_dir):
    return grid.interval_to_long(_partly_known(spark, sf_dir), TARGETS)


@query("month_functions", """
SELECT o_orderkey, m AS month_id, CAST(1980 + (m - 1) // 12 AS INTEGER) AS year,
       CAST((m - 1) % 12 + 1 AS INTEGER) AS month, strftime(o_orderdate, '%Y-%m') AS label
FROM (SELECT *, CAST((year(o_orderdate) - 1980) * 12 + month(o_orderdate) AS INTEGER) AS m FROM orders)""")
def month_functions(spark, sf_dir):
    month = F.col(MONTH)
    return tables.table(spark, sf_dir, "orders").select(
        "o_orderkey", calendar.month_id_of_date(F.col("o_orderdate")).alias(MONTH)).select(
        "o_orderkey", MONTH, calendar.year_of(month).alias("year"),
        calendar.month_of_year(month).alias("month"), calendar.month_label(month).alias("label"))


@query("month_range", """
SELECT o_custkey, CAST(unnest(range(lo, hi + 1)) AS INTEGER) AS month_id FROM (
  SELECT o_custkey, min((year(o_orderdate) - 1980) * 12 + month(o_orderdate)) AS lo,
         max((year(o_orderdate) - 1980) * 12 + month(o_orderdate)) AS hi FROM orders GROUP BY 1)""")
def month_range(spark, sf_dir):
    month = calendar.month_id_of_date(F.col("o_orderdate"))
    spans = tables.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.min(month).alias("first"), F.max(month).alias("last"))
    return calendar.month_range(spans, "first", "last").select("o_custkey", MONTH)


# --- normalisation ----------------------------------------------------------------------

@query("alias_key", f"""{with_tables('h')}
SELECT priogrid_id, count(*) AS months, sum(lr_ged_sb) AS sb FROM h GROUP BY 1""")
def alias_key(spark, sf_dir):
    old = tables.observed(spark, sf_dir).withColumnRenamed(CELL, LEGACY_CELL)
    return normalize.require_keys(normalize.alias_key(old)).groupBy(CELL).agg(
        F.count("*").alias("months"), F.sum("lr_ged_sb").alias("sb"))


@query("scalar_to_samples", f"""{with_tables('h')}
SELECT month_id, priogrid_id, CAST(CAST(lr_ged_sb AS BIGINT) AS VARCHAR) AS lr_ged_sb,
  CAST(lr_ged_ns AS BIGINT) || ',' || CAST(lr_ged_os AS BIGINT) AS pair FROM h""")
def scalar_to_samples(spark, sf_dir):
    mixed = tables.observed(spark, sf_dir).select(
        MONTH, CELL, "lr_ged_sb", F.array("lr_ged_ns", "lr_ged_os").alias("pair"))
    return vectors_as_text(normalize.as_vectors(mixed, ["lr_ged_sb", "pair"]))


@query("broadcast_features", f"""{with_tables('h')}
SELECT month_id, priogrid_id, {text_of('[lr_ged_sb, lr_ged_sb, lr_ged_sb, lr_ged_sb, lr_ged_sb]', 'lr_ged_sb')},
  {text_of('[lr_ged_ns, lr_ged_os, lr_ged_ns, lr_ged_os, lr_ged_ns]', 'pair')} FROM h""")
def broadcast_features(spark, sf_dir):
    mixed = tables.observed(spark, sf_dir).select(
        MONTH, CELL, "lr_ged_sb", F.array("lr_ged_ns", "lr_ged_os").alias("pair"))
    return vectors_as_text(normalize.broadcast_features(mixed, ["lr_ged_sb", "pair"], 5))


# --- validation ---------------------------------------------------------------------------

@query("sample_size_profile", """
SELECT t AS target, CAST(min(len(embedding) + x) AS INTEGER) AS min_draws,
       CAST(max(len(embedding) + x) AS INTEGER) AS max_draws
FROM (SELECT embedding, t, CASE WHEN t = 'ragged' THEN vec_id % 2 ELSE 0 END AS x
      FROM embeddings, (SELECT unnest(['even', 'ragged']) AS t)) GROUP BY 1""")
def sample_size_profile(spark, sf_dir):
    draws = tables.table(spark, sf_dir, "embeddings").select(
        F.col("embedding").alias("even"),
        F.when(F.col("vec_id") % 2 == 1, F.concat("embedding", F.array(F.lit(0.0).cast("float"))))
        .otherwise(F.col("embedding")).alias("ragged"))
    return validate.sample_size_profile(draws, ["even", "ragged"])


@query("duplicate_keys", """
SELECT CAST((year(l_shipdate) - 1980) * 12 + month(l_shipdate) AS INTEGER) AS month_id,
       l_suppkey AS priogrid_id, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_keys(spark, sf_dir):
    lines = tables.table(spark, sf_dir, "lineitem").select(
        calendar.month_id_of_date(F.col("l_shipdate")).alias(MONTH), F.col("l_suppkey").alias(CELL))
    return validate.duplicate_keys(lines)


_BAD = f"""{with_tables('g')}, bad AS (SELECT month_id, priogrid_id, pred_lr_ged_sb, pred_lr_ged_ns,
  list_transform(pred_lr_ged_os, lambda x, i: CASE WHEN v % 53 = 0 AND i = 1 THEN -x - 1
    WHEN v % 59 = 0 AND i = 2 THEN CAST('Infinity' AS DOUBLE) ELSE x END) AS pred_lr_ged_os
  FROM (SELECT *, priogrid_id * 5 + month_id - 258 AS v FROM g)),
s AS ({stacked('bad', 'month_id, priogrid_id')})"""


@query("value_plausibility", f"""{_BAD}
SELECT target, CAST(sum(len(list_filter(draws, lambda x: isinf(x)))) AS BIGINT) AS non_finite,
       CAST(sum(len(list_filter(draws, lambda x: x < 0))) AS BIGINT) AS negative,
       min(list_min(draws)) AS min_value FROM s GROUP BY 1""")
def value_plausibility(spark, sf_dir):
    return validate.value_plausibility(tables.posterior_with_negatives(spark, sf_dir), TARGETS)


@query("geo_plausibility", f"""{with_tables('geo')}
SELECT count_if(priogrid_id % 30 = 11) AS bad_longitude, CAST(0 AS BIGINT) AS bad_latitude,
       count_if(priogrid_id % 30 = 7) AS bad_iso3 FROM geo"""
       .replace("count_if(priogrid_id % 30 = 11)", "CAST(count_if(priogrid_id % 30 = 11) AS BIGINT)")
       .replace("count_if(priogrid_id % 30 = 7)", "CAST(count_if(priogrid_id % 30 = 7) AS BIGINT)"))
def geo_plausibility(spark, sf_dir):
    return validate.geo_plausibility(tables.geography(spark, sf_dir, damaged=True))


@query("geo_null_profile", f"""{with_tables('geo', 'geo_u')}
{' UNION ALL '.join(f"SELECT '{c}' AS column_name, CAST(count_if({c} IS NULL) AS BIGINT) AS nulls FROM geo_u" for c in GEO_COLUMNS)}""")
def geo_null_profile(spark, sf_dir):
    return validate.geo_null_profile(tables.geography(spark, sf_dir, unmapped=True, sentinel=True))


@query("grid_density", f"""{with_tables('h')}
SELECT *, months * cells - rows AS missing FROM (
  SELECT count(DISTINCT month_id) AS months, max(month_id) AS last_month,
    (SELECT count(DISTINCT priogrid_id) FROM h WHERE month_id = (SELECT max(month_id) FROM h)) AS last_month_cells,
    count(DISTINCT priogrid_id) AS cells, count(*) AS rows FROM h)""")
def grid_density(spark, sf_dir):
    return validate.grid_density(tables.observed(spark, sf_dir))


@query("order_violations", """
SELECT l_orderkey, count(*) AS rows, CAST(count_if(coalesce(p >= k, false)) AS BIGINT) AS violations FROM (
  SELECT l_orderkey, k, lag(k) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS p FROM (
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      ((year(l_shipdate) - 1980) * 12 + month(l_shipdate)) * 1000000000 + l_suppkey AS k FROM lineitem))
GROUP BY 1""")
def order_violations(spark, sf_dir):
    """Lines of an order stand in for rows of a file, their number for the position; three numbers make a block.

    Missing numbers come last, as they do in the SQL.
    """
    lines = tables.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.struct(
            F.coalesce(F.col("l_linenumber").cast("long"), F.lit(1 << 31)).alias("l_linenumber"),
            *[F.coalesce(c, F.lit((1 << 63) - 1)).alias(c) for c in ("l_partkey", "l_suppkey")]).alias("at"),
        calendar.month_id_of_date(F.col("l_shipdate")).alias(MONTH), F.col("l_suppkey").alias(CELL))
    return validate.order_violations(lines, "at", "l_orderkey", F.floor(F.col("at.l_linenumber") / 3))


