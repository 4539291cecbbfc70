"""The registry of named queries, and the SQL pieces their checks are built from.

Each query is registered with the SQL that states the same result over the same tables. Vectors
are shown as comma-joined whole numbers, so that both engines print them alike.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawfield.functions.ladder import LADDER
from drawfield.schema import MASSES, SERIES, THRESHOLDS, stat_names

QUERIES = {}
ORACLE = {}


def query(name, sql=None):
    def register(function):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function
    return register


def vectors_as_text(frame):
    """Vector columns of whole numbers as comma-joined text."""
    return frame.select(*[
        F.array_join(F.transform(F.col(f.name), lambda x: x.cast("long").cast("string")), ",", "null")
        .alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name)
        for f in frame.schema.fields])


# --- SQL: the input shapes -------------------------------------------------------------

def text_of(column, alias=None):
    """The SQL twin of :func:`vectors_as_text` for one column."""
    return (f"array_to_string(list_transform({column}, lambda x: "
            f"coalesce(CAST(CAST(x AS BIGINT) AS VARCHAR), 'null')), ',') AS {alias or column}")


_TABLES = {
    "g": """
    SELECT CAST(258 + vec_id % 5 AS INTEGER) AS month_id, vec_id // 5 AS priogrid_id,
           list_transform(embedding, lambda x: floor(greatest(CAST(x AS DOUBLE), 0.0) * 200)) AS pred_lr_ged_sb,
           list_transform(embedding, lambda x: floor(greatest(-CAST(x AS DOUBLE), 0.0) * 200)) AS pred_lr_ged_ns,
           list_transform(embedding, lambda x: floor(abs(CAST(x AS DOUBLE)) * 4000)) AS pred_lr_ged_os
    FROM embeddings""",
    "geo": """
    SELECT c.priogrid_id, -179.75e0 + 0.5e0 * (c.priogrid_id % 720) AS pg_xcoord,
           -89.75e0 + 0.5e0 * (c.priogrid_id // 720) AS pg_ycoord,
           ['AAA','BBB','CCC','DDD','EEE'][n_regionkey + 1] AS country_iso_a3,
           CAST(n_nationkey AS BIGINT) AS admin1_gaul1_code, n_name AS admin1_gaul1_name,
           CAST(n_regionkey AS BIGINT) AS admin1_gaul0_code, r_name AS admin1_gaul0_name,
           c.priogrid_id % 50 AS admin2_gaul2_code,
           'D' || (c.priogrid_id % 50) AS admin2_gaul2_name
    FROM (SELECT DISTINCT vec_id // 5 AS priogrid_id FROM embeddings) c
    JOIN nation ON n_nationkey = (c.priogrid_id % 50) % 25
    JOIN region ON r_regionkey = n_regionkey""",
    "geo_u": """
    SELECT priogrid_id, pg_xcoord, pg_ycoord,
           CASE WHEN priogrid_id % 40 <> 39 THEN CASE WHEN priogrid_id % 40 = 38 THEN '-99' ELSE country_iso_a3 END END AS country_iso_a3,
           CASE WHEN priogrid_id % 40 <> 39 THEN admin1_gaul1_code END AS admin1_gaul1_code,
           CASE WHEN priogrid_id % 40 <> 39 THEN admin1_gaul1_name END AS admin1_gaul1_name,
           CASE WHEN priogrid_id % 40 <> 39 THEN admin1_gaul0_code END AS admin1_gaul0_code,
           CASE WHEN priogrid_id % 40 <> 39 THEN admin1_gaul0_name END AS admin1_gaul0_name,
           CASE WHEN priogrid_id % 40 <> 39 THEN admin2_gaul2_code END AS admin2_gaul2_code,
           CASE WHEN priogrid_id % 40 <> 39 THEN admin2_gaul2_name END AS admin2_gaul2_name
    FROM geo""",
    "h": """
    SELECT CAST((year(l_shipdate) - 1980) * 12 + month(l_shipdate) AS INTEGER) AS month_id,
           l_suppkey AS priogrid_id,
           sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0.0 END) AS lr_ged_sb,
           sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0 END) AS lr_ged_ns,
           sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0.0 END) AS lr_ged_os
    FROM lineitem GROUP BY 1, 2""",
    "hgeo": """
    SELECT s.s_suppkey AS priogrid_id, n_regionkey AS r, n_nationkey AS n, s.s_suppkey % 50 AS g2,
           ['AAA','BBB','CCC','DDD','EEE'][n_regionkey + 1] AS country_iso_a3
    FROM supplier s JOIN nation ON n_nationkey = s_nationkey""",
    "c": """
    SELECT 'f' || event_id AS file_id, 'run_' || user_id || '.parquet' AS filename,
           'line_' || (user_id % 5) AS name,
           CASE event_type WHEN 'view' THEN 'sampled_forecast_manifest' WHEN 'click' THEN 'sampled_forecast_shard'
                WHEN 'error' THEN 'sampled_forecast_sidecar' ELSE 'model' END AS type,
           CASE WHEN event_id % 2 = 0 THEN 'forecast' ELSE 'historical' END AS category,
           'lr_ged_' || ['sb','ns','os'][event_id % 3 + 1] AS target,
           CASE WHEN event_id % 7 <> 0 THEN 'ens_' || (user_id % 5) END AS source,
           CASE WHEN event_id % 14 = 0 THEN 'pipe' END AS pipeline,
           'value ' || props AS description, sha256(CAST(event_id % 500 AS VARCHAR)) AS file_hash,
           ts AS created_at, ['1.5','1.4','1.6','2.0','','x'][event_id % 6 + 1] AS contract_version,
           event_id, user_id, value
    FROM events""",
}
_NEEDS = {"geo_u": ("geo",)}


def with_tables(*names):
    """A WITH clause naming the input shapes; more CTEs may follow after a comma."""
    order = []
    for name in names:
        for needed in (*_NEEDS.get(name, ()), name):
            if needed not in order:
                order.append(needed)
    return "WITH " + ",\n".join(f"{n} AS ({_TABLES[n]})" for n in order)


TARGETS_SQL = tuple(f"pred_lr_ged_{s}" for s in SERIES)


def stacked(source, keys, targets=TARGETS_SQL):
    """SQL rows (keys, target, draws) of a wide table."""
    return "\n UNION ALL ".join(
        f"SELECT {keys}, '{t}' AS target, {t} AS draws FROM {source}" for t in targets)


def joint_sum_sql(rows="j", keys="month_id, unit, target"):
    """CTE ``summed``: draws of ``rows`` summed position by position."""
    return f"""
positions AS (SELECT {keys}, i, sum(draws[i]) AS y
              FROM (SELECT *, unnest(range(1, len(draws) + 1)) AS i FROM {rows}) GROUP BY {keys}, i),
summed AS (SELECT {keys}, list(y ORDER BY i) AS draws FROM positions GROUP BY {keys})"""


def unit_rows(level_column, geo="geo", source="g"):
    """CTE ``j``: stacked draws with the unit of their cell, cells without one left out."""
    return f"""
j AS (SELECT s.month_id, geo_.{level_column} AS unit, s.target, s.draws
      FROM ({stacked(source, 'month_id, priogrid_id')}) s JOIN {geo} geo_ USING (priogrid_id)
      WHERE geo_.{level_column} IS NOT NULL)"""


def ladder_sql(source, keys, masses=MASSES, thresholds=THRESHOLDS, tail=0.05, out="stats"):
    """CTEs that collapse ``source(keys, draws)`` into ``out(keys, <statistics>)``."""
    ctes = [f"lad0 AS (SELECT {keys}, list_sort(draws) AS s, len(draws) AS n, list_sort(draws) AS w "
            f"FROM {source})"]
    at = {min(LADDER, key=lambda r: (round(abs(r - m), 9), -r)): round(m * 100) for m in masses}
    for number, rung in enumerate(LADDER, 1):
        bounds = (f", w[1] AS hdi{at[rung]}_lower, w[len(w)] AS hdi{at[rung]}_upper"
                  if rung in at else "")
        ctes.append(f"""lad{number} AS (SELECT *{bounds} FROM (
  SELECT * EXCLUDE (w, k, gaps, i), w[i:i + k - 1] AS w FROM (
    SELECT *, list_position(gaps, list_min(gaps)) AS i FROM (
      SELECT *, list_transform(range(1, len(w) - k + 2), lambda q: w[q + k - 1] - w[q]) AS gaps FROM (
        SELECT *, CAST(greatest(1, ceil({rung}e0 * n - 1e-9)) AS BIGINT) AS k FROM lad{number - 1})))))""")
    picked = [f"hdi{round(m * 100)}_{side}" for m in masses for side in ("lower", "upper")]
    exceed = [f"len(list_filter(s, lambda y: y > {c})) / n AS p_gt{c}" for c in thresholds]
    ctes.append(f"""{out} AS (SELECT {keys}, list_median(w) AS map, {', '.join(picked + [''])}
  list_sum(s[n - CAST(greatest(1, ceil({tail}e0 * n)) AS BIGINT) + 1 : n])
    / greatest(1, ceil({tail}e0 * n)) AS severe_scenario,
  CAST(CASE WHEN n >= 20 AND list_max(list_transform(
      range(CAST(ceil(0.1e0 * n - 1e-9) AS BIGINT), n - CAST(ceil(0.1e0 * n - 1e-9) AS BIGINT) + 1),
      lambda p: s[p + 1] - s[p])) > 0.25 * (s[n] - s[1]) THEN 1 ELSE 0 END AS DOUBLE) AS bimodality_flag
  {''.join(', ' + e for e in exceed)} FROM lad{len(LADDER)})""")
    return ",\n".join(ctes)


def pivot_sql(source, keys, targets=TARGETS_SQL, names=None, stem=lambda t: t):
    """SELECT that turns (keys, target, statistics) into one row per key."""
    columns = [f"max(CASE WHEN target = '{t}' THEN {s} END) AS {stem(t)}_{s}"
               for t in targets for s in (names or stat_names())]
    return f"SELECT {keys}, {', '.join(columns)} FROM {source} GROUP BY {keys}"
