"""Joint sums and summaries, per cell and per unit."""

from pyspark.sql import functions as F

from drawfield.functions.draws import (all_missing, clean, exceedance, expected_shortfall,
                                       reduce_draws)
from drawfield.functions.ladder import collapse, hdi_single
from drawfield.operators import crosslevel, rollup, summarize
from drawfield.plans.core import (TARGETS_SQL, joint_sum_sql, ladder_sql, pivot_sql, query, stacked,
                                  text_of, unit_rows, vectors_as_text, with_tables)
from drawfield.schema import CELL, LEVEL_NAMES, LEVELS, MONTH, stat_names
from drawfield.sources import tables
from drawfield.sources.tables import DRAWS, OBSERVED, TARGETS

NAMES_SQL = {
    level: "".join(f", min({c}) AS {c}" for c in carried) for level, carried in LEVEL_NAMES.items()}
SHOWN_TARGETS = ", ".join(text_of(t) for t in TARGETS_SQL)


def _wide_draws(source="summed"):
    picked = ", ".join(f"max(CASE WHEN target = '{t}' THEN draws END) AS {t}" for t in TARGETS_SQL)
    return f"w AS (SELECT month_id, unit, {picked} FROM {source} GROUP BY ALL)"


def history_geography(spark, sf_dir):
    """Cells of the observed history (suppliers) with the geography of their nation."""
    supplier = tables.table(spark, sf_dir, "supplier")
    nation = tables.table(spark, sf_dir, "nation")
    iso = F.element_at(F.array(*map(F.lit, ("AAA", "BBB", "CCC", "DDD", "EEE"))), F.col("n_regionkey") + 1)
    return supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select(
        F.col("s_suppkey").alias(CELL), iso.alias("country_iso_a3"),
        F.col("n_regionkey").cast("long").alias("admin1_gaul0_code"),
        F.col("n_nationkey").cast("long").alias("admin1_gaul1_code"),
        (F.col("s_suppkey") % 50).cast("long").alias("admin2_gaul2_code"))


for _level, _column in LEVELS.items():
    def _joint(spark, sf_dir, level=_level):
        summed = rollup.joint_sum(tables.posterior(spark, sf_dir), tables.geography(spark, sf_dir),
                                  level, TARGETS, DRAWS)
        return vectors_as_text(rollup.widen_draws(summed, TARGETS))

    query(f"joint_sum_{_level}", f"""{with_tables('g', 'geo')}, {unit_rows(_column)},
{joint_sum_sql()}, {_wide_draws()} SELECT month_id, unit, {SHOWN_TARGETS} FROM w""")(_joint)

    def _aggregated(spark, sf_dir, level=_level):
        return vectors_as_text(rollup.aggregated_subset(
            tables.posterior(spark, sf_dir), tables.geography(spark, sf_dir), level, TARGETS,
            months=[258, 260, 262], draws=list(range(DRAWS - 1, -1, -1))))

    query(f"agg_subset_{_level}", f"""{with_tables('g', 'geo')},
picked AS (SELECT month_id, priogrid_id, {', '.join(f'list_reverse({t}) AS {t}' for t in TARGETS_SQL)}
           FROM g WHERE month_id IN (258, 260, 262)), {unit_rows(_column, source='picked')},
{joint_sum_sql()}, {_wide_draws()},
names AS (SELECT {_column} AS unit{NAMES_SQL[_level]} FROM geo GROUP BY {_column})
SELECT w.month_id, w.unit, {SHOWN_TARGETS}{''.join(', names.' + c for c in LEVEL_NAMES[_level])}
FROM w LEFT JOIN names USING (unit)""")(_aggregated)

    def _summary(spark, sf_dir, level=_level):
        return summarize.summarize_level(
            tables.posterior(spark, sf_dir), tables.geography(spark, sf_dir), level, TARGETS, width=DRAWS)

    query(f"summary_{_level}", f"""{with_tables('g', 'geo')}, {unit_rows(_column)}, {joint_sum_sql()},
{ladder_sql('summed', 'month_id, unit, target')}, p AS ({pivot_sql('stats', 'month_id, unit')}),
names AS (SELECT {_column} AS unit{NAMES_SQL[_level]} FROM geo GROUP BY {_column})
SELECT p.*{''.join(', names.' + c for c in LEVEL_NAMES[_level])} FROM p LEFT JOIN names USING (unit)""")(_summary)

_EVERY_UNIT = f"""all_units AS ({' UNION ALL '.join(
    f"SELECT s.month_id, '{level}' AS level, CAST(geo_.{column} AS VARCHAR) AS unit, s.target, s.draws "
    f"FROM stacked_rows s JOIN %s geo_ USING (priogrid_id) WHERE geo_.{column} IS NOT NULL" for level, column in LEVELS.items())})"""
_LEVEL_KEYS = "month_id, level, unit, target"


def _all_levels(geo):
    return f"""{with_tables('g', *dict.fromkeys(('geo', geo)))}, stacked_rows AS ({stacked('g', 'month_id, priogrid_id')}),
{_EVERY_UNIT.replace('%s', geo)}, {joint_sum_sql('all_units', _LEVEL_KEYS)}"""


@query("joint_sum_all_levels", f"""{_all_levels('geo_u')},
w AS (SELECT month_id, level, unit, {', '.join(f"max(CASE WHEN target = '{t}' THEN draws END) AS {t}" for t in TARGETS_SQL)} FROM summed GROUP BY ALL)
SELECT month_id, level, unit, {SHOWN_TARGETS} FROM w""")
def joint_sum_all_levels(spark, sf_dir):
    """All levels from one sum of leaves, over a geography where countries cut through other units and cells lack codes."""
    geo = tables.geography(spark, sf_dir, unmapped=True, sentinel=True)
    summed = crosslevel.joint_sum_levels(tables.posterior(spark, sf_dir), geo, TARGETS, width=DRAWS)
    return vectors_as_text(summed.groupBy(MONTH, "level", "unit").agg(*[
        F.first(F.when(F.col("target") == t, F.col("draws")), ignorenulls=True).alias(t) for t in TARGETS]))


_CARRIED = list(dict.fromkeys(c for level in LEVELS for c in LEVEL_NAMES[level]))


@query("summary_all_levels", f"""{_all_levels('geo')},
{ladder_sql('summed', _LEVEL_KEYS)}, p AS ({pivot_sql('stats', 'month_id, level, unit')}),
names AS ({' UNION ALL '.join(f"SELECT '{level}' AS level, CAST({column} AS VARCHAR) AS unit, " + ', '.join(
    (f'min({c})' if c in LEVEL_NAMES[level] else 'NULL') + f' AS {c}' for c in _CARRIED) + f' FROM geo GROUP BY {column}'
    for level, column in LEVELS.items())})
SELECT p.*, {', '.join('names.' + c for c in _CARRIED)} FROM p LEFT JOIN names USING (level, unit)""")
def summary_all_levels(spark, sf_dir):
    return crosslevel.summarize_levels(tables.posterior(spark, sf_dir), tables.geography(spark, sf_dir), TARGETS, width=DRAWS)


HISTORY_LEVELS = {"country": "country_iso_a3", "gaul0": "r", "gaul1": "n", "gaul2": "g2"}

for _level, _column in HISTORY_LEVELS.items():
    def _observed(spark, sf_dir, level=_level):
        return rollup.observed_rollup(tables.observed(spark, sf_dir),
                                      history_geography(spark, sf_dir), level, OBSERVED)

    query(f"observed_rollup_{_level}", f"""{with_tables('h', 'hgeo')}
SELECT month_id, {_column if _level == 'country' else f'CAST({_column} AS BIGINT)'} AS unit,
       {', '.join(f'sum({t}) AS {t}' for t in OBSERVED)}
FROM h JOIN hgeo USING (priogrid_id) GROUP BY ALL""")(_observed)


@query("joint_sum_null_codes", f"""{with_tables('g', 'geo', 'geo_u')},
{unit_rows('country_iso_a3', geo='geo_u')}, {joint_sum_sql()}, {_wide_draws()}
SELECT month_id, unit, {SHOWN_TARGETS} FROM w""")
def joint_sum_null_codes(spark, sf_dir):
    """Unmapped cells are left out; the no-country code -99 stays a unit unless dropped."""
    geo = tables.geography(spark, sf_dir, unmapped=True, sentinel=True)
    summed = rollup.joint_sum(tables.posterior(spark, sf_dir), geo, "country", TARGETS, DRAWS)
    return vectors_as_text(rollup.widen_draws(summed, TARGETS))


@query("joint_sum_drop_sentinel", f"""{with_tables('g', 'geo', 'geo_u')},
{unit_rows('country_iso_a3', geo='geo_u')}, {joint_sum_sql()}, {_wide_draws()}
SELECT month_id, unit, {SHOWN_TARGETS} FROM w WHERE unit <> '-99'""")
def joint_sum_drop_sentinel(spark, sf_dir):
    geo = tables.geography(spark, sf_dir, unmapped=True, sentinel=True)
    summed = rollup.joint_sum(tables.posterior(spark, sf_dir), geo, "country", TARGETS, DRAWS,
                              drop_codes=("-99",))
    return vectors_as_text(rollup.widen_draws(summed, TARGETS))


@query("rollup_with_names", f"""{with_tables('g', 'geo')}
SELECT g.month_id, geo.admin2_gaul2_code AS unit, count(*) AS cells,
       min(country_iso_a3) AS country_iso_a3, min(admin2_gaul2_name) AS admin2_gaul2_name,
       min(admin1_gaul1_name) AS admin1_gaul1_name, min(admin1_gaul0_name) AS admin1_gaul0_name
FROM g JOIN geo USING (priogrid_id) GROUP BY 1, 2""")
def rollup_with_names(spark, sf_dir):
    geo = tables.geography(spark, sf_dir)
    counted = rollup.with_unit(tables.posterior(spark, sf_dir).select(MONTH, CELL), geo, "gaul2") \
        .groupBy(MONTH, "unit").agg(F.count("*").alias("cells"))
    return rollup.with_names(counted, geo, "gaul2")


@query("rollup_constants", f"""{with_tables('g', 'geo')}
SELECT g.month_id, CAST(geo.admin2_gaul2_code AS VARCHAR) AS unit, count(*) AS cells,
       (SELECT CAST(max(month_id) AS BIGINT) FROM g) AS last_month, 'posterior' AS origin
FROM g JOIN geo USING (priogrid_id) GROUP BY 1, 2""")
def rollup_constants(spark, sf_dir):
    """``last_month`` and ``origin`` hold one value in all rows and are carried, ``parity`` is not."""
    rows = tables.posterior(spark, sf_dir).select(MONTH, CELL)
    rows = rows.withColumns({"last_month": rows.agg(F.max(MONTH)).scalar().cast("long"), "origin": F.lit("posterior"),
                             "parity": F.col(CELL) % 2})
    counted = rollup.with_unit(rows, tables.geography(spark, sf_dir), "gaul2").groupBy(MONTH, F.col("unit").cast("string").alias("unit")) \
        .agg(F.count("*").alias("cells"))
    return rollup.carry_constants(counted, rows, ["last_month", "origin", "parity"])


@query("constant_columns", f"""{with_tables('geo')}
SELECT column_name FROM (
  SELECT 'country_iso_a3' AS column_name, count(DISTINCT country_iso_a3) AS n FROM geo
  UNION ALL SELECT 'admin1_gaul1_name', count(DISTINCT admin1_gaul1_name) FROM geo
  UNION ALL SELECT 'pg_ycoord', count(DISTINCT pg_ycoord) FROM geo) WHERE n = 1""")
def constant_columns(spark, sf_dir):
    return rollup.constant_columns(tables.geography(spark, sf_dir),
                                   ["country_iso_a3", "admin1_gaul1_name", "pg_ycoord"])


for _level, _column in HISTORY_LEVELS.items():
    def _observed_summary(spark, sf_dir, level=_level):
        return summarize.summarize_observed(tables.observed(spark, sf_dir), history_geography(spark, sf_dir),
                                            level, OBSERVED, with_geo=False)

    query(f"observed_summary_{_level}", f"""{with_tables('h', 'hgeo')},
s AS (SELECT month_id, {_column if _level == 'country' else f'CAST({_column} AS BIGINT)'} AS unit, {', '.join(f'sum({t}) AS {t}' for t in OBSERVED)}
      FROM h JOIN hgeo USING (priogrid_id) GROUP BY ALL)
SELECT month_id, unit{''.join(
    f", {t} AS {t}_map, {t} AS {t}_hdi50_lower, {t} AS {t}_hdi50_upper, {t} AS {t}_hdi90_lower,"
    f" {t} AS {t}_hdi90_upper, {t} AS {t}_hdi95_lower, {t} AS {t}_hdi95_upper,"
    f" {t} AS {t}_severe_scenario, CAST(0 AS DOUBLE) AS {t}_bimodality_flag,"
    f" CAST({t} > 25 AS DOUBLE) AS {t}_p_gt25, CAST({t} > 100 AS DOUBLE) AS {t}_p_gt100,"
    f" CAST({t} > 1000 AS DOUBLE) AS {t}_p_gt1000" for t in OBSERVED)} FROM s""")(_observed_summary)


# --- statistics of single vectors ---------------------------------------------------------

_ALL = f"{with_tables('g')}, long AS ({stacked('g', 'month_id, priogrid_id')})"
_KEYS = "month_id, priogrid_id, target"


def _long(spark, sf_dir):
    from drawfield.operators.grid import target_frames
    return target_frames(tables.posterior(spark, sf_dir), TARGETS)


@query("posterior_map", f"{_ALL}, {ladder_sql('long', _KEYS)} SELECT {_KEYS}, map FROM stats")
def posterior_map(spark, sf_dir):
    return _long(spark, sf_dir).select(MONTH, CELL, "target", collapse(F.col("draws"))["map"].alias("map"))


_BOUNDS = [s for s in stat_names() if s.startswith("hdi")]


@query("posterior_hdi", f"{_ALL}, {ladder_sql('long', _KEYS)} SELECT {_KEYS}, {', '.join(_BOUNDS)} FROM stats")
def posterior_hdi(spark, sf_dir):
    stats = _long(spark, sf_dir).withColumn("s", collapse(F.col("draws")))
    return stats.select(MONTH, CELL, "target", *[F.col(f"s.{b}").alias(b) for b in _BOUNDS])


@query("hdi_single_mass", f"""{_ALL}, {ladder_sql('long', _KEYS, masses=(0.72,), thresholds=())}
SELECT {_KEYS}, hdi72_lower AS lower, hdi72_upper AS upper, map FROM stats""")
def hdi_single_mass(spark, sf_dir):
    """A mass off the ladder takes the nearest rung, here 0.70."""
    stats = _long(spark, sf_dir).withColumn("s", hdi_single(F.col("draws"), 0.72))
    return stats.select(MONTH, CELL, "target", "s.lower", "s.upper", "s.map")


@query("expected_shortfall", f"""{_ALL} SELECT {_KEYS},
  list_sum(list_reverse_sort(draws)[1:4]) / 4 AS severe_5, list_sum(list_reverse_sort(draws)[1:16]) / 16 AS severe_25
FROM long""")
def expected_shortfall_(spark, sf_dir):
    draws = F.col("draws").cast("array<double>")
    return _long(spark, sf_dir).select(MONTH, CELL, "target", expected_shortfall(draws).alias("severe_5"),
                                       expected_shortfall(draws, 0.25).alias("severe_25"))


@query("exceedance", f"""{_ALL} SELECT {_KEYS},
  {', '.join(f'len(list_filter(draws, lambda y: y > {c})) / len(draws) AS p_gt{c}' for c in (25, 100, 1000))}
FROM long""")
def exceedance_(spark, sf_dir):
    return _long(spark, sf_dir).select(MONTH, CELL, "target", *[
        exceedance(F.col("draws"), c).alias(f"p_gt{c}") for c in (25, 100, 1000)])


@query("onset_probability", f"""{_ALL}
SELECT {_KEYS}, len(list_filter(draws, lambda y: y > 0)) / len(draws) AS p_onset FROM long""")
def onset_probability(spark, sf_dir):
    return _long(spark, sf_dir).select(MONTH, CELL, "target", exceedance(F.col("draws"), 0).alias("p_onset"))


@query("bimodality_flag", f"{_ALL}, {ladder_sql('long', _KEYS)} SELECT {_KEYS}, bimodality_flag FROM stats")
def bimodality_flag(spark, sf_dir):
    return _long(spark, sf_dir).select(MONTH, CELL, "target",
                                       collapse(F.col("draws"))["bimodality_flag"].alias("bimodality_flag"))


@query("collapse_cell", f"{_ALL}, {ladder_sql('long', _KEYS)} SELECT * FROM stats")
def collapse_cell(spark, sf_dir):
    return _long(spark, sf_dir).withColumn("s", collapse(F.col("draws"))).select(MONTH, CELL, "target", "s.*")


_GAPPY = f"""{with_tables('g')}, gaps AS (
  SELECT month_id, priogrid_id, CASE WHEN v % 89 = 0 THEN NULL ELSE
    list_transform(pred_lr_ged_sb, lambda x, i: CASE WHEN v % 97 = 0 AND i = 4 THEN 0.0 ELSE x END) END AS draws
  FROM (SELECT *, priogrid_id * 5 + month_id - 258 AS v FROM g)),
known AS (SELECT * FROM gaps WHERE draws IS NOT NULL)"""


@query("collapse_missing", f"""{_GAPPY}, {ladder_sql('known', 'month_id, priogrid_id')}
SELECT * FROM gaps g LEFT JOIN stats USING (month_id, priogrid_id)"""
       .replace("SELECT * FROM gaps g", f"SELECT month_id, priogrid_id, {', '.join(stat_names())} FROM gaps"))
def collapse_missing(spark, sf_dir):
    """All-missing vectors give NULL everywhere; single missing draws count as zero."""
    gaps = tables.posterior_with_gaps(spark, sf_dir)
    return gaps.withColumn("s", collapse(F.col(TARGETS[0]))).select(MONTH, CELL, "s.*")


@query("clean_draws", f"""{_GAPPY} SELECT month_id, priogrid_id, {text_of('draws')},
  draws IS NULL AS missing FROM gaps""")
def clean_draws(spark, sf_dir):
    draws = F.col(TARGETS[0]).cast("array<double>")
    return vectors_as_text(tables.posterior_with_gaps(spark, sf_dir).select(
        MONTH, CELL, clean(draws).alias("draws"), all_missing(draws).alias("missing")))


_SHIFTED = f"""{with_tables('g')}, low AS (
  SELECT month_id, priogrid_id, list_transform(pred_lr_ged_os, lambda x: x - 500) AS draws FROM g)"""


@query("map_non_negative", f"""{_SHIFTED}, {ladder_sql('low', 'month_id, priogrid_id', masses=(0.9,), thresholds=())}
SELECT month_id, priogrid_id, greatest(map, 0.0) AS map, hdi90_lower, hdi90_upper FROM stats""")
def map_non_negative(spark, sf_dir):
    """Only the point estimate is clipped at zero, the interval is not."""
    low = tables.posterior(spark, sf_dir).select(
        MONTH, CELL, F.transform(TARGETS[2], lambda x: x - 500).alias("draws"))
    return low.withColumn("s", collapse(F.col("draws"), masses=(0.9,), thresholds=(), non_negative=True)) \
        .select(MONTH, CELL, "s.map", "s.hdi90_lower", "s.hdi90_upper")


@query("summary_cell", f"""{_ALL}, {ladder_sql('long', _KEYS)}, {"p AS (" + pivot_sql('stats', 'month_id, priogrid_id') + ")"}
SELECT p.*, geo.* EXCLUDE (priogrid_id) FROM p LEFT JOIN geo USING (priogrid_id)"""
       .replace(with_tables('g'), with_tables('g', 'geo')))
def summary_cell(spark, sf_dir):
    return summarize.summarize_cells(tables.posterior(spark, sf_dir), TARGETS,
                                     geo=tables.geography(spark, sf_dir))


@query("reduce_samples", f"""{_ALL} SELECT {_KEYS}, list_sum(draws) / len(draws) AS mean,
  list_median(draws) AS median, draws[1] AS first FROM long""")
def reduce_samples(spark, sf_dir):
    draws = F.col("draws").cast("array<double>")
    return _long(spark, sf_dir).select(MONTH, CELL, "target", *[
        reduce_draws(draws, how).alias(how) for how in ("mean", "median", "first")])
