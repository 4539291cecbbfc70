"""Summaries at cell level and per administrative unit."""

from pyspark.sql import functions as F

from drawfield.functions.ladder import collapse
from drawfield.operators.normalize import is_vector
from drawfield.operators.rollup import joint_sum, observed_rollup, with_names
from drawfield.operators.subset import subset, subset_at_level
from drawfield.schema import CELL, GEO_COLUMNS, MONTH, stat_names


def _check(alpha):
    """The credibility level is validated; the published intervals do not depend on it."""
    if not 0.0 < alpha < 1.0:
        raise ValueError(f"alpha lies in (0, 1), got {alpha}")


def spread_stats(frame, keys, targets, stats):
    """Struct columns named as the targets become ``<target>_<stat>`` columns."""
    return frame.selectExpr(*keys, *[f"`{t}`.{s} AS `{t}_{s}`" for t in targets for s in stats])


def summarize_cells(frame, targets, geo=None, months=None, cells=None, features=None, draws=None,
                    alpha=0.9, non_negative=False, strict=False):
    """All statistics of each (month, cell). Row by row: no shuffle, one pass to Python."""
    _check(alpha)
    if not all(is_vector(frame, t) for t in targets):
        raise ValueError("observed scalars have no cell-level summary")
    rows = subset(frame, targets, months, cells, features, draws, strict)
    chosen = rows.columns[2:]
    stats = rows.select(MONTH, CELL, *[
        collapse(F.col(t), non_negative=non_negative).alias(t) for t in chosen])
    flat = spread_stats(stats, [MONTH, CELL], chosen, stat_names())
    return flat if geo is None else flat.join(geo.select(CELL, *GEO_COLUMNS), CELL, "left")


def pivot_stats(long, targets, keys=(MONTH, "unit")):
    """(keys, target, stats struct) rows to one row per key; a dozen doubles per target move."""
    return long.groupBy(*keys).agg(*[
        F.expr(f"max(CASE WHEN target = '{t}' THEN stats.{s} END) AS `{t}_{s}`")
        for t in targets for s in stat_names()])


def summarize_level(frame, geo, level, targets, months=None, codes=None, draws=None, alpha=0.9,
                    non_negative=False, with_geo=True, width=None, drop_codes=(), strict=False):
    """Statistics of the jointly summed draws of each (month, unit): sum first, then collapse."""
    _check(alpha)
    rows = subset_at_level(frame, geo, targets, level, codes, with_geo=False,
                           months=months, draws=draws, strict=strict)
    if draws is not None:
        width = 1 if isinstance(draws, int) else len(draws)
    summed = joint_sum(rows, geo, level, targets, width, drop_codes)
    stats = summed.select(MONTH, "unit", "target",
                          collapse(F.col("draws"), non_negative=non_negative).alias("stats"))
    wide = pivot_stats(stats, targets)
    return with_names(wide, geo, level) if with_geo else wide


def summarize_observed(frame, geo, level, targets, with_geo=True, drop_codes=()):
    """The same columns for observed sums: a single draw, so every bound is the value itself."""
    summed = observed_rollup(frame, geo, level, targets, drop_codes)
    stats = summed.select(MONTH, "unit", *[
        collapse(F.array(F.col(t))).alias(t) for t in targets])
    flat = spread_stats(stats, [MONTH, "unit"], targets, stat_names())
    return with_names(flat, geo, level) if with_geo else flat
