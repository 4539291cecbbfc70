"""All administrative levels from one pass over the draws.

A *leaf* is a combination of unit codes, one per level, that cells have in common. Cells are summed to leaves
once, map-side first; every unit of every level is a sum of leaves. Where units nest (each unit lies inside
one unit of the next level) the leaves are the units of the finest level; a unit that crosses a border is
split into one leaf for each side, and all its leaves add up again, so its cells are never read a second time.
"""

from pyspark.sql import functions as F

from drawfield.functions.ladder import collapse
from drawfield.operators.normalize import sample_width
from drawfield.operators.rollup import _of_width, stack_targets, sum_draws, unit_names
from drawfield.operators.subset import keep_ids
from drawfield.operators.summarize import _check, spread_stats
from drawfield.schema import CELL, LEVEL_NAMES, LEVELS, MONTH, level_column, stat_names


def leaf_codes(geo, levels=tuple(LEVELS), drop_codes=()):
    """``priogrid_id`` and a STRING code for each of ``levels``: NULL where the cell has none.

    A cell listed twice counts once; with two different codes of one level it is an error. Cells without
    any code are left out.
    """
    codes = {}
    for level in levels:
        column, kind = level_column(level), dict(geo.dtypes)[level_column(level)]
        code = F.col(column)
        if kind in ("double", "float"):
            code = F.when(~F.isnan(code), code).cast("long")
        text = code.cast("string")
        codes[level] = F.when(~text.isin(*map(str, drop_codes)), text) if drop_codes else text
    found = geo.select(CELL, *[c.alias(level) for level, c in codes.items()]).groupBy(CELL).agg(
        *[F.min(level).alias(f"low_{level}") for level in levels], *[F.max(level).alias(f"high_{level}") for level in levels])
    checked = found.select(CELL, *[
        F.when(F.col(f"low_{level}") != F.col(f"high_{level}"), F.raise_error(F.concat(
            F.lit("cell "), F.col(CELL).cast("string"), F.lit(f" has more than one {level} code")))).otherwise(F.col(f"low_{level}"))
        .alias(level) for level in levels])
    return checked.filter(F.coalesce(*levels).isNotNull())


def nesting(codes, levels=tuple(LEVELS)):
    """Which levels have units of one leaf only: their sums are the leaves', without another shuffle."""
    leaves = codes.select(*levels).distinct()
    several = leaves.select(*[(F.count(level) > F.count_distinct(level)).alias(level) for level in levels]).first()
    return tuple(level for level in levels if not several[level])


def leaf_sums(frame, codes, targets, width=None, levels=tuple(LEVELS)):
    """``month_id``, the codes of ``levels``, ``target``, ``draws``: the joint sums of all leaves.

    The only step that reads cells. A leaf that holds a third of all cells sends one partial row per task.
    """
    width = sample_width(frame, targets[0]) if width is None else width
    rows = _of_width(frame, targets, width).join(codes, CELL)
    return sum_draws(stack_targets(rows, [MONTH, *levels], targets), [MONTH, *levels, "target"], width), width


def joint_sum_levels(frame, geo, targets, levels=tuple(LEVELS), width=None, drop_codes=(), months=None):
    """``month_id``, ``level``, ``unit`` (STRING), ``target``, ``draws`` for every unit of every level.

    The same sums as ``rollup.joint_sum`` gives level by level. Levels whose units are single leaves are read
    from the leaves as they are; the leaves of the others are added up, combined map-side again.
    """
    codes = leaf_codes(geo, levels, drop_codes)
    leaves, width = leaf_sums(keep_ids(frame, MONTH, months), codes, targets, width, levels)
    whole = nesting(codes, levels)

    def units(names):
        pairs = ", ".join(f"'{level}', `{level}`" for level in names)
        return leaves.select(MONTH, F.expr(f"stack({len(names)}, {pairs}) as (level, unit)"), "target", "draws").filter("unit IS NOT NULL")

    rest = [level for level in levels if level not in whole]
    parts = [units(whole)] if whole else []
    if rest:
        parts.append(sum_draws(units(rest), [MONTH, "level", "unit", "target"], width))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def level_names(geo, levels=tuple(LEVELS)):
    """``level``, ``unit`` (STRING) and all columns that any level carries, NULL where a level does not carry one.

    Levels that carry none have no row."""
    carried = list(dict.fromkeys(c for level in levels for c in LEVEL_NAMES[level]))
    parts = []
    for level in filter(LEVEL_NAMES.get, levels):
        names = unit_names(geo, level)
        parts.append(names.select(F.lit(level).alias("level"), F.col("unit").cast("string").alias("unit"), *[
            F.col(c) if c in LEVEL_NAMES[level] else F.lit(None).cast(dict(geo.dtypes)[c]).alias(c) for c in carried]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def summarize_levels(frame, geo, targets, levels=tuple(LEVELS), width=None, drop_codes=(), months=None, alpha=0.9,
                     non_negative=False, with_geo=True):
    """The statistics of ``summarize.summarize_level`` for all levels: ``month_id``, ``level``, ``unit``, ``<target>_<stat>``."""
    _check(alpha)
    summed = joint_sum_levels(frame, geo, targets, levels, width, drop_codes, months)
    stats = summed.select(MONTH, "level", "unit", "target", collapse(F.col("draws"), non_negative=non_negative).alias("stats"))
    keys = [MONTH, "level", "unit"]
    by_target = stats.groupBy(*keys).agg(*[
        F.first(F.when(F.col("target") == t, F.col("stats")), ignorenulls=True).alias(t) for t in targets])
    wide = spread_stats(by_target, keys, targets, stat_names())
    named = with_geo and any(LEVEL_NAMES[level] for level in levels)
    return wide.join(level_names(geo, levels), ["level", "unit"], "left") if named else wide
