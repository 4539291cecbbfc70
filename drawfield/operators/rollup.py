"""Joint sums: draw j of an administrative unit is the sum of draw j over its cells.

Sums run in DOUBLE, are combined map-side before the one shuffle of the draws, and only units
that occur appear. A hot unit therefore sends one partial row per map task, not its cells.
"""

from pyspark.sql import functions as F

from drawfield.operators.normalize import sample_width
from drawfield.operators.subset import level_columns, subset_at_level
from drawfield.schema import CELL, LEVEL_NAMES, MONTH, level_column

BLOCK = 128     # sums per row; generated code for many more is no longer compiled by the JVM


def with_unit(frame, geo, level, drop_codes=()):
    """Each row with its unit code; rows of a cell without a code are left out, never pooled.

    A cell listed twice counts once, and with two different codes it is an error.
    """
    code = F.col(level_column(level))
    units = geo.filter(code.isNotNull()).groupBy(CELL).agg(F.min(code).alias("low"), F.max(code).alias("high")).select(
        CELL, F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.raise_error(F.concat(
            F.lit("cell "), F.col(CELL).cast("string"), F.lit(f" has more than one {level} code")))).alias("unit"))
    if dict(units.dtypes)["unit"] in ("double", "float"):
        units = units.filter(~F.isnan("unit")).withColumn("unit", F.col("unit").cast("long"))
    if drop_codes:
        units = units.filter(~F.col("unit").isin(*drop_codes))
    return frame.join(units, CELL)


def joint_sum(frame, geo, level, targets, width=None, drop_codes=()):
    """``(month_id, unit, target, draws)`` with the draws of every unit summed jointly.

    Targets are stacked so that one aggregate carries at most ``BLOCK`` sums; vectors wider than
    that are summed in blocks of ``BLOCK`` draws and joined again afterwards. A vector that does
    not hold exactly ``width`` draws is an error.
    """
    width = sample_width(frame, targets[0]) if width is None else width
    rows = with_unit(_of_width(frame, targets, width), geo, level, drop_codes)
    return sum_draws(stack_targets(rows, [MONTH, "unit"], targets), [MONTH, "unit", "target"], width)


def stack_targets(frame, keys, targets):
    """``keys``, ``target``, ``draws``: one row per target."""
    pairs = ", ".join(f"'{t}', `{t}`" for t in targets)
    return frame.select(*keys, F.expr(f"stack({len(targets)}, {pairs}) as (target, draws)"))


def sum_draws(rows, keys, width):
    """``keys`` and ``draws``: vectors of ``width`` draws summed position by position in DOUBLE."""
    if width <= BLOCK:
        return rows.groupBy(*keys).agg(_sums("draws", width).alias("draws"))
    last = -(-width // BLOCK) - 1
    parts = f"transform(sequence(0, {last}), b -> slice(draws, b * {BLOCK} + 1, {BLOCK}))"
    summed = (rows.select(*keys, F.expr(f"posexplode({parts}) as (block, part)"))
              .groupBy(*keys, "block").agg(_sums("part", BLOCK).alias("part")))
    # At most `last + 1` rows per key meet here, already summed.
    whole = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", "part"))),
                                  lambda s: s["part"]))
    return summed.groupBy(*keys).agg(F.slice(whole, 1, width).alias("draws"))


def _of_width(frame, targets, width):
    """The frame itself, an error where a vector does not hold exactly ``width`` draws."""
    exact = " AND ".join(f"size(`{t}`) = {width}" for t in targets)
    return frame.filter(f"CASE WHEN {exact} THEN true "
                        f"ELSE raise_error('expected {width} draws in every vector') END")


def _sums(column, width):
    """One sum per position. Stated as text: hundreds of Column objects are slow to build."""
    return F.expr(f"array({', '.join(f'sum(cast(get({column}, {i}) as double))' for i in range(width))})")


def widen_draws(long, targets):
    """One row per (month, unit) with a vector column per target."""
    by_target = long.groupBy(MONTH, "unit").agg(
        F.map_from_entries(F.collect_list(F.struct("target", "draws"))).alias("m"))
    return by_target.select(MONTH, "unit", *[F.element_at("m", t).alias(t) for t in targets])


def observed_rollup(frame, geo, level, targets, drop_codes=()):
    """Observed scalars summed in DOUBLE per (month, unit)."""
    return with_unit(frame, geo, level, drop_codes).groupBy(MONTH, "unit").agg(
        *[F.sum(F.col(t).cast("double")).alias(t) for t in targets])


def unit_names(geo, level):
    """The columns a level carries, one row per unit; a unit with two values is an error."""
    code, *carried = level_columns(level)
    found = geo.filter(F.col(code).isNotNull()).groupBy(F.col(code).alias("unit")).agg(
        *[F.min(c).alias(f"low_{c}") for c in carried], *[F.max(c).alias(f"high_{c}") for c in carried])
    return found.select("unit", *[
        F.when(F.col(f"low_{c}") != F.col(f"high_{c}"), F.raise_error(F.concat(
            F.lit(f"{level} "), F.col("unit").cast("string"), F.lit(f" has more than one {c}"))))
        .otherwise(F.col(f"low_{c}")).alias(c) for c in carried])


def level_conflicts(geo, level):
    """Units of a level whose carried columns disagree between cells."""
    code, *carried = level_columns(level)
    conflicts = [F.countDistinct(c).alias(f"n_{c}") for c in carried]
    return geo.filter(F.col(code).isNotNull()).groupBy(F.col(code).alias("unit")).agg(*conflicts).filter(
        F.greatest(F.lit(1), F.lit(1), *[F.col(f"n_{c}") for c in carried]) > 1)


def with_names(frame, geo, level):
    return frame.join(unit_names(geo, level), "unit", "left") if LEVEL_NAMES[level] else frame


def constant_columns(frame, columns):
    """Of some columns, those with one and the same non-NULL value in the whole frame."""
    spread = frame.agg(*[F.count_distinct(c).alias(c) for c in columns],
                       *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in columns])
    pairs = ", ".join(f"'{c}', {c}, nulls_{c}" for c in columns)
    return spread.select(F.expr(f"stack({len(columns)}, {pairs}) as (column_name, values, nulls)")) \
        .filter("values = 1 and nulls = 0").select("column_name")


def carry_constants(units, frame, columns):
    """A roll-up with those of the input's ``columns`` that hold one and the same value in all its rows.

    A column with two values, or with a NULL beside a value, is left out, as are all columns of an empty input
    and names the roll-up has already. One row with two values a column comes to the driver; nothing is joined.
    """
    columns = [c for c in dict.fromkeys(columns) if c not in units.columns]
    if not columns:
        return units
    found = frame.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (
        ("low", F.min), ("high", F.max), ("nulls", lambda c: F.count_if(F.col(c).isNull())))]).first()
    kinds = {c: frame.schema[c].dataType for c in columns}
    return units.withColumns({c: F.lit(found[f"low_{i}"]).cast(kinds[c]) for i, c in enumerate(columns)
                              if found[f"low_{i}"] is not None and found[f"low_{i}"] == found[f"high_{i}"]
                              and not found[f"nulls_{i}"]})


def aggregated_subset(frame, geo, level, targets, months=None, codes=None, draws=None,
                      with_geo=True, width=None, drop_codes=()):
    """Subset, then joint sum: months, unit codes and draws chosen, vectors per unit returned."""
    if level is None:
        raise ValueError("an aggregate needs a level")
    rows = subset_at_level(frame, geo, targets, level, codes, with_geo=False, months=months, draws=draws)
    if draws is not None:
        width = 1 if isinstance(draws, int) else len(draws)
    summed = widen_draws(joint_sum(rows, geo, level, targets, width, drop_codes), targets)
    return with_names(summed, geo, level) if with_geo else summed


