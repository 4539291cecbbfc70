"""The month x cell grid: filling, backfilling, exporting, profiling.

Months are a bounded dimension (a calendar: a few hundred, whatever the number of cells), so a
cell's set of months is a small array. Holes are found from the two key columns alone and the
filled rows are appended: the wide vector columns are never shuffled.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawfield.functions.draws import pick_draws
from drawfield.operators.assemble import to_vectors
from drawfield.operators.normalize import is_vector
from drawfield.schema import CELL, MONTH


def months_of(frame):
    """The distinct months in ascending order, as a scalar array."""
    return frame.agg(F.sort_array(F.collect_set(MONTH))).scalar()


def missing_pairs(frame, entities="last"):
    """The (month, cell) pairs the grid lacks.

    ``last``: the cells of the last month define the grid, and a cell absent from it is an
    error when the rows are read. ``all``: every cell ever seen does.
    """
    have = frame.groupBy(CELL).agg(F.collect_set(MONTH).alias("have"))
    # The months come from the same profile, so that Spark reuses its shuffle and reads the keys once.
    months = have.select(F.explode("have").alias(MONTH)).agg(F.sort_array(F.collect_set(MONTH))).scalar()
    holes = F.array_except(months, F.col("have"))
    if entities == "last":
        absent = F.raise_error(F.concat(
            F.lit("cell "), F.col(CELL).cast("string"),
            F.lit(" is absent from the last month and would be dropped from the grid")))
        holes = F.when(F.array_contains("have", F.array_max(months)), holes).otherwise(absent)
    return have.select(F.explode(holes).alias(MONTH), CELL)


def complete_grid(frame, fill, entities="last"):
    """The frame plus one row per missing pair, each other column holding ``fill`` (or NULL)."""
    values = [c for c in frame.columns if c not in (MONTH, CELL)]

    def filler(column):
        kind = frame.schema[column].dataType
        if not is_vector(frame, column):
            return F.lit(fill).cast(kind)
        width = frame.agg(F.max(F.size(column))).scalar()
        return F.array_repeat(F.lit(fill).cast(kind.elementType), width)

    filled = missing_pairs(frame, entities).select(
        MONTH, CELL, *[filler(c).alias(c) for c in values])
    return frame.select(MONTH, CELL, *values).unionByName(filled)


def dense_fill(frame, fill=0.0, entities="last"):
    """Every month x every cell of the last month (or of any month); a recreated row holds ``fill``."""
    return complete_grid(frame, fill, entities)


def entities_absent_last_step(frame):
    """Cells that occur, but not in the last month."""
    keys = frame.select(MONTH, CELL)
    last = keys.agg(F.max(MONTH)).scalar()
    return keys.groupBy(CELL).agg(F.max(MONTH).alias("last_seen")).filter(F.col("last_seen") < last)


def is_dense(frame):
    """One aggregate over the keys: as many rows as months x cells, no pair twice."""
    per_cell = frame.groupBy(CELL).agg(
        F.count("*").alias("rows"), F.collect_set(MONTH).alias("have"))
    months = F.array_size(months_of(frame))
    holes = per_cell.filter((F.size("have") != months) | (F.col("rows") != months))
    return holes.limit(1).count() == 0


def dense_fill_if_needed(frame, fill=0.0):
    """:func:`dense_fill`, planned only when the grid has holes."""
    return frame if is_dense(frame) else dense_fill(frame, fill)


def tensor_long(frame, targets):
    """Every month x every cell x every draw, NULL where the cell is absent."""
    full = complete_grid(frame.select(MONTH, CELL, *targets), None, "all")
    pairs = ", ".join(f"'{t}', `{t}`" for t in targets)
    return (full.select(MONTH, CELL, F.expr(f"stack({len(targets)}, {pairs}) as (target, draws)"))
            .select("target", MONTH, CELL, F.posexplode("draws").alias("sample", "value")))


def month_block(frame, month, target, cells=None, positions=None):
    """One target in one month over all cells, NULL for an absent one; cells and draws optional."""
    wanted = frame if cells is None else frame.filter(F.col(CELL).isin(*cells))
    present = wanted.filter(F.col(MONTH) == month).select(CELL, target)
    absent = wanted.select(CELL).distinct().join(present.select(CELL), CELL, "left_anti").select(
        CELL, F.lit(None).cast(frame.schema[target].dataType).alias(target))
    block = present.unionByName(absent)
    if positions is None:
        return block
    return block.withColumn(target, F.when(
        F.col(target).isNotNull(), pick_draws(F.col(target), positions)))


def target_frames(frame, targets):
    """All targets under each other: target, month, cell, draws."""
    pairs = ", ".join(f"'{t}', `{t}`" for t in targets)
    return frame.select(F.expr(f"stack({len(targets)}, {pairs}) as (target, draws)"), MONTH, CELL)


def fingerprint(frame, columns, by=()):
    """Rows and two order-free sums of 64-bit row hashes, for each ``by``: equal for equal multisets of rows.

    Only counts and sums are shuffled, combined map-side. Integers are hashed as long, so a column's width in
    storage makes no difference; -0.0 and 0.0 are one value, as are all NaN. Hash functions pass NULL
    over, so its places are hashed too. An empty table gives no row where ``by`` is named, else one without sums.
    """
    hashes = [h.alias(n) for h, n in zip(_row_hashes(frame, columns), ("h1", "h2"))]
    return frame.select(*by, *hashes).groupBy(*by).agg(
        F.count("*").alias("rows"), *[F.sum(F.col(h).cast("decimal(38,0)")).alias(f"sum_{h}") for h in ("h1", "h2")])


def _row_hashes(frame, columns):
    parts = []
    for name in columns:
        column, kind = F.col(name), frame.schema[name].dataType
        if isinstance(kind, T.IntegralType):
            column = column.cast("long")
        parts += [column, column.isNull()]
        if isinstance(kind, T.ArrayType):
            parts += [F.size(column), F.when(F.exists(column, lambda x: x.isNull()), F.transform(column, lambda x: x.isNull()))]
    return F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)


def integrity_roundtrip(frame, targets):
    """Take the vectors apart, put them together again, and count the rows that differ.

    The two sides are compared by fingerprint, so this shuffles a key and its hashes, never a vector; a key's rows
    differ if the sides hold them in other numbers or with other hashes. A NULL vector has nothing to take apart
    and does not differ; an empty one cannot be put together and does.
    """
    before = target_frames(frame, targets)
    long = before.select("target", MONTH, CELL, F.size("draws").alias("sample_count"),
                         F.posexplode("draws").alias("sample", "value"))
    sides = [_hashed(before, 1), _hashed(to_vectors(long), -1)]
    keys = sides[0].unionByName(sides[1]).groupBy("target", MONTH, CELL).agg(
        *[F.sum(c).alias(c) for c in ("side", "h1", "h2")])
    same = (F.col("side") == 0) & (F.col("h1") == 0) & (F.col("h2") == 0)
    return keys.groupBy("target").agg(F.count("*").alias("rows"), F.count_if(~same).alias("differing"))


def _hashed(vectors, side):
    h1, h2 = _row_hashes(vectors, ["draws"])
    weight = F.when(F.col("draws").isNull(), 0).otherwise(side)
    return vectors.select("target", MONTH, CELL, weight.alias("side"), *[
        (h.cast("decimal(38,0)") * weight).cast("decimal(38,0)").alias(n) for h, n in ((h1, "h1"), (h2, "h2"))])


SKETCH_LG_K = 12
SKETCH_BOUND = 0.05  # three standard errors, 1.04 / sqrt(2 ** SKETCH_LG_K) each


def cell_sketches(frame, by):
    """For each ``by`` (a run, a month) its rows and an HLL sketch of its cells: a few KB each, to be stored."""
    return frame.groupBy(*by).agg(F.count("*").alias("rows"), F.hll_sketch_agg(CELL, SKETCH_LG_K).alias("sketch"))


def merge_sketches(sketches, by=()):
    """Rows and estimated cells of the union over stored sketches; draws are not read again.

    The estimate is within ``SKETCH_BOUND`` of the exact count in all but a few cases of a thousand.
    """
    return sketches.groupBy(*by).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
                                     F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("cells"))


def grid_profile(frame, targets, approximate=False):
    """Cells, months, rows and the vector length; ``approximate`` counts cells by sketch."""
    cells = F.approx_count_distinct(CELL) if approximate else F.countDistinct(CELL)
    return frame.agg(cells.alias("cells"), F.countDistinct(MONTH).alias("months"),
                     F.count("*").alias("rows"), F.lit(len(targets)).cast("long").alias("targets"),
                     *[F.max(F.size(targets[0]) if is_vector(frame, targets[0]) else F.lit(1))
                       .cast("long").alias("draws")])


def geo_backfill(frame, geo_columns):
    """One geography per cell: each column's value from the earliest month that has one.

    Only a cell with a NULL somewhere takes these values, and then in all its rows and columns.
    Pass the keys and the geography alone: draws need not travel through this join.
    """
    first = {c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)),
                         F.when(F.col(c).isNotNull(), F.col(MONTH))) for c in geo_columns}
    found = frame.groupBy(CELL).agg(
        *[value.alias(f"first_{c}") for c, value in first.items()],
        F.bool_or(F.greatest(*[F.col(c).isNull() for c in geo_columns])).alias("incomplete"))
    rest = [c for c in frame.columns if c not in geo_columns]
    return frame.join(found, CELL).select(*rest, *[
        F.when(F.col("incomplete"), F.col(f"first_{c}")).otherwise(F.col(c)).alias(c)
        for c in geo_columns])


def matrix_to_long(frame, targets):
    """``map`` and interval matrices under each other, a NULL point estimate dropped."""
    parts = ", ".join(f"'{t}', `{t}`.map, `{t}`.lower, `{t}`.upper" for t in targets)
    return frame.select(MONTH, CELL, F.expr(
        f"stack({len(targets)}, {parts}) as (target, map, hdi_lower, hdi_upper)")).filter(
        F.col("map").isNotNull())


def map_to_long(frame, targets):
    """``month_id``, cell, ``target``, ``map``: a NULL point estimate has no row."""
    pairs = ", ".join(f"'{t}', `{t}`.map" for t in targets)
    return frame.select(MONTH, CELL, F.expr(f"stack({len(targets)}, {pairs}) as (target, map)")).filter(
        F.col("map").isNotNull() & ~F.isnan("map"))


def interval_to_long(frame, targets):
    """``month_id``, cell, ``target``, ``hdi_lower``, ``hdi_upper``: every row stays, NULL or not."""
    parts = ", ".join(f"'{t}', `{t}`.lower, `{t}`.upper" for t in targets)
    return frame.select(MONTH, CELL, F.expr(f"stack({len(targets)}, {parts}) as (target, hdi_lower, hdi_upper)"))
