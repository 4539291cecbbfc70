"""Data checks as small tables of counts, and ``enforce`` to turn a non-zero count into an error."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from drawfield.functions.draws import count_negative, count_non_finite, min_finite
from drawfield.schema import (CATEGORIES, CELL, GEO_COLUMNS, ISO3_PATTERN, LAT_RANGE, LON_RANGE,
                              MONTH, NO_COUNTRY)


def _stacked(frame, columns):
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return F.expr(f"stack({len(columns)}, {pairs}) as (target, draws)")


def sample_size_profile(frame, targets):
    """Smallest and largest vector per target."""
    return frame.select(_stacked(frame, targets)).groupBy("target").agg(
        F.min(F.size("draws")).alias("min_draws"), F.max(F.size("draws")).alias("max_draws"))


def duplicate_keys(frame, keys=(MONTH, CELL)):
    """Keys that occur more than once, with their number of rows."""
    return frame.groupBy(*keys).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)


def value_plausibility(frame, targets):
    """Per target: non-finite draws, negative draws, and the smallest finite draw."""
    draws = F.col("draws")
    return frame.select(_stacked(frame, targets)).select(
        "target", count_non_finite(draws).alias("bad"), count_negative(draws).alias("neg"),
        min_finite(draws).alias("low")).groupBy("target").agg(
        F.sum("bad").alias("non_finite"), F.sum("neg").alias("negative"),
        F.min("low").cast("double").alias("min_value"))


def geo_plausibility(geo):
    """Rows outside the coordinate ranges or without a three-letter country; NULL and -99 pass."""
    def outside(column, bounds):
        value = F.col(column).try_cast("double")
        return F.count_if(value.isNotNull() & ~value.between(*bounds))

    iso = F.col("country_iso_a3")
    return geo.agg(outside("pg_xcoord", LON_RANGE).alias("bad_longitude"),
                   outside("pg_ycoord", LAT_RANGE).alias("bad_latitude"),
                   F.count_if(iso.isNotNull() & (iso != NO_COUNTRY) & ~iso.rlike(ISO3_PATTERN))
                   .alias("bad_iso3"))


def geo_null_profile(geo):
    """NULLs per geography column."""
    pairs = ", ".join(f"'{c}', nulls_{c}" for c in GEO_COLUMNS)
    counts = geo.agg(*[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in GEO_COLUMNS])
    return counts.select(F.expr(f"stack({len(GEO_COLUMNS)}, {pairs}) as (column_name, nulls)"))


def grid_density(frame):
    """Rows against months x cells, and the cells of the last month."""
    cells = frame.agg(F.countDistinct(CELL)).scalar()
    per_month = frame.groupBy(MONTH).agg(F.countDistinct(CELL).alias("n"), F.count("*").alias("rows"))
    return per_month.agg(
        F.count("*").alias("months"), F.max(MONTH).alias("last_month"),
        F.max_by("n", MONTH).alias("last_month_cells"), F.sum("rows").alias("rows")
    ).withColumn("cells", cells).withColumn(
        "missing", F.col("months") * F.col("cells") - F.col("rows"))


ORDER_BLOCK = 1 << 16
#: Rows of a task, on average: larger inputs are sorted by more tasks, not by larger ones.
ORDER_TASK = 1 << 21


def order_violations(frame, sequence, group, block=None):
    """Rows whose (month, cell) does not follow the row before it in their file.

    ``sequence`` is the row's position and ``group`` the file it belongs to. Order is checked inside blocks of
    positions, each with a window of its own, and then only the edges of neighbouring blocks are compared, so
    a file of any size is checked by many tasks. ``block`` numbers the blocks and must never fall as ``sequence``
    grows; by default a block is ``ORDER_BLOCK`` positions. Rows without position are counted, and follow nothing.
    Rows of one position stand in the order of their (month, cell); where either is NULL, nothing is known to break.
    The rows are counted first, so that no task sorts much more than ``ORDER_TASK`` of them.
    """
    known = F.col(MONTH).isNotNull() & F.col(CELL).isNotNull()
    block = F.floor(F.col(sequence) / ORDER_BLOCK) if block is None else block
    rows = frame.filter(F.col(sequence).isNotNull()).select(
        group, sequence, F.when(known, F.struct(MONTH, CELL)).alias("key"), block.cast("long").alias("block"))
    tasks = _tasks(frame)
    before = F.lag("key").over(Window.partitionBy(group, "block").orderBy(sequence, "key"))
    # Edges by the same order as the window's, or a position's rows could be the last of one and the first of the other.
    place = F.struct(sequence, "key")
    inside = rows.repartition(*tasks, group, "block").withColumn("breaks", before >= F.col("key")).groupBy(group, "block").agg(
        F.count("*").alias("rows"), F.count_if("breaks").alias("inside"),
        F.min(place)["key"].alias("first"), F.max(place)["key"].alias("last"))
    left = F.lag("last").over(Window.partitionBy(group).orderBy("block"))
    edges = inside.repartition(*tasks, group).withColumn("edge", (left >= F.col("first")).cast("long")).select(
        group, "rows", (F.col("inside") + F.coalesce("edge", F.lit(0))).alias("violations"))
    loose = frame.filter(F.col(sequence).isNull()).select(
        group, F.lit(1).cast("long").alias("rows"), F.lit(0).cast("long").alias("violations"))
    return edges.unionByName(loose).groupBy(group).agg(
        F.sum("rows").alias("rows"), F.sum("violations").alias("violations"))


def _tasks(frame):
    """The number of tasks to deal a frame's rows to, for ``repartition``; left to Spark if one task could hold them all."""
    rows = frame.count()
    if rows <= ORDER_TASK:
        return []
    return [max(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ORDER_TASK))]


def catalog_validation(catalog):
    """Catalog rows that break each rule."""
    rules = {
        "file_id_required": F.col("file_id").isNull(),
        "filename_required": F.col("filename").isNull(),
        "name_required": F.col("name").isNull(),
        "type_required": F.col("type").isNull(),
        "targets_required": F.col("targets").isNull() | (F.size("targets") == 0),
        "category_allowed": F.col("category").isNull() | ~F.col("category").isin(*CATEGORIES),
        "source_known": F.col("source").isNull() & F.col("pipeline").isNull(),
        "hash_length": F.col("file_hash").isNotNull() & (F.length("file_hash") != 64),
    }
    counts = catalog.agg(*[F.count_if(bad).alias(name) for name, bad in rules.items()])
    pairs = ", ".join(f"'{name}', {name}" for name in rules)
    return counts.select(F.expr(f"stack({len(rules)}, {pairs}) as (rule, violations)"))


# --- enforcement ---------------------------------------------------------------

def enforce(counts, what, columns):
    """Raise if any of the count columns of a (small) check table is not zero; else return it."""
    wrong = counts.filter(" or ".join(f"`{c}` > 0" for c in columns)).limit(10).collect()
    if wrong:
        raise ValueError(f"{what}: " + "; ".join(str(r.asDict()) for r in wrong))
    return counts


def require_unique_keys(frame, keys=(MONTH, CELL)):
    enforce(duplicate_keys(frame, keys), f"duplicate {keys}", ["rows"])
    return frame


def require_uniform_draws(frame, targets):
    """Every vector of every target has the same length."""
    span = sample_size_profile(frame, targets).agg(
        (F.max("max_draws") - F.min("min_draws")).alias("spread"))
    enforce(span, "vectors of different length", ["spread"])
    return frame


def require_plausible_values(frame, targets):
    enforce(value_plausibility(frame, targets), "implausible draws", ["non_finite", "negative"])
    return frame


def require_plausible_geography(geo):
    enforce(geo_plausibility(geo), "implausible geography",
            ["bad_longitude", "bad_latitude", "bad_iso3"])
    return geo


def require_catalog(catalog):
    rules = catalog_validation(catalog).filter("rule <> 'source_known'")
    enforce(rules, "invalid catalog rows", ["violations"])
    return catalog
