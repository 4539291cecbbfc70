"""The data half of a map: reduced values, their common range, and raster positions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from drawfield.functions.draws import reduce_draws, transform_values
from drawfield.schema import CELL


def value_column(frame, exclude=()):
    """The one candidate value column; none or several is an error."""
    candidates = [c for c in frame.columns if c not in exclude]
    if len(candidates) != 1:
        raise ValueError(f"expected one value column, found {candidates}")
    return candidates[0]


def prepared(frame, column, how="mean", transform="log1p"):
    """Vectors reduced to one value and transformed."""
    value = reduce_draws(F.col(column).cast("array<double>"), how)
    return frame.withColumn("value", transform_values(value, transform))


def shared_range(frames, column, how="mean", transform="log1p"):
    """Common range of several frames; equal ends are pulled apart by a hair."""
    values = None
    for frame in frames:
        part = prepared(frame, column, how, transform).select("value")
        values = part if values is None else values.unionByName(part)
    known = values.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    span = known.agg(F.min("value").alias("vmin"), F.max("value").alias("vmax"))
    return span.withColumn("vmax", F.when(
        F.col("vmin") == F.col("vmax"), F.col("vmin") + 1e-9).otherwise(F.col("vmax")))


def _axis(geo, column):
    """Smallest coordinate and median spacing of the distinct coordinates of an axis, as scalars.

    Coordinates are compared with the one before them within one degree, and the ends of the degrees
    (360 at most) with each other, so no task sees a whole axis however fine the grid is.
    """
    x = F.col("x")
    points = geo.select(F.col(column).alias("x")).filter(x.isNotNull()).distinct().withColumn("degree", F.floor("x"))
    inside = points.select((x - F.lag("x").over(Window.partitionBy("degree").orderBy("x"))).alias("gap"))
    ends = points.groupBy("degree").agg(F.min("x").alias("first"), F.max("x").alias("last"))
    between = ends.select((F.col("first") - F.lag("last").over(Window.orderBy("degree"))).alias("gap"))
    gaps = inside.unionByName(between).filter("gap IS NOT NULL")
    return (points.agg(F.min("x")).scalar(),
            gaps.agg(F.coalesce(F.percentile("gap", F.lit(0.5)), F.lit(0.1))).scalar())


def raster_index(geo):
    """Row and column of each cell by absolute position, so that gaps in the grid stay gaps."""
    (left, across), (low, up) = _axis(geo, "pg_xcoord"), _axis(geo, "pg_ycoord")
    return geo.select(
        CELL, F.rint((F.col("pg_ycoord") - low) / up).cast("int").alias("row"),
        F.rint((F.col("pg_xcoord") - left) / across).cast("int").alias("col"))
