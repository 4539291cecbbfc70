"""The published admin-1 table, JSON-safe rows, and run-by-run publication."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawfield.operators.rollup import observed_rollup
from drawfield.operators.summarize import summarize_level
from drawfield.schema import (IDENTITY, MONTH, consumer_names, published_columns, series_of,
                              stat_column)


def to_consumer_columns(frame):
    return frame.withColumnsRenamed(consumer_names(frame.columns))


def hierarchy_conflicts(geo):
    """Admin-1 codes with more than one identity; cells without a code are no unit."""
    code = IDENTITY["admin1_code"]
    rest = [c for c in IDENTITY.values() if c != code]
    return geo.filter(F.col(code).isNotNull()).select(code, *rest).distinct().groupBy(
        F.col(code).alias("admin1_code")).agg(F.count("*").alias("identities")).filter("identities > 1")


def identity_table(geo):
    """One row per admin-1 unit; reading a unit with two identities is an error."""
    code = F.col(IDENTITY["admin1_code"])
    rest = [n for n in IDENTITY if n != "admin1_code"]
    identity = F.struct(*[F.col(IDENTITY[n]).alias(n) for n in rest])
    units = geo.filter(code.isNotNull()).groupBy(code.alias("admin1_code")).agg(
        F.min(identity).alias("low"), F.max(identity).alias("high"))
    checked = F.when(F.col("low").eqNullSafe(F.col("high")), F.col("low")).otherwise(F.raise_error(
        F.concat(F.lit("admin-1 code "), F.col("admin1_code").cast("string"),
                 F.lit(" has more than one identity"))))
    return units.select("admin1_code", checked.alias("i")).select(
        "admin1_code", *[F.col(f"i.{n}").alias(n) for n in rest])


def actuals_admin1(history, geo, targets):
    """Observed counts per (month, admin-1), one column per series."""
    summed = observed_rollup(history, geo, "gaul1", targets)
    return summed.select(MONTH, F.col("unit").alias("admin1_code"), *[
        F.col(t).alias(stat_column(series_of(t), "actual")) for t in targets])


def bulk_table(frame, geo, targets, history=None, history_targets=(), history_geo=None, width=None):
    """The 45 published columns, one row per (month, admin-1).

    ``actual`` is NULL where there is no observation. Pass ``history`` explicitly or leave it
    out: a history that cannot be read fails instead of turning into NULLs.
    """
    consumer_names([f"{t}_map" for t in targets])     # two targets of one series stop here
    values = to_consumer_columns(
        summarize_level(frame, geo, "gaul1", targets, with_geo=False, width=width)
    ).withColumnRenamed("unit", "admin1_code")
    table = values.join(identity_table(geo), "admin1_code", "left")
    if history is not None:
        actuals = actuals_admin1(history, history_geo or geo, list(history_targets))
        table = table.join(actuals, [MONTH, "admin1_code"], "left")
    present = set(table.columns)
    return table.selectExpr(*[
        c if c in present else f"CAST(NULL AS double) AS {c}" for c in published_columns()])


# --- JSON-safe rows --------------------------------------------------------------

def json_clean(frame):
    """NaN and infinities to NULL, one-element vectors to their element."""
    def finite(c):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)

    cleaned = []
    for field in frame.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            c = finite(c)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
            c = F.transform(c, finite)
        cleaned.append(c.alias(field.name))
    return frame.select(*cleaned)


def unwrap_single(frame, columns):
    """Vectors of exactly one draw in every row shown as scalars; a longer one is an error."""
    return frame.withColumns({c: F.when(F.size(c) <= 1, F.get(c, F.lit(0))).when(
        F.size(c) > 1, F.raise_error(F.lit(f"{c} holds more than one draw"))) for c in columns})


def json_rows(frame):
    """One JSON text per row; a NULL field keeps its key."""
    return json_clean(frame).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
