"""Month ids: months counted from January 1980, which is month 1."""

from pyspark.sql import functions as F

from drawfield.schema import MONTH

FIRST_YEAR = 1980


def month_id(year, month):
    """Month id of a year and month column."""
    return ((year - FIRST_YEAR) * 12 + month).cast("int")


def month_id_of_date(date):
    return month_id(F.year(date), F.month(date))


def year_of(month):
    return (FIRST_YEAR + F.floor((month - 1) / 12)).cast("int")


def month_of_year(month):
    return (F.pmod(month - 1, F.lit(12)) + 1).cast("int")


def month_label(month):
    """``2024-12`` for month 540."""
    return F.format_string("%04d-%02d", year_of(month), month_of_year(month))


def month_range(frame, start, end, name=MONTH):
    """One row per month from ``start`` to ``end`` inclusive, for every row of ``frame``."""
    return frame.withColumn(name, F.explode(F.sequence(F.col(start), F.col(end))))
