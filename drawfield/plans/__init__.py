"""Named queries over the test tables, each with the SQL that states the same result."""

from drawfield.plans import cataloguing, gating, gridding, published, rollups, subsets  # noqa: F401
from drawfield.plans.core import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
