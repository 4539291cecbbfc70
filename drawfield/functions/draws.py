"""Column functions over one vector of draws. No function here needs a shuffle."""

from pyspark.sql import functions as F

_INF = float("inf")


def _finite(y):
    return y.isNotNull() & ~F.isnan(y) & (F.abs(y) != _INF)


def scalar_to_draws(col):
    """A scalar column as a one-draw vector."""
    return F.array(F.col(col).cast("float"))


def all_missing(col):
    """No usable draw: the vector is NULL, empty, or holds only NaN or NULL."""
    return F.coalesce(F.forall(col, lambda y: y.isNull() | F.isnan(y)), F.lit(True))


def clean(col):
    """NULL for an all-missing vector, else the draws with non-finite values set to zero."""
    filled = F.transform(col, lambda y: F.when(_finite(y), y).otherwise(F.lit(0.0)))
    return F.when(~all_missing(col), filled)


def expected_shortfall(col, tail=0.05):
    """Mean of the largest ``max(1, ceil(tail * S))`` draws of a clean vector."""
    if not 0.0 < tail <= 1.0:
        raise ValueError(f"tail lies in (0, 1], got {tail}")
    k = F.greatest(F.lit(1), F.ceil(F.lit(float(tail)) * F.size(col)).cast("int"))
    worst = F.slice(F.sort_array(col, asc=False), F.lit(1), k)
    return F.aggregate(worst, F.lit(0.0), lambda total, y: total + y) / k


def exceedance(col, threshold):
    """Share of the draws of a clean vector strictly above ``threshold``."""
    above = F.size(F.filter(col, lambda y: y > F.lit(float(threshold))))
    return F.when(F.size(col) > 0, above / F.size(col))


def reduce_draws(col, how="mean"):
    """Mean, median or first draw; missing draws are ignored, an empty vector gives NULL."""
    if how == "first":
        return F.get(col, F.lit(0))
    known = F.filter(col, lambda y: y.isNotNull() & ~F.isnan(y))
    n = F.size(known)
    if how == "mean":
        total = F.aggregate(known, F.lit(0.0), lambda acc, y: acc + y)
        return F.when(n > 0, total / n)
    if how == "median":
        ordered = F.sort_array(known)
        low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
        high = F.get(ordered, F.floor(n / 2).cast("int"))
        return F.when(n > 0, (low + high) / 2)
    raise ValueError(f"cannot reduce draws by {how!r}; choose mean, median or first")


def transform_values(value, transform="log1p"):
    """``log1p`` of a reduced value; any other transform leaves it as it is."""
    return F.log1p(value) if transform == "log1p" else value


def pick_draws(col, indexes, width=None):
    """Draws at the given positions, order and repeats kept; a position outside is an error."""
    wanted = [indexes] if isinstance(indexes, int) else list(indexes)
    if any(i < 0 for i in wanted) or (width is not None and any(i >= width for i in wanted)):
        limit = "S - 1" if width is None else width - 1
        raise ValueError(f"draw positions run from 0 to {limit}, got {wanted}")
    picked = F.array(*[F.get(col, F.lit(i)) for i in wanted])
    if width is not None or not wanted:
        return picked
    outside = F.raise_error(F.concat(
        F.lit(f"draw position {max(wanted)} is outside a vector of "), F.size(col).cast("string")))
    return F.when(F.size(col) > max(wanted), picked).otherwise(outside)


def cycle_to(col, width):
    """A vector repeated from its start until it has ``width`` draws."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)),
                       lambda i: F.get(col, (i % F.size(col)).cast("int")))


def repeat_to(col, width):
    """A scalar repeated ``width`` times."""
    return F.array_repeat(col, width)


def suspicious(col):
    """True if any draw is missing, non-finite or negative.

    Uses only the two array extremes (NaN orders above every number), so a clean vector is
    passed without visiting its draws one by one in a lambda.
    """
    low, high = F.array_min(col), F.array_max(col)
    return F.coalesce(
        (low < 0) | F.isnan(high) | (high == _INF) | (F.size(F.array_compact(col)) < F.size(col)),
        F.lit(True))


def count_non_finite(col):
    return F.when(suspicious(col), F.size(F.filter(col, lambda y: ~_finite(y)))).otherwise(0)


def count_negative(col):
    return F.when(suspicious(col), F.size(F.filter(col, lambda y: _finite(y) & (y < 0)))).otherwise(0)


def min_finite(col):
    return F.when(suspicious(col), F.array_min(F.filter(col, _finite))).otherwise(F.array_min(col))
