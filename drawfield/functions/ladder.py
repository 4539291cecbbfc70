"""Point estimate, nested intervals and the other summaries of a vector of draws.

Definition. Sort the draws. Walk down a fixed ladder of masses, starting with the whole vector:
at each rung keep the shortest run of ``max(1, ceil(mass * S))`` consecutive sorted draws inside
the run kept before it, the lowest start winning a tie. The interval of a mass is the first and
last draw kept at its rung (a mass off the ladder takes the nearest rung, the wider on a tie) and
the point estimate is the median of the last run. Intervals therefore nest whatever masses are
asked for, and their bounds are draws.

``collapse`` runs this on Arrow batches: Spark splits the rows, numpy handles a batch at once.
``ladder_by_expression`` states the same rule with built-in functions only.
"""

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawfield import schema
from drawfield.schema import MASSES, SEVERE_TAIL, THRESHOLDS, stat_names

# The kernel travels with the query, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(schema)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LADDER = (0.95, 0.90, 0.80, 0.70, 0.60, 0.50, 0.40, 0.30, 0.20, 0.10, 0.05)
CHUNK = 4096              # rows handled together, so that their draws stay in cache
SPLIT_MIN_DRAWS = 20      # fewer draws never count as two clusters
SPLIT_MIN_SHARE = 0.1     # each cluster holds at least this share of the draws
SPLIT_MIN_GAP = 0.25      # and the gap between them this share of the range


def rung_of(mass):
    """The ladder rung nearest to a mass."""
    if not 0.0 < mass <= 1.0:
        raise ValueError(f"a credible mass lies in (0, 1], got {mass}")
    return min(LADDER, key=lambda rung: (round(abs(rung - mass), 9), -rung))


def _run_length(mass, width):
    return max(1, math.ceil(mass * width - 1e-9))


def _descend(draws):
    """Bounds at every rung, and the median of the last run, of row-wise sorted draws.

    Only the start of each row's run is kept: a rung tries the few starts it may move to, one
    after the other for all rows at once, and gathers just the two ends of each candidate run.
    """
    rows, width = draws.shape
    flat = draws.reshape(-1)
    start = np.arange(rows) * width
    low, high, gap = np.empty(rows), np.empty(rows), np.empty(rows)
    length, bounds = width, {}
    for rung in LADDER:
        k = _run_length(rung, width)
        first, last = start.copy(), start + (k - 1)
        best = flat[last] - flat[first]
        shift = np.zeros(rows, dtype=start.dtype)
        for step in range(1, length - k + 1):
            first += 1
            last += 1
            flat.take(first, out=low, mode="clip")
            flat.take(last, out=high, mode="clip")
            np.subtract(high, low, out=gap)
            shorter = gap < best
            np.copyto(best, gap, where=shorter)
            np.copyto(shift, step, where=shorter)
        start += shift
        length = k
        bounds[rung] = flat[start], flat[start + (k - 1)]
    middle = (flat[start + (length - 1) // 2] + flat[start + length // 2]) / 2
    return bounds, middle


def _two_clusters(ordered):
    rows, width = ordered.shape
    if width < SPLIT_MIN_DRAWS:
        return np.zeros(rows)
    edge = math.ceil(SPLIT_MIN_SHARE * width - 1e-9)
    gaps = np.diff(ordered[:, edge - 1: width - edge + 1], axis=1)
    reach = ordered[:, -1] - ordered[:, 0]
    return (gaps.max(axis=1) > SPLIT_MIN_GAP * reach).astype(float)


def collapse_matrix(values, masses=MASSES, tail=SEVERE_TAIL, thresholds=THRESHOLDS,
                    non_negative=False):
    """Summaries of the rows of a ``(rows, draws)`` matrix, as ``{name: vector}``."""
    names = stat_names(masses, thresholds)
    rows, width = values.shape
    if rows > CHUNK:
        parts = [collapse_matrix(values[i:i + CHUNK], masses, tail, thresholds, non_negative)
                 for i in range(0, rows, CHUNK)]
        return {name: np.concatenate([p[name] for p in parts]) for name in names}
    out = {name: np.full(rows, np.nan) for name in names}
    known = ~np.isnan(values).all(axis=1) if width else np.zeros(rows, dtype=bool)
    if not known.any():
        return out
    part = values if known.all() else values[known]
    if not np.isfinite(part).all():
        part = np.where(np.isfinite(part), part, 0)
    ordered = np.sort(part, axis=1).astype(np.float64)
    bounds, point = _descend(ordered)
    stats = {"map": np.maximum(point, 0.0) if non_negative else point}
    for mass in masses:
        stats[f"hdi{round(mass * 100)}_lower"], stats[f"hdi{round(mass * 100)}_upper"] = \
            bounds[rung_of(mass)]
    k = max(1, math.ceil(tail * width))
    stats["severe_scenario"] = ordered[:, -k:].mean(axis=1)
    stats["bimodality_flag"] = _two_clusters(ordered)
    for c in thresholds:
        stats[f"p_gt{c:g}"] = (ordered > c).mean(axis=1)
    for name in names:
        out[name][known] = stats[name]
    return out


def _by_width(column):
    """Yield ``(row positions, matrix)`` for each vector length in an Arrow list column."""
    lengths = np.diff(column.offsets.to_numpy())
    present = column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False)
    if present.all() and len(lengths) and (lengths == lengths[0]).all():
        yield np.arange(len(column)), values.reshape(len(column), lengths[0])
        return
    sizes = np.where(present, lengths, 0)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
    for width in np.unique(sizes[present]):
        rows = np.flatnonzero(present & (sizes == width))
        yield rows, values[starts[rows][:, None] + np.arange(width)]


def collapse(col, masses=MASSES, tail=SEVERE_TAIL, thresholds=THRESHOLDS, non_negative=False):
    """All summaries of a vector column as one struct column of doubles, NULL where unknown.

    Only the vector itself travels to Python, in Arrow batches; ``non_negative`` clips the
    point estimate alone.
    """
    masses, thresholds = tuple(masses), tuple(thresholds)
    if not masses:
        raise ValueError("at least one credible mass is needed")
    if not 0.0 < tail <= 1.0:
        raise ValueError(f"tail lies in (0, 1], got {tail}")
    for mass in masses:
        rung_of(mass)
    names = stat_names(masses, thresholds)
    returned = T.StructType([T.StructField(n, T.DoubleType()) for n in names])

    @F.arrow_udf(returned)
    def summaries(column: pa.Array) -> pa.Array:
        found = {n: np.full(len(column), np.nan) for n in names}
        for rows, matrix in _by_width(column):
            part = collapse_matrix(matrix, masses, tail, thresholds, non_negative)
            for n in names:
                found[n][rows] = part[n]
        fields = [pa.array(found[n], from_pandas=True) for n in names]
        return pa.StructArray.from_arrays(fields, names=names)

    return summaries(col)


def hdi_single(col, mass, non_negative=False):
    """``lower``, ``upper`` and ``map`` at one mass, as a struct column."""
    stats = collapse(col, masses=(mass,), thresholds=(), non_negative=non_negative)
    pct = round(mass * 100)
    return F.struct(stats[f"hdi{pct}_lower"].alias("lower"),
                    stats[f"hdi{pct}_upper"].alias("upper"), stats["map"].alias("map"))


def ladder_by_expression(col, masses=MASSES):
    """Point estimate and intervals with built-in functions, for a clean vector of doubles."""
    kept_type = "struct<w:array<double>,b:array<struct<lo:double,hi:double>>>"
    ordered = F.sort_array(col.cast("array<double>"))
    width = F.size(col)

    def step(state, rung):
        w = state["w"]
        k = F.greatest(F.lit(1), F.ceil(rung * width - F.lit(1e-9)).cast("int"))
        spread = F.transform(F.sequence(F.lit(1), F.size(w) - k + 1),
                             lambda j: F.element_at(w, j + k - 1) - F.element_at(w, j))
        start = F.transform(F.array(spread),
                            lambda g: F.array_position(g, F.array_min(g)).cast("int"))[0]
        kept = F.slice(w, start, k)
        both = F.transform(F.array(kept), lambda s: F.struct(
            s.alias("w"),
            F.concat(state["b"], F.array(F.struct(
                F.element_at(s, 1).alias("lo"), F.element_at(s, -1).alias("hi")))).alias("b")))
        return both[0].cast(kept_type)

    start = F.struct(ordered.alias("w"),
                     F.lit(None).cast("array<struct<lo:double,hi:double>>").alias("b"))
    start = F.struct(start["w"].alias("w"),
                     F.coalesce(start["b"], F.array().cast(
                         "array<struct<lo:double,hi:double>>")).alias("b")).cast(kept_type)
    end = F.aggregate(F.array(*map(F.lit, LADDER)), start, step)
    last = end["w"]
    k = F.size(last)
    point = (F.get(last, F.floor((k - 1) / 2).cast("int")) + F.get(last, F.floor(k / 2).cast("int"))) / 2
    fields = [point.alias("map")]
    for mass in masses:
        at = end["b"][LADDER.index(rung_of(mass))]
        pct = round(mass * 100)
        fields += [at["lo"].alias(f"hdi{pct}_lower"), at["hi"].alias(f"hdi{pct}_upper")]
    return F.when(F.size(col) > 0, F.struct(*fields))
