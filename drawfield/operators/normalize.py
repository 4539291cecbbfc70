"""Bringing an input frame to the canonical columns. Checks here read only the schema."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawfield.functions.draws import cycle_to, repeat_to, scalar_to_draws
from drawfield.schema import CELL, GEO_COLUMNS, LEGACY_CELL, MONTH, PREDICTION_PREFIX


def alias_key(frame):
    """The old name of the cell key becomes the canonical one."""
    if LEGACY_CELL in frame.columns and CELL not in frame.columns:
        return frame.withColumnRenamed(LEGACY_CELL, CELL)
    return frame


def require_keys(frame):
    missing = [k for k in (MONTH, CELL) if k not in frame.columns]
    if missing:
        raise ValueError(f"key columns {missing} are missing; found {frame.columns}")
    return frame


def require_columns(frame, columns):
    missing = [c for c in columns if c not in frame.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; found {frame.columns}")
    return frame


def require_geography(frame):
    return require_columns(frame, GEO_COLUMNS)


def prediction_columns(frame):
    return [c for c in frame.columns if c.startswith(PREDICTION_PREFIX)]


def feature_columns(frame):
    """Everything that is neither a key nor a prediction."""
    return [c for c in frame.columns if c not in (MONTH, CELL) and not c.startswith(PREDICTION_PREFIX)]


def observed_targets(frame):
    """Columns that are neither keys nor geography."""
    return [c for c in frame.columns if c not in (MONTH, CELL) and c not in GEO_COLUMNS]


def targets_of(frame, targets=None):
    """The frame's targets: its predictions, else the ones named; neither is an error."""
    found = prediction_columns(frame)
    if found:
        extra = [c for c in feature_columns(frame) if c not in GEO_COLUMNS]
        if extra:
            raise ValueError(f"a prediction frame carries no other values, found {extra}")
        return found
    if not targets:
        raise ValueError(f"no {PREDICTION_PREFIX}* column and no target named; found {frame.columns}")
    require_columns(frame, targets)
    return list(targets)


def is_vector(frame, column):
    return isinstance(frame.schema[column].dataType, T.ArrayType)


def as_vectors(frame, columns):
    """Scalars become one-draw vectors and every vector ARRAY<FLOAT>."""
    return frame.withColumns({
        c: F.col(c).cast("array<float>") if is_vector(frame, c) else scalar_to_draws(c)
        for c in columns})


def broadcast_features(frame, columns, width):
    """Vectors cycled, and scalars repeated, to ``width`` draws."""
    return frame.withColumns({
        c: cycle_to(F.col(c), width) if is_vector(frame, c) else repeat_to(F.col(c), width)
        for c in columns})


def sample_width(frame, column):
    """Draws per vector, read from the first row; the roll-up holds the other rows to it."""
    first = frame.select(F.size(column).alias("n")).first()
    return first["n"] if first else 0
