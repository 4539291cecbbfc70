"""Names and types every other module shares."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# The published contract. They must stay exactly as they are.
# ---------------------------------------------------------------------------
MONTH = "month_id"
CELL = "priogrid_id"
LEGACY_CELL = "priogrid_gid"
PREDICTION_PREFIX = "pred_"

MASSES = (0.50, 0.90, 0.95)
THRESHOLDS = (25, 100, 1000)
SERIES = ("sb", "ns", "os")
SEVERE_TAIL = 0.05

GEO_COLUMNS = (
    "pg_xcoord",
    "pg_ycoord",
    "country_iso_a3",
    "admin1_gaul1_code",
    "admin1_gaul1_name",
    "admin1_gaul0_code",
    "admin1_gaul0_name",
    "admin2_gaul2_code",
    "admin2_gaul2_name",
)

LEVELS = {
    "country": "country_iso_a3",
    "gaul0": "admin1_gaul0_code",
    "gaul1": "admin1_gaul1_code",
    "gaul2": "admin2_gaul2_code",
}

LEVEL_NAMES = {
    "country": (),
    "gaul0": ("country_iso_a3", "admin1_gaul0_name"),
    "gaul1": ("country_iso_a3", "admin1_gaul1_name", "admin1_gaul0_name"),
    "gaul2": ("country_iso_a3", "admin2_gaul2_name", "admin1_gaul1_name", "admin1_gaul0_name"),
}

IDENTITY = {
    "admin1_code": "admin1_gaul1_code",
    "admin1_name": "admin1_gaul1_name",
    "country_code": "admin1_gaul0_code",
    "country_name": "admin1_gaul0_name",
    "country_iso3": "country_iso_a3",
}

CONTRACT_VERSION = "1.5"
FRESHNESS_SLA_DAYS = 45.0
CATEGORIES = ("forecast", "historical")
MODEL_TYPE = "model"
MANIFEST_TYPE = "sampled_forecast_manifest"
SHARD_TYPE = "sampled_forecast_shard"
SIDECAR_TYPE = "sampled_forecast_sidecar"
MANIFEST_SUFFIX = "__manifest.json"
SERVED_RUN_TEXT = "Sampled-forecast wire-contract run "
NO_COUNTRY = "-99"
LON_RANGE = (-180.0, 180.0)
LAT_RANGE = (-90.0, 90.0)
ISO3_PATTERN = "^[A-Za-z]{3}$"
# ---------------------------------------------------------------------------


def level_column(level):
    if level not in LEVELS:
        raise ValueError(f"unknown level {level!r}; choose one of {sorted(LEVELS)}")
    return LEVELS[level]


# --- column names -----------------------------------------------------------

def stat_names(masses=MASSES, thresholds=THRESHOLDS):
    """Statistic suffixes of one collapsed variable, in published order."""
    bounds = [f"hdi{percent(m)}_{side}" for m in masses for side in ("lower", "upper")]
    return ["map", *bounds, "severe_scenario", "bimodality_flag",
            *(f"p_gt{c:g}" for c in thresholds)]


def percent(mass):
    if not 0.0 < mass < 1.0:
        raise ValueError(f"a credible mass lies in (0, 1), got {mass}")
    return round(mass * 100)


def stat_column(series, stat):
    """``<series>_<stat>`` for a published statistic; anything else is refused."""
    if stat not in stat_names() + ["actual"]:
        raise ValueError(f"{stat!r} is not a published statistic")
    return f"{series}_{stat}"


def hdi_column(series, mass, side):
    if mass not in MASSES:
        raise ValueError(f"{mass} is not a published mass {MASSES}")
    return stat_column(series, f"hdi{percent(mass)}_{side}")


def exceedance_column(series, threshold):
    return stat_column(series, f"p_gt{threshold}")


def series_columns(series, actual=True):
    """The 13 value columns of one series (12 without the observed value)."""
    stats = stat_names() + (["actual"] if actual else [])
    return [stat_column(series, s) for s in stats]


def published_columns():
    """All 45 columns of the published admin-1 table, in order."""
    columns = [MONTH, *IDENTITY]
    for series in SERIES:
        columns += series_columns(series)
    return columns


def series_of(name):
    """The one series token in a variable name."""
    hits = [s for s in SERIES if s in name.lower().split("_")]
    if len(hits) != 1:
        raise ValueError(f"{name!r} names {len(hits)} of the series {SERIES}, expected one")
    return hits[0]


def consumer_name(column):
    """``<variable>_<stat>`` becomes ``<series>_<stat>``; other columns keep their name."""
    stat = next((s for s in stat_names() if column.endswith("_" + s)), None)
    if stat is None:
        return column
    return f"{series_of(column[: -len(stat) - 1])}_{stat}"


def consumer_names(columns):
    """Old-to-new mapping for :meth:`DataFrame.withColumnsRenamed`; two columns may not meet."""
    renamed = {c: consumer_name(c) for c in columns}
    clash = sorted({n for n in renamed.values() if list(renamed.values()).count(n) > 1})
    if clash:
        raise ValueError(f"more than one variable resolves to {clash}")
    return renamed


# --- the same token rule as a column ----------------------------------------

def series_of_column(name):
    """:func:`series_of` over a column of names; NULL where no single token is found."""
    hits = F.array_intersect(F.split(F.lower(name), "_"), F.array(*map(F.lit, SERIES)))
    return F.when(F.size(hits) == 1, hits[0])


# --- types ------------------------------------------------------------------

MANIFEST_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("contract_version", T.StringType()),
    T.StructField("targets", T.ArrayType(T.StringType())),
    T.StructField("target", T.StringType()),
    T.StructField("expected_months", T.ArrayType(T.IntegerType())),
    T.StructField("expected_cell_count", T.LongType()),
    T.StructField("shards", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("time_id", T.IntegerType()),
        T.StructField("sha256", T.StringType()),
    ]))),
    T.StructField("sidecar", T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("sha256", T.StringType()),
    ])),
])
