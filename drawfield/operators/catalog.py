"""Queries over the artifact catalog: search, selection, lineage, freshness.

"Newest" is a maximum over ``(created_at, file_id)`` structs, combined map-side: a category that
holds most of the catalog costs one row per task, where a ranking window would sort it in one.
"""



from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawfield.schema import FRESHNESS_SLA_DAYS, MANIFEST_TYPE, MODEL_TYPE, SERVED_RUN_TEXT

_AGE_ORDER = ("created_at", "file_id")


# --- search ----------------------------------------------------------------------

def search(catalog, filters, name=None):
    """Equality on scalars, membership on arrays; a category query with no type asks for models."""
    wanted = dict(filters)
    if name is not None:
        wanted["name"] = name
    if "category" in wanted and "type" not in wanted:
        wanted["type"] = MODEL_TYPE
    for column, value in wanted.items():
        is_array = isinstance(catalog.schema[column].dataType, T.ArrayType)
        catalog = catalog.filter(
            F.array_contains(column, value) if is_array else F.col(column) == value)
    return catalog


def lookup(catalog, ids):
    """Catalog rows of the wanted file ids."""
    return catalog.join(ids.select("file_id"), "file_id", "left_semi")


def page(catalog, limit=25, offset=0, text=""):
    """A page of the listing, newest first, optionally of names containing ``text``."""
    listed = catalog.filter(F.col("filename").contains(text)) if text else catalog
    return listed.orderBy(F.col("created_at").desc(), F.col("file_id").desc()).offset(offset).limit(limit)


def page_after(catalog, cursor=None, limit=25, text=""):
    """The page that follows ``cursor``, the :func:`cursor_of` the page before; without one the first page.

    Each task keeps its ``limit`` newest rows below the cursor, so a late page costs what the first does and
    artifacts that arrive meanwhile move no page. Newest first, then by file id; rows without time come last.
    File ids are unique: of two rows with one id and time at the edge of a page the second would be passed over.
    """
    listed = catalog.filter(F.col("filename").contains(text)) if text else catalog
    at, file = F.col("created_at"), F.col("file_id")
    if cursor is not None:
        micros, last = cursor
        later_file = F.lit(False) if last is None else (file < last) | file.isNull()
        if micros is None:
            listed = listed.filter(at.isNull() & later_file)
        else:
            edge = F.timestamp_micros(F.lit(micros)).cast(catalog.schema["created_at"].dataType)
            listed = listed.filter((at < edge) | ((at == edge) & later_file) | at.isNull())
    return listed.orderBy(at.desc_nulls_last(), file.desc_nulls_last()).limit(limit)


def cursor_of(page):
    """``(microseconds, file id)`` of a page's last row, None for an empty page."""
    at, file = F.col("created_at"), F.col("file_id")
    # The page is bounded by its limit.
    last = page.orderBy(at.asc_nulls_first(), file.asc_nulls_first()).select(
        F.unix_micros(at.cast("timestamp")), file).first()
    return None if last is None else tuple(last)


def new_artifacts(incoming, stored):
    """Incoming artifacts whose content, and then whose filename, is not stored yet.

    Of equal contents, and then of equal names, in one batch the oldest is kept.
    """
    unseen = incoming.join(stored.select("file_hash").distinct(), "file_hash", "left_anti")
    return _first(_first(unseen, "file_hash").join(stored.select("filename").distinct(), "filename", "left_anti"),
                  "filename")


def _first(catalog, key):
    """The oldest artifact of each ``key``: by creation time, then by file id. NULL keys are all kept."""
    oldest = catalog.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*_AGE_ORDER)).alias("kept"))
    both = catalog.join(oldest, key, "left")
    return both.filter(F.col("kept").isNull() | (F.struct(*_AGE_ORDER) == F.col("kept"))).select(*catalog.columns)


# --- selection ---------------------------------------------------------------------

def newest(catalog, by):
    """The newest artifact of each group: by creation time, then by file id."""
    rest = [c for c in catalog.columns if c not in by and c not in _AGE_ORDER]
    top = F.max_by(F.struct(*_AGE_ORDER, *rest), F.struct(*_AGE_ORDER)).alias("top")
    picked = catalog.groupBy(*by).agg(top) if by else catalog.agg(top)
    return picked.select(*by, "top.*")


def without(catalog, quarantined):
    """Quarantined ids are dropped before anything is selected."""
    return catalog.join(quarantined.select("file_id"), "file_id", "left_anti")


def only(catalog, approved=None):
    """With an approval list, only its ids; without one (None) or with an empty one, everything."""
    if approved is None:
        return catalog
    ids = approved.select("file_id").distinct().withColumn("approved", F.lit(True))
    unrestricted = approved.agg(F.count("*") == 0).scalar()
    return (catalog.join(ids, "file_id", "left").filter(F.col("approved").isNotNull() | unrestricted)
            .select(*catalog.columns))


def latest_manifest(catalog, by=()):
    return newest(catalog.filter((F.col("category") == "forecast") & (F.col("type") == MANIFEST_TYPE)),
                  list(by))


def resolve(catalog, filenames, artifact_type):
    """File id of each wanted filename, the newest match winning."""
    wanted = catalog.filter((F.col("category") == "forecast") & (F.col("type") == artifact_type)).join(
        filenames.select("filename"), "filename", "left_semi")
    return newest(wanted, ["filename"]).select("filename", "file_id")


# --- lineage -------------------------------------------------------------------------

def declared_source(source, pipeline):
    return F.coalesce(F.nullif(source, F.lit("")), F.nullif(pipeline, F.lit("")), F.lit("unknown"))


def provenance(catalog, methodology):
    """The ten-field lineage record of an artifact."""
    return catalog.select(
        "file_id", declared_source(F.col("source"), F.col("pipeline")).alias("source"), "created_at",
        "filename", "name", "category", "targets", "description", "file_hash",
        F.lit(methodology).alias("methodology_version"))


def lineage(lines, served, manifest, stored):
    """The record of each line: the served run laid over its manifest, or else the stored model.

    ``served`` carries line, file_id, mode, status, source, name, filename, created_at, run_id,
    targets; the other two carry line and the ten provenance fields. A run's id is laid over the record,
    category and methodology stay those of the record below. A served wire run owns the whole
    record, so nothing of an older artifact shows through.
    """
    fields = ["file_id", "source", "created_at", "filename", "name", "category", "targets", "description", "file_hash",
              "methodology_version"]
    base = lines.select("line")
    for side, frame in (("m", manifest), ("o", stored)):
        base = base.join(frame.select("line", F.struct(*fields).alias(side)), "line", "left")
    base = base.select("line", F.coalesce("m", "o").alias("b"))
    both = base.join(served.select("line", F.struct(*[c for c in served.columns if c != "line"]).alias("s")),
                     "line", "left").filter(F.col("b").isNotNull() | F.col("s").isNotNull())
    b, s = (lambda f: F.col(f"b.{f}")), (lambda f: F.col(f"s.{f}"))
    present = F.col("s").isNotNull()
    wire = present & (s("mode") == "wire")

    def filled(value):
        return F.nullif(value, F.lit(""))

    return both.select(
        "line",
        F.when(present, s("file_id")).otherwise(b("file_id")).alias("artifact_id"),
        s("mode").alias("mode"), s("status").alias("status"),
        F.when(wire, F.coalesce(filled(s("file_id")), b("file_id"))).otherwise(b("file_id")).alias("file_id"),
        F.when(present, s("source")).otherwise(b("source")).alias("source"),
        F.coalesce(s("created_at"), b("created_at")).alias("created_at"),
        F.coalesce(s("filename"), F.when(wire, filled(s("run_id"))), b("filename")).alias("filename"),
        F.coalesce(s("name"), F.when(wire, filled(s("source"))), b("name")).alias("name"),
        s("run_id").alias("run_id"), b("category").alias("category"), b("methodology_version").alias("methodology_version"),
        F.when(wire, s("targets")).otherwise(b("targets")).alias("targets"),
        F.when(~F.coalesce(wire, F.lit(False)), b("file_hash")).alias("file_hash"),
        F.when(wire & filled(s("run_id")).isNotNull(),
               F.concat(F.lit(SERVED_RUN_TEXT), s("run_id")))
        .otherwise(b("description")).alias("description"))


# --- freshness -------------------------------------------------------------------------

def _age_seconds(created_at, as_of):
    return F.unix_micros(F.lit(as_of).cast("timestamp")) / 1e6 - F.unix_micros(created_at) / 1e6


def freshness(created_at, as_of, sla_days=FRESHNESS_SLA_DAYS):
    """``age_days`` and ``is_stale``; both NULL when the creation time is unknown."""
    age = _age_seconds(created_at, as_of) / 86400.0
    return {"age_days": F.round(age, 2), "is_stale": age > sla_days}


def staleness_hours(created_at, as_of, threshold_hours):
    age = _age_seconds(created_at, as_of) / 3600.0
    return {"age_hours": F.round(age, 2), "is_stale": age > threshold_hours}


def decide(gates):
    """First refusal wins. ``gates``: ordered ``{reason: passed column}``."""
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(r)) for r, ok in gates.items()])
    return {"decision": F.when(reason.isNull(), "Served").otherwise("Refused"), "reason": reason}


def serve_or_last_good(runs, as_of, by, sla_days=FRESHNESS_SLA_DAYS):
    """Per line: its newest run if that is served, else the newest served run still in the SLA.

    ``runs`` carries decision and reason. An unknown age is never served as a fallback.
    """
    order = F.struct("created_at", "file_id")
    row = F.struct("created_at", "file_id", "decision", "reason")
    fresh = ~freshness(F.col("created_at"), as_of, sla_days)["is_stale"]
    good = (F.col("decision") == "Served") & F.coalesce(fresh, F.lit(False))
    found = runs.groupBy(*by).agg(F.max_by(row, order).alias("newest"),
                                  F.max(F.when(good, order)).alias("good"))
    live = F.col("newest.decision") == "Served"
    return found.select(
        *by, F.col("newest.file_id").alias("newest_id"),
        F.when(live, F.col("newest.file_id")).otherwise(F.col("good.file_id")).alias("serving_id"),
        (~live).alias("degraded"), F.when(~live, F.col("newest.reason")).alias("reason"),
        F.when(live, F.lit(None).cast("boolean")).otherwise(F.col("good").isNotNull())
        .alias("fallback_available"))


def stale_snapshots(loaded, latest, by):
    """Lines whose newest artifact is not the loaded one, or that have nothing loaded."""
    return (latest.select(*by, F.col("file_id").alias("latest_id"))
            .join(loaded.select(*by, F.col("file_id").alias("loaded_id")), list(by), "left")
            .withColumn("reload", ~F.col("loaded_id").eqNullSafe(F.col("latest_id"))))


def health(created, as_of, sla_days=FRESHNESS_SLA_DAYS):
    """``degraded`` if the run is stale or a fallback is served.

    ``created`` carries served_at, manifest_at, stored_at and fallback.
    """
    at = F.coalesce("served_at", "manifest_at", "stored_at")
    stale = freshness(at, as_of, sla_days)
    bad = F.coalesce(stale["is_stale"], F.lit(False)) | F.coalesce(F.col("fallback"), F.lit(False))
    return created.withColumns({"judged_at": at, "age_days": stale["age_days"],
                                "is_stale": stale["is_stale"],
                                "status": F.when(bad, "degraded").otherwise("healthy")})


