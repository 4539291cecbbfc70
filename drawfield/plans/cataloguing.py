"""Catalog queries: search, selection, lineage, freshness."""

from pyspark.sql import functions as F

from drawfield.operators import catalog, gates, validate
from drawfield.plans.core import query, with_tables
from drawfield.schema import MANIFEST_TYPE, SHARD_TYPE
from drawfield.sources import tables

AS_OF = "2024-03-01 00:00:00"
METHOD = "1"
_STAMP = "strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') AS created_at"
_COLUMNS = ("file_id", "filename", "name", "type", "category", "source", "pipeline", "description",
            "file_hash")
_SHOWN = f"{', '.join(_COLUMNS)}, target, {_STAMP}"
_C = with_tables("c")
_AGE = "(epoch_us(TIMESTAMP '2024-03-01 00:00:00') / 1e6 - epoch_us(created_at) / 1e6)"
_GOOD = "(value >= 2.0)"


def _stamp(column="created_at"):
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at")


def _shown(frame):
    return frame.select(*_COLUMNS, F.element_at("targets", 1).alias("target"), _stamp())


@query("catalog_search", f"""{_C} SELECT {_SHOWN} FROM c
WHERE category = 'historical' AND type = '{SHARD_TYPE}' AND target = 'lr_ged_ns'""")
def catalog_search(spark, sf_dir):
    return _shown(catalog.search(tables.catalog(spark, sf_dir), {
        "category": "historical", "type": SHARD_TYPE, "targets": "lr_ged_ns"}))


@query("type_pinned_search", f"{_C} SELECT {_SHOWN} FROM c WHERE category = 'forecast' AND type = 'model' AND name = 'line_2'")
def type_pinned_search(spark, sf_dir):
    return _shown(catalog.search(tables.catalog(spark, sf_dir), {"category": "forecast"}, name="line_2"))


@query("catalog_lookup", f"""{_C} SELECT {_SHOWN} FROM c WHERE file_id IN (SELECT 'f' || p_partkey FROM part)""")
def catalog_lookup(spark, sf_dir):
    ids = tables.table(spark, sf_dir, "part").select(
        F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("file_id"))
    return _shown(catalog.lookup(tables.catalog(spark, sf_dir), ids))


@query("catalog_by_name", f"{_C} SELECT {_SHOWN} FROM c WHERE name = 'line_3'")
def catalog_by_name(spark, sf_dir):
    """Every artifact of one name, whatever its type."""
    return _shown(catalog.search(tables.catalog(spark, sf_dir), {}, name="line_3"))


@query("catalog_page", f"""{_C} SELECT {_SHOWN} FROM (SELECT * FROM c WHERE contains(filename, '_1')
ORDER BY c.created_at DESC, file_id DESC LIMIT 50 OFFSET 25)""")
def catalog_page(spark, sf_dir):
    return _shown(catalog.page(tables.catalog(spark, sf_dir), limit=50, offset=25, text="_1"))


@query("catalog_page_after", f"""{_C} SELECT {_SHOWN} FROM (SELECT * FROM c WHERE contains(filename, '_1')
ORDER BY c.created_at DESC, file_id DESC LIMIT 25 OFFSET 50)""")
def catalog_page_after(spark, sf_dir):
    """The third page, reached by the cursors of the first two."""
    listed, cursor = tables.catalog(spark, sf_dir), None
    for _ in range(2):
        cursor = catalog.cursor_of(catalog.page_after(listed, cursor, limit=25, text="_1"))
    return _shown(catalog.page_after(listed, cursor, limit=25, text="_1"))


@query("dedup_by_hash", f"""{_C}, stored AS (SELECT * FROM c WHERE value < 0.1), incoming AS (SELECT * FROM c WHERE value >= 0.1)
, unseen AS (SELECT * FROM incoming WHERE file_hash NOT IN (SELECT file_hash FROM stored)),
by_hash AS (SELECT * FROM unseen QUALIFY file_hash IS NULL OR row_number() OVER (PARTITION BY file_hash ORDER BY created_at, file_id) = 1),
fresh AS (SELECT * FROM by_hash WHERE filename NOT IN (SELECT filename FROM stored))
SELECT {_SHOWN} FROM fresh QUALIFY filename IS NULL OR row_number() OVER (PARTITION BY filename ORDER BY created_at, file_id) = 1""")
def dedup_by_hash(spark, sf_dir):
    """Artifacts of the smallest values are stored already, all others arrive."""
    every = tables.catalog(spark, sf_dir)
    stored = every.filter(F.col("value") < 0.1)
    return _shown(catalog.new_artifacts(every.filter(F.col("value") >= 0.1), stored))


@query("catalog_validation", f"""{_C}
SELECT * FROM (SELECT unnest(['file_id_required', 'filename_required', 'name_required', 'type_required',
    'targets_required', 'category_allowed', 'source_known', 'hash_length']) AS rule,
  unnest([0, (SELECT count(*) FROM c WHERE user_id % 9 = 4), 0, (SELECT count(*) FROM c WHERE event_id % 13 = 6),
    (SELECT count(*) FROM c WHERE event_id % 10 = 9), (SELECT count(*) FROM c WHERE event_id % 8 = 1),
    (SELECT count(*) FROM c WHERE source IS NULL AND pipeline IS NULL), (SELECT count(*) FROM c WHERE event_id % 12 = 5)]) AS violations)""")
def catalog_validation(spark, sf_dir):
    event = F.col("event_id")
    damaged = tables.catalog(spark, sf_dir).withColumns({
        "filename": F.when(F.col("user_id") % 9 != 4, F.col("filename")),
        "type": F.when(event % 13 != 6, F.col("type")),
        "targets": F.when(event % 10 == 9, F.array().cast("array<string>")).otherwise(F.col("targets")),
        "category": F.when(event % 8 == 1, F.lit("other")).otherwise(F.col("category")),
        "file_hash": F.when(event % 12 == 5, F.substring("file_hash", 1, 40)).otherwise(F.col("file_hash"))})
    return validate.catalog_validation(damaged)


# --- selection ----------------------------------------------------------------------------

def _newest_sql(where, by):
    keys = ", ".join(by)
    return f"""{_C} SELECT {_SHOWN} FROM (SELECT *, row_number() OVER (PARTITION BY {keys}
  ORDER BY c.created_at DESC, file_id DESC) AS rn FROM c WHERE {where}) WHERE rn = 1"""


@query("latest_artifact", _newest_sql("true", ["category", "type"]))
def latest_artifact(spark, sf_dir):
    return _shown(catalog.newest(tables.catalog(spark, sf_dir), ["category", "type"]))


@query("latest_not_quarantined", _newest_sql(_GOOD, ["category", "name"]))
def latest_not_quarantined(spark, sf_dir):
    left = catalog.without(tables.catalog(spark, sf_dir), tables.quarantined(spark, sf_dir))
    return _shown(catalog.newest(left, ["category", "name"]))


@query("latest_approved", _newest_sql(f"{_GOOD} AND value < 20.0", ["category", "name"]))
def latest_approved(spark, sf_dir):
    left = catalog.without(tables.catalog(spark, sf_dir), tables.quarantined(spark, sf_dir))
    return _shown(catalog.newest(catalog.only(left, tables.approved(spark, sf_dir)), ["category", "name"]))


@query("latest_manifest", _newest_sql(f"category = 'forecast' AND type = '{MANIFEST_TYPE}'", ["name"]))
def latest_manifest(spark, sf_dir):
    return _shown(catalog.latest_manifest(tables.catalog(spark, sf_dir), ["name"]))


@query("resolve_artifacts", f"""{_C} SELECT filename, file_id FROM (
  SELECT *, row_number() OVER (PARTITION BY filename ORDER BY created_at DESC, file_id DESC) AS rn FROM c
  WHERE category = 'forecast' AND type = '{SHARD_TYPE}'
    AND filename IN (SELECT 'run_' || s_suppkey || '.parquet' FROM supplier)) WHERE rn = 1""")
def resolve_artifacts(spark, sf_dir):
    names = tables.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("run_"), F.col("s_suppkey").cast("string"), F.lit(".parquet")).alias("filename"))
    return catalog.resolve(tables.catalog(spark, sf_dir), names, SHARD_TYPE)


_DECISION = f"""CASE WHEN value < 2.0 THEN 'quarantined'
  WHEN NOT (event_id % 6 IN (0, 1, 4)) THEN 'schema_capability_mismatch'
  WHEN coalesce(nullif(source, ''), nullif(pipeline, ''), 'unknown') = 'unknown' THEN 'unidentifiable'
  WHEN {_AGE} / 86400e0 > 45 THEN 'stale' END"""


def _decided(spark, sf_dir):
    every = tables.catalog(spark, sf_dir)
    source = catalog.declared_source(F.col("source"), F.col("pipeline"))
    withdrawn = tables.quarantined(spark, sf_dir).withColumn("withdrawn", F.lit(True))
    return every.join(withdrawn, "file_id", "left").withColumns(catalog.decide({
        "quarantined": F.col("withdrawn").isNull(),
        "schema_capability_mismatch": gates.can_render(F.col("contract_version")),
        "unidentifiable": source != "unknown",
        "stale": ~catalog.freshness(F.col("created_at"), AS_OF)["is_stale"]}))


@query("selection_decision", f"""{_C} SELECT file_id, CASE WHEN reason IS NULL THEN 'Served' ELSE 'Refused' END AS decision, reason
FROM (SELECT file_id, {_DECISION} AS reason FROM c)""")
def selection_decision(spark, sf_dir):
    return _decided(spark, sf_dir).select("file_id", "decision", "reason")


@query("serve_or_last_good", f"""{_C}, r AS (SELECT *, {_DECISION} AS reason, {_AGE} / 86400e0 <= 45 AS fresh FROM c),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY created_at DESC, file_id DESC) AS rn FROM r) WHERE rn = 1),
good AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY created_at DESC, file_id DESC) AS rn FROM r
         WHERE reason IS NULL AND fresh) WHERE rn = 1)
SELECT n.filename, n.file_id AS newest_id, CASE WHEN n.reason IS NULL THEN n.file_id ELSE g.file_id END AS serving_id,
  n.reason IS NOT NULL AS degraded, n.reason AS reason,
  CASE WHEN n.reason IS NOT NULL THEN g.file_id IS NOT NULL END AS fallback_available
FROM newest n LEFT JOIN good g USING (filename)""")
def serve_or_last_good(spark, sf_dir):
    return catalog.serve_or_last_good(_decided(spark, sf_dir), AS_OF, ["filename"])


@query("stale_snapshots", f"""{_C},
latest AS (SELECT filename, arg_max(file_id, (created_at, file_id)) AS latest_id FROM c GROUP BY 1),
loaded AS (SELECT filename, arg_max(file_id, (created_at, file_id)) AS loaded_id FROM c
           WHERE created_at < TIMESTAMP '2024-01-29 12:00:00' GROUP BY 1)
SELECT filename, latest_id, loaded_id, loaded_id IS DISTINCT FROM latest_id AS reload
FROM latest LEFT JOIN loaded USING (filename)""")
def stale_snapshots(spark, sf_dir):
    every = tables.catalog(spark, sf_dir)
    before = every.filter(F.col("created_at") < F.lit("2024-01-29 12:00:00").cast("timestamp"))
    by = ["filename"]
    return catalog.stale_snapshots(catalog.newest(before, by), catalog.newest(every, by), by)


# --- lineage and freshness ----------------------------------------------------------------

@query("provenance", f"""{_C} SELECT file_id, coalesce(source, pipeline, 'unknown') AS source, {_STAMP}, filename, name,
  category, target, description, file_hash, '{METHOD}' AS methodology_version FROM c""")
def provenance(spark, sf_dir):
    record = catalog.provenance(tables.catalog(spark, sf_dir), METHOD)
    return record.select(*[c for c in record.columns if c not in ("created_at", "targets")],
                         _stamp(), F.element_at("targets", 1).alias("target"))


_LINE = "user_id"


def _sides(spark, sf_dir):
    every = tables.catalog(spark, sf_dir).withColumn("line", F.col("user_id"))
    record = every.withColumn("source", catalog.declared_source(F.col("source"), F.col("pipeline")))
    record = record.withColumn("methodology_version", F.concat(F.lit(METHOD + " "), "type"))
    manifest = catalog.newest(record.filter(F.col("type") == MANIFEST_TYPE), ["line"])
    stored = catalog.newest(record.filter(F.col("type") == "model"), ["line"])
    shard = catalog.newest(record.filter(F.col("type") == SHARD_TYPE), ["line"])
    served = shard.select(
        "line", "file_id",
        F.when(F.col("line") % 3 == 0, F.lit("legacy")).otherwise(F.lit("wire")).alias("mode"),
        F.lit("final").alias("status"), "source",
        F.when(F.col("line") % 2 == 0, F.col("name")).alias("name"),
        F.when(F.col("line") % 4 == 0, F.col("filename")).alias("filename"), "created_at",
        F.when(F.col("line") % 5 != 0, F.concat(F.lit("r"), F.col("line").cast("string"))).alias("run_id"),
        "targets")
    return every.select("line").distinct(), served, manifest, stored


def _side_sql(kind):
    return f"""(SELECT user_id AS line, struct_pack(file_id := file_id, source := coalesce(source, pipeline, 'unknown'),
    created_at := created_at, filename := filename, name := name, category := category, target := target, description := description,
    methodology_version := '{METHOD} ' || type,
    file_hash := file_hash) AS x FROM (SELECT *, row_number() OVER (PARTITION BY user_id
      ORDER BY created_at DESC, file_id DESC) AS rn FROM c WHERE type = '{kind}') WHERE rn = 1)"""


@query("lineage_merge", f"""{_C}, lines AS (SELECT DISTINCT user_id AS line FROM c),
sv AS (SELECT line, x.file_id AS file_id, CASE WHEN line % 3 = 0 THEN 'legacy' ELSE 'wire' END AS mode, 'final' AS status,
   x.source AS source, CASE WHEN line % 2 = 0 THEN x.name END AS name, CASE WHEN line % 4 = 0 THEN x.filename END AS filename,
   x.created_at AS created_at, CASE WHEN line % 5 <> 0 THEN 'r' || line END AS run_id, x.target AS target
   FROM {_side_sql(SHARD_TYPE)}),
b AS (SELECT line, coalesce(m.x, o.x) AS x FROM lines LEFT JOIN {_side_sql(MANIFEST_TYPE)} m USING (line)
      LEFT JOIN {_side_sql('model')} o USING (line))
SELECT line, CASE WHEN s.mode IS NOT NULL THEN s.file_id ELSE x.file_id END AS artifact_id, s.mode AS mode, s.status AS status,
  CASE WHEN s.mode = 'wire' THEN s.file_id ELSE x.file_id END AS file_id,
  CASE WHEN s.mode IS NOT NULL THEN s.source ELSE x.source END AS source,
  strftime(coalesce(s.created_at, x.created_at), '%Y-%m-%dT%H:%M:%S.%f') AS created_at,
  coalesce(s.filename, CASE WHEN s.mode = 'wire' THEN s.run_id END, x.filename) AS filename,
  coalesce(s.name, CASE WHEN s.mode = 'wire' THEN s.source END, x.name) AS name,
  s.run_id AS run_id, x.category AS category, x.methodology_version AS methodology_version,
  CASE WHEN s.mode = 'wire' THEN s.target ELSE x.target END AS target,
  CASE WHEN s.mode IS NULL OR s.mode <> 'wire' THEN x.file_hash END AS file_hash,
  CASE WHEN s.mode = 'wire' AND s.run_id IS NOT NULL THEN 'Sampled-forecast wire-contract run ' || s.run_id
       ELSE x.description END AS description
FROM b LEFT JOIN sv s USING (line) WHERE x IS NOT NULL OR s.mode IS NOT NULL""")
def lineage_merge(spark, sf_dir):
    record = catalog.lineage(*_sides(spark, sf_dir))
    return record.select(*[c for c in record.columns if c not in ("created_at", "targets")],
                         _stamp(), F.element_at("targets", 1).alias("target"))


@query("freshness", f"""{_C} SELECT file_id, CASE WHEN event_id % 9 = 2 THEN NULL ELSE round({_AGE} / 86400e0, 2) END AS age_days,
  CASE WHEN event_id % 9 = 2 THEN NULL ELSE {_AGE} / 86400e0 > 45 END AS is_stale FROM c""")
def freshness(spark, sf_dir):
    at = F.when(F.col("event_id") % 9 != 2, F.col("created_at"))
    verdict = catalog.freshness(at, AS_OF)
    return tables.catalog(spark, sf_dir).select("file_id", *[v.alias(n) for n, v in verdict.items()])


@query("staleness_hours", f"""{_C} SELECT file_id, round({_AGE} / 3600e0, 2) AS age_hours,
  {_AGE} / 3600e0 > 1000 AS is_stale FROM c""")
def staleness_hours(spark, sf_dir):
    verdict = catalog.staleness_hours(F.col("created_at"), AS_OF, 1000)
    return tables.catalog(spark, sf_dir).select("file_id", *[v.alias(n) for n, v in verdict.items()])


@query("health_status", f"""{_C}, t AS (SELECT user_id,
    max(created_at) FILTER (type = '{SHARD_TYPE}' AND user_id % 2 = 0) AS served_at,
    max(created_at) FILTER (type = '{MANIFEST_TYPE}' AND user_id % 3 <> 0) AS manifest_at,
    max(created_at) FILTER (type = 'model') AS stored_at, user_id % 10 = 7 AS fallback FROM c GROUP BY user_id),
j AS (SELECT user_id, fallback, coalesce(served_at, manifest_at, stored_at) AS created_at FROM t)
SELECT user_id, fallback, {_STAMP}, round({_AGE} / 86400e0, 2) AS age_days, {_AGE} / 86400e0 > 35 AS is_stale,
  CASE WHEN coalesce({_AGE} / 86400e0 > 35, false) OR fallback THEN 'degraded' ELSE 'healthy' END AS status FROM j"""
       .replace(f"fallback, {_STAMP}, round", "fallback, strftime(j.created_at, '%Y-%m-%dT%H:%M:%S.%f') AS judged_at, round"))
def health_status(spark, sf_dir):
    kind, user, at = F.col("type"), F.col("user_id"), F.col("created_at")
    created = tables.catalog(spark, sf_dir).groupBy("user_id").agg(
        F.max(F.when((kind == SHARD_TYPE) & (user % 2 == 0), at)).alias("served_at"),
        F.max(F.when((kind == MANIFEST_TYPE) & (user % 3 != 0), at)).alias("manifest_at"),
        F.max(F.when(kind == "model", at)).alias("stored_at")).withColumn("fallback", user % 10 == 7)
    status = catalog.health(created, AS_OF, sla_days=35.0)
    return status.select("user_id", "fallback", F.date_format("judged_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
                         .alias("judged_at"), "age_days", "is_stale", "status")
