"""The published table, its parts, and writing and reading files."""

from pyspark.sql import functions as F

from drawfield.operators import grid, publish
from drawfield.plans.core import (TARGETS_SQL, joint_sum_sql, ladder_sql, pivot_sql, query, text_of,
                                  unit_rows, vectors_as_text, with_tables)
from drawfield.schema import (CELL, IDENTITY, MONTH, SERIES, consumer_names,
                              published_columns, series_of_column, stat_names)
from drawfield.session import shared_dir
from drawfield.sources import digests, readers, tables, writers
from drawfield.sources.tables import DRAWS, OBSERVED, TARGETS

_SERIES_STEM = dict(zip(TARGETS_SQL, SERIES))
_BULK = f"""{with_tables('g', 'geo', 'h')}, {unit_rows('admin1_gaul1_code')}, {joint_sum_sql()},
{ladder_sql('summed', 'month_id, unit, target')},
p AS ({pivot_sql('stats', 'month_id, unit', stem=_SERIES_STEM.get)}),
ident AS (SELECT DISTINCT {', '.join(f'{source} AS {name}' for name, source in IDENTITY.items())}
          FROM geo WHERE admin1_gaul1_code IS NOT NULL),
actuals AS (SELECT month_id, admin1_gaul1_code AS admin1_code,
            {', '.join(f'sum(lr_ged_{s}) AS {s}_actual' for s in SERIES)}
            FROM h JOIN geo USING (priogrid_id) GROUP BY 1, 2),
bulk AS (SELECT {', '.join(published_columns())}
  FROM (SELECT * EXCLUDE (unit), unit AS admin1_code FROM p)
  LEFT JOIN ident USING (admin1_code) LEFT JOIN actuals USING (month_id, admin1_code))"""


def _bulk(spark, sf_dir):
    return publish.bulk_table(tables.posterior(spark, sf_dir), tables.geography(spark, sf_dir), TARGETS,
                              tables.observed(spark, sf_dir), OBSERVED, width=DRAWS)


query("bulk_table", f"{_BULK} SELECT * FROM bulk")(_bulk)


@query("bulk_without_history", f"""{_BULK}
SELECT * REPLACE ({', '.join(f'CAST(NULL AS DOUBLE) AS {s}_actual' for s in SERIES)}) FROM bulk""")
def bulk_without_history(spark, sf_dir):
    return publish.bulk_table(tables.posterior(spark, sf_dir), tables.geography(spark, sf_dir), TARGETS,
                              width=DRAWS)


@query("bulk_roundtrip", f"{_BULK} SELECT * FROM bulk")
def bulk_roundtrip(spark, sf_dir):
    path = writers.write_bulk(_bulk(spark, sf_dir), shared_dir(spark, "bulk"))
    return spark.read.parquet(path)


@query("identity_table", f"""{with_tables('geo', 'geo_u')}
SELECT DISTINCT {', '.join(f'{source} AS {name}' for name, source in IDENTITY.items())}
FROM geo WHERE admin1_gaul1_code IS NOT NULL""")
def identity_table(spark, sf_dir):
    return publish.identity_table(tables.geography(spark, sf_dir, unmapped=False))


@query("hierarchy_conflicts", f"""{with_tables('geo')},
d AS (SELECT * REPLACE (CASE WHEN priogrid_id = 0 THEN 'ZZZ' ELSE country_iso_a3 END AS country_iso_a3) FROM geo)
SELECT admin1_code, count(*) AS identities FROM (
  SELECT DISTINCT {', '.join(f'{source} AS {name}' for name, source in IDENTITY.items())} FROM d)
GROUP BY 1 HAVING count(*) > 1""")
def hierarchy_conflicts(spark, sf_dir):
    return publish.hierarchy_conflicts(tables.geography(spark, sf_dir, conflict=True))


@query("actuals_admin1", f"""{with_tables('h', 'geo')}
SELECT month_id, admin1_gaul1_code AS admin1_code, {', '.join(f'sum(lr_ged_{s}) AS {s}_actual' for s in SERIES)}
FROM h JOIN geo USING (priogrid_id) GROUP BY 1, 2""")
def actuals_admin1(spark, sf_dir):
    return publish.actuals_admin1(tables.observed(spark, sf_dir), tables.geography(spark, sf_dir), OBSERVED)


@query("series_of", """
SELECT p_partkey, v AS variable, CASE WHEN list_sum(list_transform(['sb', 'ns', 'os'],
    lambda t: CAST(list_contains(string_split(lower(v), '_'), t) AS INTEGER))) = 1
  THEN list_filter(['sb', 'ns', 'os'], lambda t: list_contains(string_split(lower(v), '_'), t))[1] END AS series
FROM (SELECT p_partkey, ['pred_lr_ged_', 'pred_LN_', 'lr_', 'x'][p_partkey % 4 + 1]
        || ['sb', 'ns_best', 'OS', 'sb_os', 'gw'][p_size % 5 + 1] AS v FROM part)""")
def series_of(spark, sf_dir):
    part = tables.table(spark, sf_dir, "part")
    stem = F.element_at(F.array(*map(F.lit, ("pred_lr_ged_", "pred_LN_", "lr_", "x"))),
                        (F.col("p_partkey") % 4 + 1).cast("int"))
    ending = F.element_at(F.array(*map(F.lit, ("sb", "ns_best", "OS", "sb_os", "gw"))),
                          (F.col("p_size") % 5 + 1).cast("int"))
    named = part.select("p_partkey", F.concat(stem, ending).alias("variable"))
    return named.withColumn("series", series_of_column(F.col("variable")))


@query("consumer_names", f"""{_BULK} SELECT month_id, admin1_code AS unit,
{', '.join(f'{s}_{q}' for s in SERIES for q in stat_names())} FROM bulk""")
def consumer_names_(spark, sf_dir):
    from drawfield.operators.summarize import summarize_level
    summary = summarize_level(tables.posterior(spark, sf_dir), tables.geography(spark, sf_dir), "gaul1",
                              TARGETS, with_geo=False, width=DRAWS)
    return summary.withColumnsRenamed(consumer_names(summary.columns))


@query("json_clean", """
SELECT vec_id, CASE WHEN vec_id % 7 = 0 OR vec_id % 11 = 0 THEN NULL ELSE v END AS value,
       CASE WHEN vec_id % 5 = 0 THEN NULL ELSE v END AS single,
       CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END AS nulls_in_vector
FROM (SELECT vec_id, CAST(label AS DOUBLE) AS v FROM embeddings)""")
def json_clean(spark, sf_dir):
    label, vec = F.col("label").cast("double"), F.col("vec_id")
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    raw = tables.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(vec % 7 == 0, nan).when(vec % 11 == 0, -inf).otherwise(label).alias("value"),
        F.array(F.when(vec % 5 == 0, inf).otherwise(label)).alias("single"),
        F.array(label, F.when(vec % 3 == 0, nan).otherwise(label)).alias("vector"))
    cleaned = publish.unwrap_single(publish.json_clean(raw), ["single"])
    missing = F.size(F.filter("vector", lambda x: x.isNull()))
    return cleaned.select("vec_id", "value", "single", missing.alias("nulls_in_vector"))


@query("json_rows", """
SELECT p_partkey, '{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '","p_size":'
       || CASE WHEN p_partkey % 7 = 0 THEN 'null' ELSE CAST(p_size AS VARCHAR) END || '}' AS json
FROM part""")
def json_rows(spark, sf_dir):
    part = tables.table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")).alias("p_size"))
    rows = publish.json_rows(part)
    return rows.select(F.get_json_object("json", "$.p_partkey").cast("long").alias("p_partkey"), "json")


# --- files ------------------------------------------------------------------------------

@query("scan_samples", f"""{with_tables('g')}
SELECT month_id, priogrid_id, {text_of('pred_lr_ged_sb')}, {text_of('pred_lr_ged_os')} FROM g""")
def scan_samples(spark, sf_dir):
    path = shared_dir(spark, "samples")
    doubles = tables.posterior(spark, sf_dir).select(
        MONTH, CELL, *[F.col(t).cast("array<double>").alias(t) for t in TARGETS])
    doubles.write.parquet(path)
    return vectors_as_text(readers.scan_samples(spark, path, [TARGETS[0], TARGETS[2]]))


@query("scan_observed", f"{with_tables('h')} SELECT month_id, priogrid_id, lr_ged_sb FROM h")
def scan_observed(spark, sf_dir):
    path = shared_dir(spark, "observed")
    tables.observed(spark, sf_dir).write.parquet(path)
    return readers.scan_observed(spark, path, ["lr_ged_sb"])


@query("scan_geo", f"{with_tables('geo', 'geo_u')} SELECT * FROM geo_u")
def scan_geo(spark, sf_dir):
    path = shared_dir(spark, "geo")
    tables.geography(spark, sf_dir, unmapped=True, sentinel=True).write.parquet(path)
    return readers.scan_geography(spark, path)


@query("read_formats", f"""{with_tables('h')}
SELECT f.format, count(*) AS rows, sum(month_id) AS months, sum(priogrid_id) AS cells,
       sum(lr_ged_sb) AS sb, sum(lr_ged_os) AS os
FROM h CROSS JOIN (SELECT unnest(['csv', 'json', 'parquet']) AS format) f GROUP BY 1"""
       .replace("sum(month_id)", "CAST(sum(month_id) AS BIGINT)")
       .replace("sum(priogrid_id)", "CAST(sum(priogrid_id) AS BIGINT)"))
def read_formats(spark, sf_dir):
    """The observed table written as CSV, JSON and parquet, and read back by one function."""
    history = tables.observed(spark, sf_dir)
    base, found = shared_dir(spark, "formats"), None
    for kind in ("csv", "json", "parquet"):
        path = f"{base}/history.{kind}"
        writer = history.write.option("header", True) if kind == "csv" else history.write
        writer.format(kind).save(path)
        back = readers.read_any(spark, path, schema=history.schema).withColumn("format", F.lit(kind))
        found = back if found is None else found.unionByName(back)
    return found.groupBy("format").agg(
        F.count("*").alias("rows"), F.sum(MONTH).alias("months"), F.sum(CELL).alias("cells"),
        F.sum("lr_ged_sb").alias("sb"), F.sum("lr_ged_os").alias("os"))


@query("value_roundtrip", f"""{with_tables('g', 'geo')}
SELECT month_id, priogrid_id, {', '.join(text_of(t) for t in TARGETS_SQL)}, country_iso_a3
FROM g LEFT JOIN geo USING (priogrid_id)""")
def value_roundtrip(spark, sf_dir):
    path = writers.save_dataset(tables.posterior(spark, sf_dir), tables.geography(spark, sf_dir),
                                shared_dir(spark, "dataset"))
    rows, geo = writers.load_dataset(spark, path)
    return vectors_as_text(rows.join(geo.select(CELL, "country_iso_a3"), CELL, "left")
                           .select(MONTH, CELL, *TARGETS, "country_iso_a3"))


@query("published_runs", f"""{with_tables('g')}
SELECT month_id, count(*) AS cells FROM g GROUP BY 1""")
def published_runs(spark, sf_dir):
    """A run published twice over is there once, and only a listed run can be read."""
    base = shared_dir(spark, "publish")
    frame = tables.posterior(spark, sf_dir)
    writers.publish_run(frame, "run_0", base)
    writers.publish_run(frame, "run_0", base)
    return writers.read_published(spark, base, "run_0").groupBy(MONTH).agg(F.count("*").alias("cells"))



_SHARD_SQL = """'run_' || l_orderkey || '__lr_ged_' || lower(l_returnflag) || '__' || l_linenumber || '_' || l_partkey"""


@query("manifest_shards", f"""
SELECT 'run_' || l_orderkey AS run_id, {_SHARD_SQL} AS shard, 'lr_ged_' || lower(l_returnflag) AS target,
       CAST((year(l_shipdate) - 1980) * 12 + month(l_shipdate) AS INTEGER) AS month_id,
       sha256({_SHARD_SQL}) AS sha256 FROM lineitem""")
def manifest_shards(spark, sf_dir):
    """One manifest per order, written as JSON and parsed; its lines are the shards it lists."""
    from drawfield.functions.calendar import month_id_of_date
    from drawfield.operators.gates import manifest_shards as unfold
    run = F.concat(F.lit("run_"), F.col("l_orderkey").cast("string"))

    def shard(line):
        target = F.concat(F.lit("lr_ged_"), F.lower(line["flag"]))
        name = F.concat("run_id", F.lit("__"), target, F.lit("__"), line["number"].cast("string"), F.lit("_"), line["part"].cast("string"))
        return F.struct(name.alias("name"), target.alias("target"), line["month"].alias("time_id"), F.sha2(name, 256).alias("sha256"))

    path = shared_dir(spark, "manifest")
    # An order has a handful of lines, so its list of shards is short. Only what names are made of is shuffled.
    lines = tables.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(
        F.col("l_linenumber").alias("number"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"),
        month_id_of_date(F.col("l_shipdate")).alias("month"))).alias("lines"))
    lines.select(run.alias("run_id"), "lines").select(
        "run_id", F.lit("1.5").alias("contract_version"), F.transform("lines", shard).alias("shards")
    ).write.option("compression", "gzip").json(path)
    return unfold(spark.read.schema(readers.MANIFEST_SCHEMA).json(path))


_LINE = "s_suppkey || '|' || s_name || '|' || s_nationkey || '|' || {half} || chr(10)"


@query("content_hash", f"""
WITH halves AS (SELECT s_suppkey, unnest([0, 1]) AS half, s_name, s_nationkey FROM supplier),
files AS (SELECT 'run_' || (s_suppkey % 7) AS run_id, 's' || s_suppkey || '_' || half || '.txt' AS name, s_suppkey, half,
  sha256(repeat({_LINE.format(half='half')}, CAST(CASE WHEN half = 1 THEN 1 + s_suppkey % 50 ELSE 1 END AS INTEGER))) AS actual FROM halves)
SELECT run_id, name, CASE WHEN s_suppkey % 5 = 4 AND half = 1 THEN 'missing' WHEN s_suppkey % 5 = 2 THEN 'unverified'
    WHEN s_suppkey % 5 = 1 THEN 'mismatch' ELSE 'verified' END AS state,
  CASE WHEN NOT (s_suppkey % 5 = 4 AND half = 1) THEN actual END AS actual FROM files""")
def content_hash(spark, sf_dir):
    """Two files a supplier, the larger one read in pieces, against what seven manifests declare: right, wrong, without hash, not delivered.

    SQL computes the hashes from the table; the query reads them from the files.
    """
    half = F.explode(F.array(F.lit(0), F.lit(1))).alias("half")
    files = tables.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", half).withColumn(
        "name", F.format_string("s%d_%d", F.col("s_suppkey").cast("long"), F.col("half"))).withColumn(
        "line", F.concat_ws("|", F.col("s_suppkey").cast("string"), "s_name", F.col("s_nationkey").cast("string"), F.col("half").cast("string")))
    times = F.when(F.col("half") == 1, 1 + F.col("s_suppkey") % 50).otherwise(1).cast("int")
    path, kind = shared_dir(spark, "hashed"), F.col("s_suppkey") % 5
    run = F.concat(F.lit("run_"), (F.col("s_suppkey") % 7).cast("string"))
    content = F.concat(F.array_join(F.array_repeat("line", times), "\n"), F.lit("\n"))
    digests.write_files(files.filter(~((kind == 4) & (F.col("half") == 1))).select(
        run.alias("directory"), F.concat("name", F.lit(".txt")).alias("name"), content.alias("content")), path)
    found = digests.file_digests(spark, path, whole=200, piece=64).select(F.col("directory").alias("run_id"), "name", "actual")
    entry = F.struct(F.concat("name", F.lit(".txt")).alias("name"), F.lit("t").alias("target"), F.lit(1).alias("time_id"),
                     F.when(kind == 1, F.sha2(F.concat(content, F.lit("x")), 256)).when(kind == 2, F.lit(None))
                     .when(kind == 3, F.upper(F.sha2(content, 256))).otherwise(F.sha2(content, 256)).alias("sha256"))
    # A manifest lists two sevenths as many files here as there are suppliers.
    manifest = files.groupBy(run.alias("run_id")).agg(
        F.collect_list(entry).alias("shards")).withColumn("sidecar", F.lit(None).cast("struct<name:string,sha256:string>"))
    return digests.artifact_states(manifest, found)


@query("integrity_roundtrip", """
SELECT t AS target, count(*) AS rows, CAST(0 AS BIGINT) AS differing
FROM embeddings, (SELECT unnest(['pred_lr_ged_sb', 'pred_lr_ged_ns', 'pred_lr_ged_os']) AS t) GROUP BY 1""")
def integrity_roundtrip(spark, sf_dir):
    return grid.integrity_roundtrip(tables.posterior(spark, sf_dir), TARGETS)


