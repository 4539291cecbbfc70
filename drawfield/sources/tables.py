"""The library's input shapes, derived by Spark from the star-schema test tables.

``posterior``  month_id, priogrid_id, pred_lr_ged_{sb,ns,os} ARRAY<FLOAT>   from embeddings
``geography``  priogrid_id and the nine geography columns                  from embeddings, nation, region
``observed``   month_id, priogrid_id, lr_ged_{sb,ns,os} DOUBLE             from lineitem
``wire_runs``  delivered runs in long form, good and damaged               from embeddings
``catalog``    one row per stored artifact                                 from events
"""

from pyspark.sql import functions as F

from drawfield.functions.calendar import month_id_of_date
from drawfield.operators.gates import Run
from drawfield.schema import CELL, MONTH, SERIES

TARGETS = tuple(f"pred_lr_ged_{s}" for s in SERIES)
OBSERVED = tuple(f"lr_ged_{s}" for s in SERIES)
MONTHS = (258, 259, 260, 261, 262)
DRAWS = 64


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- posterior draws and their geography -------------------------------------

def _scaled(change):
    return F.transform("embedding", lambda x: F.floor(change(x.cast("double"))).cast("float"))


def posterior(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        (F.lit(258) + F.col("vec_id") % 5).cast("int").alias(MONTH),
        F.floor(F.col("vec_id") / 5).alias(CELL),
        _scaled(lambda x: F.greatest(x, F.lit(0.0)) * 200).alias(TARGETS[0]),
        _scaled(lambda x: F.greatest(-x, F.lit(0.0)) * 200).alias(TARGETS[1]),
        _scaled(lambda x: F.abs(x) * 4000).alias(TARGETS[2]),
    )


def posterior_with_gaps(spark, sf_dir):
    """The sb draws with some draws, and some whole vectors, set to NaN."""
    nan = F.lit(float("nan")).cast("float")
    vec = F.col(CELL) * 5 + F.col(MONTH) - 258
    draws = F.transform(TARGETS[0], lambda x, i: F.when(
        (vec % 89 == 0) | ((vec % 97 == 0) & (i == 3)), nan).otherwise(x))
    return posterior(spark, sf_dir).select(MONTH, CELL, draws.alias(TARGETS[0]))


def posterior_with_negatives(spark, sf_dir):
    """Every 53rd vector has its first os draw turned negative, every 59th its second to infinity."""
    vec = F.col(CELL) * 5 + F.col(MONTH) - 258
    draws = F.transform(TARGETS[2], lambda x, i: F.when((vec % 53 == 0) & (i == 0), (-x - 1).cast("float"))
                        .when((vec % 59 == 0) & (i == 1), F.lit(float("inf")).cast("float"))
                        .otherwise(x))
    return posterior(spark, sf_dir).withColumn(TARGETS[2], draws)


def geography(spark, sf_dir, unmapped=False, sentinel=False, conflict=False, damaged=False):
    """One row per cell of the posterior grid; the flags add the irregular rows."""
    cells = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 5).alias(CELL)).distinct()
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("admin1_gaul1_code"),
        F.col("n_name").alias("admin1_gaul1_name"),
        F.col("n_regionkey").alias("r_regionkey"))
    regions = table(spark, sf_dir, "region").select(
        "r_regionkey", F.col("r_name").alias("admin1_gaul0_name"))
    gaul2 = F.col(CELL) % 50
    iso = F.element_at(F.array(*map(F.lit, ("AAA", "BBB", "CCC", "DDD", "EEE"))),
                       F.col("r_regionkey") + 1)
    if sentinel:
        iso = F.when(F.col(CELL) % 40 == 38, F.lit("-99")).otherwise(iso)
    if conflict:
        iso = F.when(F.col(CELL) == 0, F.lit("ZZZ")).otherwise(iso)
    if damaged:
        iso = F.when(F.col(CELL) % 30 == 7, F.lit("A1")).otherwise(iso)
    x = -179.75 + 0.5 * (F.col(CELL) % 720)
    geo = (cells.withColumn("admin1_gaul1_code", gaul2 % 25)
           .join(nations, "admin1_gaul1_code").join(regions, "r_regionkey")
           .select(
               CELL,
               (F.when(F.col(CELL) % 30 == 11, F.lit(200.0)).otherwise(x) if damaged else x)
               .alias("pg_xcoord"),
               (-89.75 + 0.5 * F.floor(F.col(CELL) / 720)).alias("pg_ycoord"),
               iso.alias("country_iso_a3"),
               "admin1_gaul1_code", "admin1_gaul1_name",
               F.col("r_regionkey").cast("long").alias("admin1_gaul0_code"), "admin1_gaul0_name",
               gaul2.alias("admin2_gaul2_code"),
               F.concat(F.lit("D"), gaul2.cast("string")).alias("admin2_gaul2_name")))
    if unmapped:
        mapped = F.col(CELL) % 40 != 39
        geo = geo.select(CELL, "pg_xcoord", "pg_ycoord", *[
            F.when(mapped, F.col(c)).alias(c) for c in geo.columns[3:]])
    return geo


# --- observed history --------------------------------------------------------

def observed(spark, sf_dir):
    def of(flag):
        return F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")).otherwise(0.0))

    return (table(spark, sf_dir, "lineitem")
            .groupBy(month_id_of_date(F.col("l_shipdate")).alias(MONTH),
                     F.col("l_suppkey").alias(CELL))
            .agg(of("A").alias(OBSERVED[0]), of("R").alias(OBSERVED[1]), of("N").alias(OBSERVED[2])))


# --- delivered runs ----------------------------------------------------------

RUNS = ("ok", "dup", "gap", "header", "short", "width", "geo", "month", "version", "anon", "twice",
        "declared", "extra", "again", "tamper", "negative", "bare")


def _shard_name(run, target, month):
    return F.concat(F.lit("run_"), run, F.lit("__"), target, F.lit("__m"),
                    F.lpad(month.cast("string"), 6, "0"))


def _sidecar_name(run):
    return F.concat(F.lit("run_"), run, F.lit("__sidecar"))


_NONE = 2 ** 31 - 1  # the number of no draw


def _span(low, high=_NONE - 1):
    """The numbers of lost draws, from ``low`` to ``high``."""
    return F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"))


def _sent(shard, month):
    return F.struct(shard.alias("shard"), month.alias(MONTH))


def wire_runs(spark, sf_dir, runs=RUNS):
    """Runs of the posterior in long form. ``ok`` is whole, ``half`` (not in ``RUNS``) is whole with half
    as many draws, each other one has a single fault."""
    run, target, month = F.col("run"), F.col("target"), F.col(MONTH)
    cell, sample = F.col(CELL), F.col("sample")
    first = (cell == 0) & (month == 258)
    names = ", ".join(f"'lr_ged_{s}', pred_lr_ged_{s}" for s in SERIES)
    vectors = (posterior(spark, sf_dir)
               .select(MONTH, CELL, F.expr(f"stack(3, {names}) as (target, draws)"))
               .withColumn("run", F.explode(F.array(*map(F.lit, runs)))))
    sb, ns, os_ = (target == f"lr_ged_{s}" for s in SERIES)
    # What a draw's vector decides is decided once a vector: the draws that are lost, those that change, and
    # the shards it comes in. ``extra`` sends shards of one more month, that no manifest lists.
    lost = (F.when((run == "gap") & sb & first, _span(DRAWS - 1, DRAWS - 1))
            .when((run == "width") & os_ & (month == 260), _span(DRAWS // 2))
            .when(run == "half", _span(DRAWS // 2)))
    shard = _shard_name(run, target, month)
    comes = (F.when((run == "twice") & os_ & (month == 260), F.array(_sent(shard, month), _sent(F.concat(shard, F.lit("b")), month)))
             .when((run == "extra") & (month == 262), F.array(_sent(shard, month), _sent(F.concat(shard, F.lit("x")), F.lit(263))))
             .otherwise(F.array(_sent(shard, month))))
    sent = (vectors.filter(~(((run == "short") & ns & (month == 259) & (cell == 0)) | ((run == "month") & (month == 262))))
            .select(F.concat(F.lit("run_"), run).alias("run_id"), F.explode(comes).alias("sent"), "target",
                    F.when((run == "geo") & (cell == 0), F.lit(-1)).otherwise(cell).cast("long").alias(CELL), "draws",
                    F.coalesce(lost["low"], F.lit(_NONE)).alias("low"), F.coalesce(lost["high"], F.lit(_NONE)).alias("high"),
                    F.when((run == "dup") & sb & first, DRAWS - 1).otherwise(_NONE).alias("again"),
                    F.when((run == "negative") & sb & first, 0).otherwise(_NONE).alias("below")))
    long = sent.select("run_id", F.col("sent.shard").alias("shard"), "target", F.col(f"sent.{MONTH}").alias(MONTH), CELL,
                       "low", "high", "again", "below", F.posexplode("draws").alias("sample", "value"))
    delivered = long.filter((sample < F.col("low")) | (sample > F.col("high"))).select(
        "run_id", "shard", "target", MONTH, CELL, F.when(sample == F.col("again"), F.lit(0)).otherwise(sample).alias("sample"),
        F.when(sample == F.col("below"), F.lit(-1.0).cast(long.schema["value"].dataType)).otherwise(F.col("value")).alias("value"))
    cells = table(spark, sf_dir, "embeddings").agg(
        F.countDistinct(F.floor(F.col("vec_id") / 5)).alias("expected_cell_count"))
    plan = (cells.withColumn("run", F.explode(F.array(*map(F.lit, runs))))
            .withColumn("run_id", F.concat(F.lit("run_"), run)))
    listed = F.flatten(F.transform(F.array(*map(F.lit, MONTHS)), lambda m: F.transform(
        F.array(*[F.lit(f"lr_ged_{s}") for s in SERIES]), lambda t: F.struct(
            _shard_name(run, t, m).alias("name"), t.alias("target"), m.cast("int").alias("time_id"),
            F.sha2(_shard_name(run, t, m), 256).alias("sha256")))))
    extra = F.array(F.struct(
        F.concat(_shard_name(run, F.lit("lr_ged_os"), F.lit(260)), F.lit("b")).alias("name"),
        F.lit("lr_ged_os").alias("target"), F.lit(260).alias("time_id"),
        F.lit(None).cast("string").alias("sha256")))
    again = F.filter(listed, lambda s: (s["target"] == "lr_ged_os") & (s["time_id"] == 260))
    manifest = plan.select(
        "run_id",
        F.when(run == "version", F.lit("2.0")).otherwise(F.lit("1.5")).alias("contract_version"),
        F.array(*[F.lit(f"lr_ged_{s}") for s in SERIES]).alias("targets"),
        F.when(run == "declared", F.array(*map(F.lit, MONTHS[:-1])))
        .otherwise(F.array(*map(F.lit, MONTHS))).alias("expected_months"),
        "expected_cell_count",
        F.when(run == "twice", F.concat(listed, extra)).when(run == "again", F.concat(listed, again))
        .otherwise(listed).alias("shards"),
        F.struct(_sidecar_name(run).alias("name"), F.sha2(_sidecar_name(run), 256).alias("sha256")).alias("sidecar"))
    unlisted = F.transform(F.filter(listed, lambda s: s["time_id"] == 262), lambda s: s.withField(
        "name", F.concat(s["name"], F.lit("x"))).withField("time_id", F.lit(263)))
    shards = plan.select("run_id", "run", F.explode(
        F.when(run == "twice", F.concat(listed, extra)).when(run == "extra", F.concat(listed, unlisted))
        .otherwise(listed)).alias("s"))
    headers = shards.filter(~((run == "month") & (F.col("s.time_id") == 262))).select(
        "run_id", F.col("s.name").alias("shard"), F.col("s.target").alias("header_target"),
        F.when((run == "header") & (F.col("s.target") == "lr_ged_sb") & (F.col("s.time_id") == 258),
               F.lit(259)).otherwise(F.col("s.time_id")).alias("header_month"),
        F.when(run == "half", F.lit(DRAWS // 2)).otherwise(F.lit(DRAWS)).alias("sample_count"),
        F.when(run == "anon", F.lit("unknown")).otherwise(F.lit("ensemble_a")).alias("ensemble"))
    # A file's content is its name, but for one altered shard; one run's sidecar did not come.
    altered = (F.col("run_id") == "run_tamper") & (F.col("header_target") == "lr_ged_sb") & (F.col("header_month") == 258)
    files = headers.select("run_id", F.col("shard").alias("name"), F.sha2(
        F.when(altered, F.concat("shard", F.lit("x"))).otherwise(F.col("shard")), 256).alias("actual")).unionByName(
        plan.filter(run != "bare").select("run_id", _sidecar_name(run).alias("name"), F.sha2(_sidecar_name(run), 256).alias("actual")))
    return Run(delivered, headers, manifest, geography(spark, sf_dir), files)


# --- artifact catalog --------------------------------------------------------

def catalog(spark, sf_dir):
    event = F.col("event_id")
    series = F.element_at(F.array(*map(F.lit, SERIES)), (event % 3 + 1).cast("int"))
    versions = F.array(*map(F.lit, ("1.5", "1.4", "1.6", "2.0", "", "x")))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("f"), event.cast("string")).alias("file_id"),
        F.concat(F.lit("run_"), F.col("user_id").cast("string"), F.lit(".parquet")).alias("filename"),
        F.concat(F.lit("line_"), (F.col("user_id") % 5).cast("string")).alias("name"),
        F.when(F.col("event_type") == "view", F.lit("sampled_forecast_manifest"))
        .when(F.col("event_type") == "click", F.lit("sampled_forecast_shard"))
        .when(F.col("event_type") == "error", F.lit("sampled_forecast_sidecar"))
        .otherwise(F.lit("model")).alias("type"),
        F.when(event % 2 == 0, F.lit("forecast")).otherwise(F.lit("historical")).alias("category"),
        F.array(F.concat(F.lit("lr_ged_"), series)).alias("targets"),
        F.when(event % 7 != 0, F.concat(F.lit("ens_"), (F.col("user_id") % 5).cast("string")))
        .alias("source"),
        F.when(event % 14 == 0, F.lit("pipe")).alias("pipeline"),
        F.concat(F.lit("value "), F.col("props")).alias("description"),
        F.sha2((event % 500).cast("string"), 256).alias("file_hash"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.element_at(versions, (event % 6 + 1).cast("int")).alias("contract_version"),
        "event_id", "user_id", "value",
    )


def quarantined(spark, sf_dir):
    """Artifact ids an operator has withdrawn."""
    return table(spark, sf_dir, "events").filter(F.col("value") < 2.0).select(
        F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("file_id"))


def approved(spark, sf_dir):
    """Artifact ids an operator has approved."""
    return table(spark, sf_dir, "events").filter(F.col("value") < 20.0).select(
        F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("file_id"))
