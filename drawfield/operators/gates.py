"""Integrity gates over delivered runs in long form, and the verdict they add up to.

One scan of the draws is reduced, with map-side combine, to one row per (shard, cell); all gates
read that profile. A draw number is recorded as a bit, so the exact set of draws of a cell is a
few BIGINTs whatever the number of copies delivered.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drawfield.operators.validate import geo_plausibility
from drawfield.schema import CELL, CONTRACT_VERSION, MONTH
from drawfield.sources.digests import artifact_states

# name -> stops the checks that follow it when it fails, in the order they are evaluated
GATES = {
    "contract_version": True,
    "declares_expectations": True,
    "self_consistent": False,
    "missing_artifacts": True,
    "repeated_entries": True,
    "unlisted": True,
    "content_hash": False,
    "identifiable": False,
    "header": False,
    "cell_count": False,
    "sample_count": False,
    "sample_order": False,
    "uniform_s": False,
    "duplicates": False,
    "coverage": False,
    "rectangular": False,
    "plausible_draws": False,
    "plausible_geography": False,
}

# Each vector once, with the declared draws, each once: a run that passes these can be assembled.
WHOLE = ("sample_count", "sample_order", "duplicates")


@dataclass(frozen=True)
class Run:
    """One or many delivered runs.

    ``draws``    run_id, shard, target, month_id, priogrid_id, sample, value
    ``headers``  run_id, shard, header_target, header_month, sample_count, ensemble
    ``manifest`` run_id, contract_version, targets, expected_months, expected_cell_count, shards, sidecar
    ``sidecar``  priogrid_id and geography
    ``files``    run_id, name, actual (SHA-256) of delivered files, if they were listed
    """

    draws: DataFrame
    headers: DataFrame
    manifest: DataFrame
    sidecar: DataFrame
    files: DataFrame | None = None


# --- profiles ----------------------------------------------------------------

def cell_profile(run):
    """Per (shard, cell): number of rows, and whether the draw numbers are exactly 0..rows-1.

    64 draw numbers are one BIGINT of marks, combined map-side; no width is assumed. The second
    grouping sees one row per cell and 64 draws.
    """
    keys = ("run_id", "shard", "target", MONTH, CELL)
    sample = F.col("sample")
    words = run.draws.groupBy(*keys, F.shiftright(sample.cast("long"), 6).alias("word")).agg(
        F.count("*").alias("rows"), F.min(sample).alias("low"), F.max(sample).alias("high"),
        F.bit_or(F.expr("shiftleft(1L, int(pmod(sample, 64)))")).alias("marks"),
        (F.count_if(~plausible(F.col("value"))) if "value" in run.draws.columns else F.lit(0).cast("long")).alias("implausible"))
    profile = words.groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.sum(F.bit_count("marks")).alias("distinct"), F.sum("implausible").alias("implausible"))
    return profile.select(*keys, "rows", F.coalesce(
        (F.col("low") == 0) & (F.col("high") == F.col("rows") - 1) & (F.col("distinct") == F.col("rows")),
        F.lit(False)).alias("ordered"), "implausible")


def plausible(value):
    """A draw is there, finite and not negative."""
    return F.coalesce((value >= 0) & ~F.isnan(value) & (value < float("inf")), F.lit(False))


def shard_profile(run):
    """Per shard: cells, the smallest and largest vector, cells whose draws are not 0..S-1."""
    return cell_profile(run).groupBy("run_id", "shard", "target", MONTH).agg(
        F.count("*").alias("cells"),
        F.min("rows").alias("s_min"), F.max("rows").alias("s_max"),
        F.count_if(~F.col("ordered")).alias("disordered"))


def manifest_shards(manifest):
    """One row per shard a manifest lists, with its name, target, month and hash."""
    return manifest.select("run_id", F.explode("shards").alias("s")).select(
        "run_id", F.col("s.name").alias("shard"), F.col("s.target").alias("target"),
        F.col("s.time_id").alias(MONTH), F.col("s.sha256").alias("sha256"))


# --- single gates: one row per run -------------------------------------------

def _by_run(frame, problems):
    return frame.groupBy("run_id").agg(F.coalesce(F.sum(problems), F.lit(0)).alias("problems"))


def sample_count_gate(run):
    """Every vector of a shard has the number of draws its header declares."""
    joined = shard_profile(run).join(run.headers, ["run_id", "shard"], "left")
    bad = (~F.col("s_min").eqNullSafe(F.col("sample_count"))
           | ~F.col("s_max").eqNullSafe(F.col("sample_count")))
    return _by_run(joined, bad.cast("long"))


def sample_order_gate(run):
    """The draws of every cell are numbered exactly 0..S-1."""
    return _by_run(shard_profile(run), F.col("disordered"))


def header_gate(run):
    """Target and month of a shard's header equal its manifest entry."""
    joined = manifest_shards(run.manifest).join(run.headers, ["run_id", "shard"])
    bad = (F.coalesce(F.col("header_target") != F.col("target"), F.lit(False))
           | F.coalesce(F.col("header_month") != F.col(MONTH), F.lit(False)))
    return _by_run(joined, bad.cast("long"))


def cell_count_gate(run):
    """Every shard covers the declared number of cells."""
    joined = shard_profile(run).join(run.manifest.select("run_id", "expected_cell_count"), "run_id")
    return _by_run(joined, (F.col("cells") != F.col("expected_cell_count")).cast("long"))


def uniform_s_gate(run):
    """All shards of a run have the same number of draws."""
    return shard_profile(run).groupBy("run_id").agg(
        (F.max("s_max") - F.min("s_min")).alias("problems"))


def duplicates_gate(run):
    """No (target, month, cell) arrives in two shards."""
    grid = cell_profile(run).groupBy("run_id", "target", MONTH, CELL).agg(F.count("*").alias("n"))
    return _by_run(grid, (F.col("n") > 1).cast("long"))


def uncovered_cells(run):
    """Cells with draws but without a sidecar row."""
    return (run.draws.select("run_id", CELL).distinct()
            .join(run.sidecar.select(CELL), CELL, "left_anti"))


def coverage_gate(run):
    """Every forecast cell has a sidecar row."""
    uncovered = uncovered_cells(run).groupBy("run_id").agg(F.count("*").alias("problems"))
    return run.manifest.select("run_id").join(uncovered, "run_id", "left").fillna(0, "problems")


def rectangular_gate(run):
    """Every month has the same cells, and every cell of it all targets.

    If each month counts as many cells as the whole run, the sets are equal.
    """
    grid = cell_profile(run).groupBy("run_id", MONTH, CELL).agg(
        F.countDistinct("target").alias("targets"))
    cells = grid.groupBy("run_id", CELL).agg(
        F.count("*").alias("months"), F.min("targets").alias("fewest"), F.max("targets").alias("most"))
    months = grid.groupBy("run_id").agg(F.countDistinct(MONTH).alias("run_months"))
    wanted = run.manifest.select("run_id", F.size("targets").alias("run_targets"))
    joined = cells.join(months, "run_id").join(wanted, "run_id")
    bad = ((F.col("months") != F.col("run_months")) | (F.col("fewest") != F.col("run_targets"))
           | (F.col("most") != F.col("run_targets")))
    return _by_run(joined, bad.cast("long"))


def can_render(version, served=CONTRACT_VERSION):
    """Same major and no newer minor than served; a blank version passes, an odd one does not."""
    major, minor = (int(p) for p in served.split("."))
    text = F.trim(F.coalesce(version, F.lit("")))
    parts = F.split(text, r"\.")
    asked_major = parts[0].try_cast("int")
    asked_minor = F.when(F.size(parts) > 1, F.get(parts, F.lit(1)).try_cast("int")).otherwise(0)
    fits = (asked_major == major) & (asked_minor <= minor)
    return F.when(text == "", F.lit(True)).otherwise(F.coalesce(fits, F.lit(False)))


def contract_version_gate(run):
    return run.manifest.select(
        "run_id", (~can_render(F.col("contract_version"))).cast("long").alias("problems"))


def expectations_gate(run):
    """The manifest declares months, a cell count and a sidecar."""
    declared = ((F.coalesce(F.size("expected_months"), F.lit(0)) > 0)
                & F.col("expected_cell_count").isNotNull()
                & (F.coalesce(F.col("sidecar.name"), F.lit("")) != ""))
    return run.manifest.select("run_id", (~declared).cast("long").alias("problems"))


def self_consistent_gate(run):
    """Declared months and targets are those of the listed shards, both ways."""
    months = F.transform("shards", lambda s: s["time_id"])
    targets = F.transform("shards", lambda s: s["target"])
    differences = (F.size(F.array_except("expected_months", months))
                   + F.size(F.array_except(months, F.col("expected_months")))
                   + F.size(F.array_except("targets", targets))
                   + F.size(F.array_except(targets, F.col("targets"))))
    undeclared = F.coalesce(F.size("targets"), F.lit(0)) == 0
    return run.manifest.select("run_id", F.when(undeclared, 1).otherwise(differences)
                               .cast("long").alias("problems"))


def identifiable_gate(run):
    """The shard headers name the ensemble, and not as unknown."""
    named = F.coalesce(F.col("ensemble"), F.lit("")).isin("", "unknown")
    return run.headers.groupBy("run_id").agg(F.count_if(named).alias("problems"))


def escapes(name):
    """A name that is empty, absolute, or climbs out of the run directory."""
    return (F.coalesce(name, F.lit("")) == "") | name.startswith("/") | \
        F.array_contains(F.split(name, "/"), "..")


def missing_artifacts(run):
    """Listed shards that were not delivered, or whose name leaves the run directory; the sidecar too, where files were listed."""
    delivered = run.headers.select("run_id", "shard").distinct().withColumn("delivered", F.lit(True))
    joined = manifest_shards(run.manifest).join(delivered, ["run_id", "shard"], "left")
    missing = joined.filter(F.col("delivered").isNull() | escapes(F.col("shard"))).select("run_id", "shard")
    if run.files is None:
        return missing
    sidecar = run.manifest.select("run_id", F.col("sidecar.name").alias("shard"))
    came = run.files.select("run_id", F.col("name").alias("shard")).distinct()
    absent = sidecar.join(came, ["run_id", "shard"], "left_anti").unionByName(sidecar.filter(escapes(F.col("shard"))))
    return missing.unionByName(absent.distinct())


def missing_artifacts_gate(run):
    missing = missing_artifacts(run).groupBy("run_id").agg(F.count("*").alias("problems"))
    return run.manifest.select("run_id").join(missing, "run_id", "left").fillna(0, "problems")


def content_hash_gate(run):
    """No delivered file differs from the hash its manifest gives; an artifact without hash is not held against a run."""
    none = run.manifest.select("run_id", F.lit(0).cast("long").alias("problems"))
    if run.files is None:
        return none
    wrong = artifact_states(run.manifest, run.files).filter("state = 'mismatch'").groupBy("run_id").agg(F.count("*").alias("problems"))
    return none.select("run_id").join(wrong, "run_id", "left").fillna(0, "problems")


def plausible_draws_gate(run):
    """Every draw is finite and not negative."""
    return _by_run(cell_profile(run), F.col("implausible"))


def plausible_geography_gate(run):
    """Coordinates of the sidecar lie on the globe and country codes have three letters."""
    bad = geo_plausibility(run.sidecar).select(F.expr("bad_longitude + bad_latitude + bad_iso3")).scalar()
    return run.manifest.select("run_id", bad.cast("long").alias("problems"))


def repeated_entries_gate(run):
    """No shard name is listed twice."""
    names = manifest_shards(run.manifest).groupBy("run_id").agg(
        (F.count("shard") - F.countDistinct("shard")).alias("problems"))
    return run.manifest.select("run_id").join(names, "run_id", "left").fillna(0, "problems")


def unlisted_gate(run):
    """Every delivered shard is listed in the manifest."""
    listed = manifest_shards(run.manifest).select("run_id", "shard").distinct()
    extra = (shard_profile(run).join(listed, ["run_id", "shard"], "left_anti").groupBy("run_id")
             .agg(F.countDistinct("shard").alias("problems")))
    return run.manifest.select("run_id").join(extra, "run_id", "left").fillna(0, "problems")


def listed_draws(run):
    """Only the draws of shards that the manifest lists: what assembly may read."""
    listed = manifest_shards(run.manifest).select("run_id", "shard").distinct()
    return run.draws.join(listed, ["run_id", "shard"], "left_semi")


def loaded_vs_listed(run):
    """Full outer comparison of delivered and listed shard names."""
    delivered = run.draws.select("run_id", "shard").distinct().withColumn("loaded", F.lit(True))
    listed = manifest_shards(run.manifest).select("run_id", "shard").distinct() \
        .withColumn("listed", F.lit(True))
    return delivered.join(listed, ["run_id", "shard"], "full_outer").groupBy("run_id").agg(
        F.count_if(F.col("listed").isNull()).alias("unlisted"),
        F.count_if(F.col("loaded").isNull()).alias("unloaded"))


def run_size(manifest, headers):
    """Bytes of the assembled draws, for sizing partitions: 4 per draw."""
    width = headers.groupBy("run_id").agg(F.max("sample_count").alias("sample_count"))
    draws = (F.size("targets").cast("long") * F.size("expected_months") * F.col("expected_cell_count")
             * F.col("sample_count"))
    return manifest.join(width, "run_id", "left").select(
        "run_id", (draws * 4).alias("value_bytes"), (draws * 12).alias("peak_bytes"))


# --- all gates in one pass ----------------------------------------------------

def gate_rows(run, profile=None):
    """``(run_id, gate, step, passed, terminal)`` for every gate of every run.

    The draws are read once: the four shard gates, the duplicate, coverage and shape gates all
    come from one (shard, cell) profile, which may be given.
    """
    sidecar = run.sidecar.select(CELL, F.lit(True).alias("covered"))
    wanted = run.manifest.select(
        "run_id", "expected_cell_count", F.size("targets").alias("run_targets"))
    cells = cell_profile(run) if profile is None else profile
    # One shuffle by (run, cell) serves the three groupings below: each contains both columns.
    # A (run, cell) has one row per shard, never more than the manifest's months x targets.
    by_target = cells.repartition("run_id", CELL).groupBy("run_id", CELL, MONTH, "target").agg(
        F.count("*").alias("copies"), F.min("rows").alias("s_min"), F.max("rows").alias("s_max"),
        F.count_if(~F.col("ordered")).alias("disordered"))
    by_month = by_target.groupBy("run_id", CELL, MONTH).agg(
        F.count("*").alias("targets"), F.sum(F.col("copies") - 1).alias("repeats"),
        F.min("s_min").alias("s_min"), F.max("s_max").alias("s_max"),
        F.sum("disordered").alias("disordered"))
    by_cell = by_month.groupBy("run_id", CELL).agg(
        F.count("*").alias("months"), F.min("targets").alias("fewest"), F.max("targets").alias("most"),
        F.sum("repeats").alias("repeats"), F.min("s_min").alias("s_min"),
        F.max("s_max").alias("s_max"), F.sum("disordered").alias("disordered")
    ).join(sidecar, CELL, "left")
    shape = by_cell.groupBy("run_id").agg(
        F.max("months").alias("most_months"), F.min("months").alias("fewest_months"),
        F.min("fewest").alias("fewest"), F.max("most").alias("most"),
        F.sum("repeats").alias("repeats"), F.sum("disordered").alias("disordered"),
        F.min("s_min").alias("s_min"), F.max("s_max").alias("s_max"),
        F.count_if(F.col("covered").isNull()).alias("uncovered"))
    # Reads the same columns of the profile as above, so that Spark reuses its shuffle.
    by_shard = cells.groupBy("run_id", "shard", "target", MONTH).agg(
        F.count("*").alias("cells"), F.min("rows").alias("s_min"), F.max("rows").alias("s_max"),
        F.count_if(~F.col("ordered")).alias("out_of_order"), F.sum("implausible").alias("implausible"))
    listed = (manifest_shards(run.manifest).select("run_id", "shard").distinct()
              .withColumn("listed", F.lit(True)))
    shards = (by_shard.join(run.headers, ["run_id", "shard"], "left")
              .join(listed, ["run_id", "shard"], "left")
              .join(wanted, "run_id").groupBy("run_id").agg(
        F.count_if(F.col("listed").isNull()).alias("unlisted"),
        F.size(F.collect_set(MONTH)).alias("run_months"), F.sum("out_of_order").alias("out_of_order"),
        F.sum("implausible").alias("implausible"),
        F.count_if(F.col("cells") != F.col("expected_cell_count")).alias("wrong_cells"),
        F.count_if(~F.col("s_min").eqNullSafe(F.col("sample_count"))
                   | ~F.col("s_max").eqNullSafe(F.col("sample_count"))).alias("wrong_s")))
    facts = (shape.join(shards, "run_id").join(wanted, "run_id")
             .withColumn("flags", F.map_from_arrays(
        F.array(*map(F.lit, ("cell_count", "sample_count", "sample_order", "uniform_s",
                             "duplicates", "coverage", "unlisted", "plausible_draws", "rectangular"))),
        F.array(F.col("wrong_cells") == 0, F.col("wrong_s") == 0,
                (F.col("disordered") == 0) & (F.col("out_of_order") == 0),
                F.col("s_min") == F.col("s_max"), F.col("repeats") == 0, F.col("uncovered") == 0,
                F.col("unlisted") == 0, F.col("implausible") == 0,
                (F.col("fewest_months") == F.col("run_months"))
                & (F.col("most_months") == F.col("run_months"))
                & (F.col("fewest") == F.col("run_targets"))
                & (F.col("most") == F.col("run_targets"))))))
    from_draws = facts.select("run_id", F.explode("flags").alias("gate", "passed"))
    from_manifest = None
    for name, gate in (("contract_version", contract_version_gate),
                       ("declares_expectations", expectations_gate),
                       ("self_consistent", self_consistent_gate),
                       ("missing_artifacts", missing_artifacts_gate),
                       ("repeated_entries", repeated_entries_gate),
                       ("content_hash", content_hash_gate), ("plausible_geography", plausible_geography_gate),
                       ("identifiable", identifiable_gate), ("header", header_gate)):
        rows = gate(run).select("run_id", F.lit(name).alias("gate"),
                                (F.col("problems") == 0).alias("passed"))
        from_manifest = rows if from_manifest is None else from_manifest.unionByName(rows)
    step = F.array_position(F.array(*map(F.lit, GATES)), F.col("gate")).cast("int")
    terminal = F.col("gate").isin([g for g, stops in GATES.items() if stops])
    return from_manifest.unionByName(from_draws).select(
        "run_id", "gate", step.alias("step"), "passed", terminal.alias("terminal"))


def evaluated(gates):
    """Drop the gates that come after the first terminal failure of their run.

    A run has at most ``len(GATES)`` rows, so the window partitions stay that small.
    """
    per_run = Window.partitionBy("run_id")
    stop = F.min(F.when(~F.col("passed") & F.col("terminal"), F.col("step"))).over(per_run)
    return (gates.withColumn("stop", stop)
            .filter(F.col("stop").isNull() | (F.col("step") <= F.col("stop"))).drop("stop"))


def verdict(gates, expected=len(GATES)):
    """``NOT SERVABLE`` on any failure, ``INCOMPLETE`` if a gate was skipped, else ``SERVABLE``."""
    return gates.groupBy("run_id").agg(
        F.count("*").alias("checked"), F.count_if(~F.col("passed")).alias("failed")).withColumn(
        "verdict", F.when(F.col("failed") > 0, "NOT SERVABLE")
        .when(F.col("checked") < expected, "INCOMPLETE").otherwise("SERVABLE"))


def find_manifest(documents, suffix):
    """Per directory: the one JSON document that lists shards and names no single target.

    ``documents``: directory, filename, shards, target. If several qualify the file suffix
    decides; the result says how many candidates were left, 1 being the only good answer.
    """
    runs = documents.filter(F.col("shards").isNotNull() & F.col("target").isNull())
    named = F.col("filename").endswith(suffix)
    found = runs.groupBy("directory").agg(
        F.count("*").alias("candidates"), F.count_if(named).alias("named"),
        F.min("filename").alias("any_name"), F.min(F.when(named, F.col("filename"))).alias("suffixed"))
    return found.select(
        "directory", "candidates",
        F.when(F.col("candidates") == 1, F.col("any_name"))
        .when(F.col("named") == 1, F.col("suffixed")).alias("filename"))
