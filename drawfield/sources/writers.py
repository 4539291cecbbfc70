"""Writing tables, and publishing runs so that readers only ever see whole ones."""

import json
import os
import uuid
from datetime import datetime, timezone

from pyspark.sql import functions as F

from drawfield.operators.grid import fingerprint
from drawfield.operators.validate import require_unique_keys
from drawfield.schema import CELL, MONTH


def save_dataset(frame, geo, path):
    """Posterior or observed rows by month, the geography beside them, and the fingerprints of both.

    The fingerprints are of the rows handed over, computed apart from the write, so they tell what was lost in it.
    """
    frame.write.partitionBy(MONTH).parquet(f"{path}/grid")
    geo.write.parquet(f"{path}/geo")
    # A row a month and one for the geography.
    _marks(frame, geo).coalesce(1).write.parquet(f"{path}/fingerprint")
    return path


def _marks(frame, geo):
    rows = fingerprint(frame, sorted(frame.columns), (MONTH,)).withColumn(MONTH, F.col(MONTH).cast("long"))
    places = fingerprint(geo, sorted(geo.columns)).withColumn(MONTH, F.lit(None).cast("long"))
    return rows.withColumn("part", F.lit("grid")).unionByName(places.withColumn("part", F.lit("geo")))


def load_dataset(spark, path, check=True):
    """Read a saved dataset back; ``check`` looks for repeated keys in both tables and for lost or changed rows.

    The fingerprints show a month with other rows, vectors or vector lengths than were saved. A data
    set without them, as an earlier version wrote, is an error; read it with ``check=False``.
    """
    grid = spark.read.parquet(f"{path}/grid").withColumn(MONTH, F.col(MONTH).cast("int"))
    geo = spark.read.parquet(f"{path}/geo")
    if check:
        require_unique_keys(grid)
        require_unique_keys(geo, (CELL,))
        saved = spark.read.parquet(f"{path}/fingerprint")
        found = _marks(grid, geo).select(*saved.columns)
        wrong = [r for r in saved.exceptAll(found).unionByName(found.exceptAll(saved)).select("part", MONTH).distinct().limit(10).collect()]
        if wrong:
            raise ValueError("not the rows that were saved: " + ", ".join(
                "geography" if r["part"] == "geo" else f"month {r[MONTH]}" for r in wrong))
    return grid, geo


def write_bulk(table, path):
    table.write.parquet(path)
    return path


# --- publication ---------------------------------------------------------------------
#
# The log of a base is a folder of numbered files, 0, 1, 2, ..., each the entries of one commit. A commit is the
# creation of the next file, which fails if another publisher made it first: of two publishers of a run
# one wins, and the other sees it in the log before it tries the next number. Rows are written, and
# verified, before; what no entry names is never read.

ENTRIES = "run_id string, path string, rows long, published_at timestamp"


def publish_runs(frame, base, expected_rows=None):
    """Write runs (``run_id`` and a posterior table), verify what was written, and only then list them as published.

    All runs of the frame are one write, by run and month, and one commit. A failure before the commit leaves files
    no reader looks at. A run that is listed already, or is listed by another publisher meanwhile, stays as it is.
    ``expected_rows``: rows by run id. Returns the ids published by this call.
    """
    spark = frame.sparkSession
    frame = frame.join(published(spark, base).select("run_id"), "run_id", "left_anti")
    attempt = f"{base}/runs/{uuid.uuid4().hex}"
    # A month's rows go to one file, or to several where there are many: AQE splits and joins by size.
    (frame.withColumn("run", F.concat(F.lit("run:"), "run_id")).hint("rebalance", "run_id", MONTH)
     .write.partitionBy("run", MONTH).parquet(attempt))
    # With its schema, as a write of no rows leaves nothing to infer it from.
    written = spark.read.schema(frame.schema).parquet(attempt)
    found = {r["run_id"]: r["rows"] for r in written.groupBy("run_id").agg(F.count("*").alias("rows")).collect()}  # a row per run
    for run_id, rows in (expected_rows or {}).items():
        if run_id in found and found[run_id] != rows:
            raise ValueError(f"run {run_id} has {found[run_id]} rows on disk, expected {rows}")
    require_unique_keys(written, ("run_id", MONTH, CELL))
    return _commit(spark, base, attempt, found) if found else set()


def publish_run(frame, run_id, base, expected_rows=None):
    """The same for one run. False if it is listed already, or another publisher was faster."""
    if is_published(frame.sparkSession, base, run_id):
        return False
    expected = None if expected_rows is None else {run_id: expected_rows}
    return run_id in publish_runs(frame.withColumn("run_id", F.lit(run_id)), base, expected)


def _commit(spark, base, attempt, found):
    """Adds the runs that nobody has listed to the log; their ids."""
    version = _next_version(spark, base)
    while True:
        listed = {r["run_id"] for r in published(spark, base).select("run_id").filter(F.col("run_id").isin(*found)).collect()}
        mine = {run_id: rows for run_id, rows in found.items() if run_id not in listed}
        if not mine:
            return set()
        now = datetime.now(timezone.utc).isoformat()
        lines = [json.dumps({"run_id": r, "path": attempt, "rows": n, "published_at": now}) for r, n in mine.items()]
        if create_once(spark, _log_file(base, version), "\n".join(lines) + "\n"):
            return set(mine)
        version += 1


def _log_file(base, version):
    return f"{base}/log/{version:020d}.json"


def _next_version(spark, base):
    """The first number without a file: numbers have no gaps, so it is found by doubling and halving."""
    high = 1
    while _there(spark, _log_file(base, high - 1)):
        high *= 2
    low = high // 2
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if _there(spark, _log_file(base, middle)) else (low, middle)
    return low


def _file_system(spark, path):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _there(spark, path):
    system, where = _file_system(spark, path)
    return system.exists(where)


def create_once(spark, path, text):
    """Create a file with this content; False if it is there already, whoever made it.

    The store decides: on HDFS and its like by creating without overwriting, on a local disk by an exclusive open.
    """
    system, where = _file_system(spark, path)
    if system.getUri().getScheme() == "file":
        local = where.toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            with open(local, "x", encoding="utf-8") as file:
                file.write(text)
            return True
        except FileExistsError:
            return False
    try:
        stream = system.create(where, False)
    except Exception as error:  # the JVM's exception is told apart by its class
        if "FileAlreadyExists" in str(error):
            return False
        raise
    stream.write(text.encode("utf-8"))
    stream.close()
    return True


def published(spark, base):
    """The list of published runs, replayed from the log; empty before the first."""
    if not _there(spark, f"{base}/log"):
        return spark.createDataFrame([], ENTRIES)
    return spark.read.schema(ENTRIES).json(f"{base}/log")


def is_published(spark, base, run_id):
    return published(spark, base).filter(F.col("run_id") == run_id).limit(1).count() > 0


def read_published(spark, base, run_id):
    """The rows of a run, if it is published."""
    first = published(spark, base).filter(F.col("run_id") == run_id).select("path").first()
    if first is None:
        raise ValueError(f"run {run_id} is not published")
    rows = spark.read.parquet(first["path"])
    columns = [F.col(c) for c in rows.columns if c not in ("run", "run_id", MONTH)]
    return rows.filter(F.col("run") == f"run:{run_id}").select(F.col(MONTH).cast("int").alias(MONTH), *columns)
