"""SHA-256 of delivered files of any size, and what it says against a manifest.

Files are listed by Spark without opening them; those without content are passed over, so an empty artifact counts as
not delivered. A small one is hashed where Spark reads it; a larger one is read by its task in pieces of ``PIECE`` bytes,
so no file is ever held whole. A digest is one pass over one file: files are dealt over the tasks, a file is not.
"""

import hashlib
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

# The functions travel with their tasks, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECE = 8 << 20
WHOLE = 64 << 20


def _system(path):
    """pyarrow's file system of a URI, and the path in it."""
    from pyarrow import fs
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def _stream(path):
    """An open file by its URI."""
    system, inner = _system(path)
    return system.open_input_stream(inner)


def streamed_digests(files, piece=PIECE):
    """``path``, ``length``, ``actual``: the digests of ``files`` (``path``, ``length``), read piece by piece."""
    def run(batches):
        for batch in batches:
            found = []
            for path in batch["path"].to_pylist():
                digest = hashlib.sha256()
                with _stream(path) as stream:
                    while data := stream.read(piece):
                        digest.update(data)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch["path"], batch["length"], pa.array(found, pa.string())], names=["path", "length", "actual"])
    return files.select("path", "length").mapInArrow(run, "path string, length long, actual string")


def file_digests(spark, path, whole=WHOLE, piece=PIECE):
    """``directory``, ``name``, ``length``, ``actual`` of every file below a path, which is listed once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = files.filter(F.col("length") <= whole).select("path", "length", F.sha2("content", 256).alias("actual"))
    # A fixed number of tasks: a list of paths is so short that Spark would hash all its files in one.
    large = files.select("path", "length").filter(F.col("length") > whole).repartition(_tasks(spark), "path")
    parts = F.split("path", "/")
    return small.unionByName(streamed_digests(large, piece)).select(
        F.element_at(parts, -2).alias("directory"), F.element_at(parts, -1).alias("name"), "length", "actual")


def _tasks(spark):
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_files(files, path):
    """Write ``files`` (``directory``, ``name``, ``content`` text) as ``path/directory/name``; their number.

    Each task writes its files itself, so nothing is renamed afterwards; a task that runs again writes the same bytes.
    """
    spark = files.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    base = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()

    def run(batches):
        system, root = _system(base)
        made = set()
        for batch in batches:
            for directory, name, content in zip(*(batch[c].to_pylist() for c in ("directory", "name", "content"))):
                if directory not in made:
                    system.create_dir(f"{root}/{directory}", recursive=True)
                    made.add(directory)
                with system.open_output_stream(f"{root}/{directory}/{name}") as stream:
                    stream.write(content.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["files"])

    dealt = files.select("directory", "name", "content").repartition(_tasks(spark), "directory", "name")
    return dealt.mapInArrow(run, "files long").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def declared_artifacts(manifest):
    """``run_id``, ``name``, ``sha256`` of everything a manifest lists: its shards and its sidecar."""
    shards = manifest.select("run_id", F.explode("shards").alias("s")).select("run_id", F.col("s.name").alias("name"), F.col("s.sha256").alias("sha256"))
    sidecar = manifest.select("run_id", F.col("sidecar.name").alias("name"), F.col("sidecar.sha256").alias("sha256"))
    return shards.unionByName(sidecar.filter("name IS NOT NULL"))


def artifact_states(manifest, files):
    """``run_id``, ``name``, ``state``, ``actual`` of every listed artifact against the delivered ``files`` (``run_id``, ``name``, ``actual``).

    ``verified``, ``mismatch``, ``unverified`` where the manifest gives no hash, ``missing`` where no such file came.
    ``actual`` is the delivered file's hash, of several of one name the smallest.
    Nothing is read but what the manifest's own directory holds: a name that leaves it is missing.
    """
    delivered = files.groupBy("run_id", "name").agg(F.min("actual").alias("low"), F.max("actual").alias("high"))
    joined = declared_artifacts(manifest).join(delivered, ["run_id", "name"], "left")
    declared = F.lower(F.trim("sha256"))
    state = (F.when(F.col("low").isNull(), "missing").when(F.coalesce(declared, F.lit("")) == "", "unverified")
             .when((declared == F.col("low")) & (declared == F.col("high")), "verified").otherwise("mismatch"))
    return joined.select("run_id", "name", state.alias("state"), F.col("low").alias("actual"))
