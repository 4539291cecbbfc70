"""Reading delivered files."""

import codecs
import csv
import io
import json

from pyspark.sql import functions as F

from drawfield.schema import CELL, GEO_COLUMNS, MANIFEST_SCHEMA, MONTH

READERS = ("parquet", "csv", "json")
SAMPLE_BYTES = 1 << 16
LONGEST_WORD = 8  # characters of a literal or an escape of JSON that a cut may leave behind
# Fixed values of the formats: how a pickle of protocol 2 to 5 starts, and how its files are named.
PICKLE_HEADS = (b"\x80\x02", b"\x80\x03", b"\x80\x04", b"\x80\x05")
PICKLE_NAMES = (".pkl", ".pickle")


def _sample(spark, path):
    """``(bytes, whole)``: the start of the first file below a path, and whether that is all of the file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        return b"", True
    files = system.listFiles(where, True)
    while files.hasNext():
        file = files.next()
        if file.getLen() >= 4 and not file.getPath().getName().startswith(("_", ".")):
            stream = system.open(file.getPath())
            try:
                return bytes(stream.readNBytes(SAMPLE_BYTES)), file.getLen() <= SAMPLE_BYTES
            finally:
                stream.close()
    return b"", True


def format_of(path, sample=b"", whole=True):
    """``parquet``, ``csv`` or ``json``: parquet by its first bytes, the rest by name, unnamed files by content.

    Of an unnamed file the first ``SAMPLE_BYTES`` decide. Pickles are refused, by bytes or name. UTF-8 text is JSON
    if it opens an object or array and its complete lines, or all of it, are JSON; else CSV if it has two
    or more distinct column names and every record as many fields. Anything else is an error that names what each format lacks.
    """
    name = path.rstrip("/").lower()
    if sample[:4] == b"PAR1":
        return "parquet"
    if name.endswith(PICKLE_NAMES) or sample[:2] in PICKLE_HEADS:
        raise ValueError("pickled data is not read")
    for kind in READERS:
        if name.endswith("." + kind) or name.endswith("/" + kind):
            return kind
    try:
        text = _text(sample, whole)
    except UnicodeDecodeError as error:
        raise ValueError(f"cannot tell the format of {path}: parquet: no header; CSV and JSON: not UTF-8 at byte {error.start}") from None
    no_json, no_csv = _json_fault(text, whole), _csv_fault(text, whole)
    if no_json and no_csv:
        raise ValueError(f"cannot tell the format of {path}: parquet: no header; CSV: {no_csv}; JSON: {no_json}")
    return "csv" if no_json else "json"


def _text(sample, whole):
    return codecs.getincrementaldecoder("utf-8-sig")().decode(sample, whole)


def _json_lines(text, whole):
    """Whether every complete line is a JSON object."""
    lines = text.splitlines()
    lines = [x for x in (lines if whole else lines[:-1]) if x.strip()]
    try:
        return bool(lines) and all(isinstance(json.loads(x), dict) for x in lines)
    except ValueError:
        return False


def _json_fault(text, whole):
    if text.lstrip()[:1] not in ("{", "["):
        return "opens neither an object nor an array"
    if _json_lines(text, whole):
        return None
    try:
        json.loads(text)
    except ValueError as error:
        # A document that goes on beyond the sample may fail where the sample ends: in a string, or in its last word.
        if whole or error.pos < len(text.rstrip()) - LONGEST_WORD and "Unterminated" not in str(error):
            return str(error)
    return None


def _csv_fault(text, whole):
    records = []
    try:
        for record in csv.reader(io.StringIO(text, newline=""), strict=True):
            records += [record] if record else []
    except csv.Error as error:
        if whole or "end of data" not in str(error):
            return str(error)
    else:
        records = records if whole or len(records) < 2 else records[:-1]
    names = records[0] if records else []
    if "\0" in text or len(names) < 2:
        return "fewer than two columns"
    if len(set(names)) < len(names) or not all(n.strip() for n in names):
        return "column names are empty or repeated"
    odd = [n for n, r in enumerate(records) if len(r) != len(names)]
    return f"record {odd[0]} has another number of fields than the header" if odd else None


def read_any(spark, path, schema=None):
    """Read a parquet, CSV (UTF-8, with header) or JSON path (a record a line, or one document), whichever it is.

    A file that starts as parquet is read as parquet only: if it is damaged that is an error,
    not a reason to try another format. A JSON document over many lines is parsed by one task a file.
    """
    sample, whole = _sample(spark, path)
    kind = format_of(path, sample, whole)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "csv":
        return reader.option("header", True).option("encoding", "UTF-8").option("mode", "FAILFAST").csv(path)
    if kind == "json":
        document = bool(sample) and not _json_lines(_text(sample, whole), whole)
        return reader.option("mode", "FAILFAST").option("multiLine", document).json(path)
    return reader.parquet(path)


def scan_samples(spark, path, targets):
    """Draw vectors as ARRAY<FLOAT>, only the asked targets."""
    return spark.read.parquet(path).select(
        MONTH, CELL, *[F.col(t).cast("array<float>").alias(t) for t in targets])


def scan_observed(spark, path, targets):
    return spark.read.parquet(path).select(MONTH, CELL, *[F.col(t).cast("double").alias(t) for t in targets])


def scan_geography(spark, path):
    """A sidecar: the cell and its nine columns, cells without geography kept."""
    return spark.read.parquet(path).select(CELL, *GEO_COLUMNS)


def read_manifests(spark, path):
    """Run manifests below a path, one row per file."""
    return spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(path)


def content_hashes(spark, path):
    """Directory, name and SHA-256 of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("directory"),
                        F.element_at(F.split("path", "/"), -1).alias("name"),
                        F.sha2("content", 256).alias("actual"))


def verify_hashes(listed, hashes):
    """``verified``, ``mismatch``, ``missing``, or ``unverified`` where no hash was declared.

    Files are told apart by run directory and name where ``listed`` names both.
    """
    keys = [k for k in ("directory", "name") if k in listed.columns]
    joined = listed.join(hashes.select(*keys, "actual"), keys, "left")
    return joined.withColumn("verdict", F.when(F.col("actual").isNull(), "missing")
                             .when(F.coalesce(F.col("sha256"), F.lit("")) == "", "unverified")
                             .when(F.lower("sha256") == F.col("actual"), "verified")
                             .otherwise("mismatch"))
