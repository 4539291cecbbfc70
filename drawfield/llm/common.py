"""What several of the text operators share: the registry, tables, the shared folder."""

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from drawfield.session import shared_dir

QUERIES = {}
ORACLE = {}


def travels(name):
    """The module's functions are sent with the tasks: executors need not have this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


travels(__name__)


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function
    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(frame, purpose):
    """The frame written below the cluster's shared folder and read again: its lineage ends there."""
    path = shared_dir(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def text_bytes(docs, column="text"):
    """Rows and UTF-8 bytes of a text column: two numbers, whatever the size of the table."""
    row = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(column))).first()
    return row[0], row[1] or 0


def bit_map(ids, key):
    """A bit map of fixed size (2**26 bits) of ids: rows ``w`` (word), ``b`` (64 bits), 2**20 at most."""
    word, bit = bit_place(key)
    return ids.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))


def bit_place(key):
    place = F.pmod(F.xxhash64(key), F.lit(1 << 26))
    return (F.shiftright(place, 6).cast("int"),
            F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{key}`), 64) as int))"))


def without_ids(docs, ids, key="doc_id"):
    """``docs`` without the rows whose ``key`` is in ``ids``; a null key stays.

    A broadcast bit map of fixed size lets all rows pass that are surely not listed; only the others,
    the listed ones and a few besides, are shuffled for the exact comparison.
    """
    word, bit = bit_place(key)
    map_rows = F.broadcast(bit_map(ids, key).withColumnsRenamed({"w": "__w", "b": "__b"}))
    hit = F.col(f"`{key}`").isNotNull() & (F.coalesce(F.col("__b"), F.lit(0)).bitwiseAND(bit) != 0)
    marked = docs.withColumn("__w", word).join(map_rows, "__w", "left").withColumn("__hit", hit)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    listed = ids.select(F.col(f"`{key}`").alias("__id"))
    doubtful = marked.filter("__hit").join(listed, F.col(f"`{key}`") == F.col("__id"), "left_anti")
    return marked.filter("NOT __hit").select(*columns).unionByName(doubtful.select(*columns))


def give_back():
    """Return memory to the system: Python workers live on, and the next task may need it in the JVM.

    Words that an earlier tokenizing task kept are dropped too; tasks that tokenize don't call this first.
    """
    import ctypes
    import gc

    import pyarrow as pa
    vars(sys.modules.get("tokenizers", gc)).get("_kept_vocabularies", {}).clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)


def tokenizer_path(name):
    import public_tokenizers
    return public_tokenizers.path(name)
