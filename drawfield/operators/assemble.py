"""Long draws to vectors: the wire scan and the assembly of runs."""

from pyspark.sql import functions as F

from drawfield.schema import CELL, MONTH, PREDICTION_PREFIX


def with_declared(draws, headers):
    """Draws with the ``sample_count`` of their shard's header; shards without header are left out."""
    return draws.join(headers.select("run_id", "shard", "sample_count"), ["run_id", "shard"])


def to_vectors(draws, keys=("target", MONTH, CELL), strict=True):
    """``(…keys, sample, value, sample_count)`` rows to one ``draws`` vector per key, placed by ``sample``.

    The vector has ``sample_count`` slots, as the shard's header declares, whatever the rows hold: a draw
    beyond them, or two declarations for one key, is an error. A slot without draw is an error too, or
    NULL if not ``strict``; copies of one draw are an error, or keep the smallest. Draws of a key are
    gathered map-side, so one row per key and task travels; run the gates first, they hold a key's
    rows to ``sample_count``. Sorting and placing take time in proportion to the draws.
    """
    declared = F.col("sample_count")
    inside = F.when((F.col("sample") >= 0) & (F.col("sample") < declared), F.col("sample")).otherwise(
        F.raise_error(F.concat(F.lit("draw "), F.col("sample").cast("string"), F.lit(" of declared "),
                               F.coalesce(declared.cast("string"), F.lit("none")))))
    gathered = draws.groupBy(*keys).agg(
        F.collect_list(F.struct(inside.cast("int").alias("sample"), "value")).alias("rows"),
        F.min(declared).alias("low"), F.max(declared).alias("high"))
    rows = gathered.withColumn("rows", F.array_sort("rows"))
    whole = (F.size("rows") == F.col("high")) & F.forall(
        F.transform("rows", lambda x, i: x["sample"] == i), lambda ok: ok)
    if strict:
        rest = F.raise_error(F.lit("a draw is missing or repeated")).cast(f"array<{_kind(draws)}>")
    else:
        first = F.filter("rows", lambda x, i: (i == 0) | (F.get("rows", i - 1)["sample"] != x["sample"]))
        placed = F.map_from_entries(first)
        rest = F.transform(_upto(F.col("high")), lambda i: F.element_at(placed, i.cast("int")))
    return rows.select(*keys, F.when(F.col("low") != F.col("high"), F.raise_error(F.lit(
        "shards of one cell declare different numbers of draws")).cast(f"array<{_kind(draws)}>"))
        .when(whole, F.transform("rows", lambda x: x["value"])).otherwise(rest).alias("draws"))


def _upto(n):
    """0 to ``n`` - 1; nothing for 0, where a sequence alone would count down."""
    return F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n)


def _kind(draws):
    return draws.schema["value"].dataType.simpleString()


def widen(vectors, targets, keys=(MONTH, CELL)):
    """One row per key with a column per target; at most ``len(targets)`` vectors meet in a group."""
    by_target = vectors.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("target", "draws"))).alias("m"))
    return by_target.select(*keys, *[
        F.element_at("m", t).alias(PREDICTION_PREFIX + t) for t in targets])


def zero_fill(frame, columns):
    """A target absent from a populated row becomes as many zeros as the row's other targets have draws."""
    widths = [F.size(c) for c in columns]
    width = F.greatest(*widths) if len(widths) > 1 else widths[0]
    zeros = F.array_repeat(F.lit(0.0).cast("float"), width)
    return frame.withColumns({c: F.coalesce(F.col(c), zeros) for c in columns})


def assemble_run(draws, headers, sidecar, targets, keys=(MONTH, CELL), strict=True):
    """All shards of a run (or, with ``run_id`` in ``keys``, of many) as a posterior table with geography."""
    vectors = to_vectors(with_declared(draws, headers), ("target", *keys), strict)
    wide = widen(vectors, targets, keys)
    return zero_fill(wide, [PREDICTION_PREFIX + t for t in targets]).join(sidecar, CELL, "left")
