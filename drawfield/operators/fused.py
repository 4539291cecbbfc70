"""Gates and assembly from one scan of the draws.

Delivered shards are cell-major: a cell's draws lie side by side. So a task places the draws of each
(shard, cell) with numpy as they come and writes one *piece* for it: the vector if draws 0..n-1 are all there, each
once, else its draws one by one. The pieces are stored; nothing reads the draws again.

* The gates read the pieces' keys and counts, not the vectors.
* A cell that lies on the edge of two tasks (or comes twice, or out of place) has several pieces. Only those are
  taken apart, shuffled and placed anew; all other vectors stay where they are until their targets meet in one row.
"""

import sys
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import functions as F

from drawfield.operators import gates
from drawfield.operators.assemble import to_vectors, widen, zero_fill
from drawfield.schema import CELL, MONTH, PREDICTION_PREFIX

# The functions travel with their tasks, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEYS = ("run_id", "shard", "target", MONTH, CELL)
CHUNK = 1 << 17
PIECES = f"run_id string, shard string, target string, {MONTH} int, {CELL} long, rows long, implausible long, draws array<%s>, loose array<struct<sample:int,value:%s>>"


def _lists(values, sizes):
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values)


def _groups(table):
    """For each row the number of its key, in the order in which keys come where no key is interrupted."""
    codes = [pc.dictionary_encode(table[k].combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
             for k in KEYS]
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for code in codes:
        new[1:] |= code[1:] != code[:-1]
    starts = np.flatnonzero(new)
    number = np.zeros(len(starts), np.int64)
    for code in codes:
        number = np.unique(number * (code.max() + 1) + code[starts], return_inverse=True)[1]
    if len(starts) == number.max() + 1:
        number = np.arange(len(starts))
    return np.repeat(number, np.diff(np.append(starts, table.num_rows)))


def _pieces(table, group, value_kind):
    """One row per key: whole vectors first, then the others."""
    sample = pc.fill_null(table["sample"].combine_chunks().cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
    size = np.bincount(group)
    size, group = size[size > 0], np.unique(group, return_inverse=True)[1]
    starts = np.cumsum(size) - size
    place = np.arange(len(sample)) - np.repeat(starts, size)
    order = np.arange(len(sample))
    if (np.diff(group) < 0).any() or (sample != place).any():
        order = np.lexsort((sample, group))
        sample = sample[order]
    value = table["value"].combine_chunks().to_numpy(zero_copy_only=False)[order]
    bad = ~((value >= 0) & np.isfinite(value))  # a missing draw is NaN here
    whole = np.logical_and.reduceat(sample == place, starts)
    loose_kind = pa.struct([("sample", pa.int32()), ("value", value_kind)])
    for some, is_whole in ((np.flatnonzero(whole), True), (np.flatnonzero(~whole), False)):
        if not len(some):
            continue
        rows = np.flatnonzero(np.repeat(whole == is_whole, size))
        keys = [table[k].combine_chunks().take(pa.array(order[starts[some]])) for k in KEYS]
        values = table["value"].combine_chunks().take(pa.array(order[rows])).cast(value_kind)
        if is_whole:
            draws, loose = _lists(values, size[some]), pa.nulls(len(some), pa.list_(loose_kind))
        else:
            entries = pa.StructArray.from_arrays([pa.array(sample[rows], pa.int32()), values], fields=list(loose_kind))
            draws, loose = pa.nulls(len(some), pa.list_(value_kind)), _lists(entries, size[some])
        number = np.add.reduceat(bad[rows].astype(np.int64), np.cumsum(size[some]) - size[some])
        yield pa.RecordBatch.from_arrays([*keys, pa.array(size[some]), pa.array(number), draws, loose],
                                         names=[*KEYS, "rows", "implausible", "draws", "loose"])


def place(draws):
    """The pieces of ``draws``: ``run_id, shard, target, month_id, priogrid_id, rows, implausible, draws, loose``. No shuffle.

    Keys of the last batch are held over to the next ``CHUNK`` rows, so a key is cut only where a task ends or where its
    rows lie far apart.
    """
    kind = draws.schema["value"].dataType.simpleString()
    value_kind = {"float": pa.float32(), "double": pa.float64()}.get(kind)
    if value_kind is None:
        raise ValueError(f"draws are float or double, got {kind}")

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows < CHUNK:
                continue
            table = pa.concat_tables(held)
            group = _groups(table)
            going_on = np.zeros(group.max() + 1, bool)
            going_on[group[-batch.num_rows:]] = True
            later = going_on[group]
            if 2 * later.sum() > len(later):
                later[:] = False
            if not later.all():
                yield from _pieces(table.filter(pa.array(~later)), group[~later], value_kind)
            held = [table.filter(pa.array(later))] if later.any() else []
            rows = int(later.sum())
        if rows:
            table = pa.concat_tables(held)
            yield from _pieces(table, _groups(table), value_kind)

    columns = [F.col("run_id").cast("string"), F.col("shard").cast("string"), F.col("target").cast("string"),
               F.col(MONTH).cast("int"), F.col(CELL).cast("long"), F.col("sample").cast("int"), "value"]
    return draws.select(*columns).mapInArrow(run, PIECES % (kind, kind))


class Placed:
    """The stored pieces of delivered runs, with what gates and assembly read of them."""

    def __init__(self, run, path):
        spark = run.draws.sparkSession
        place(run.draws).write.parquet(f"{path}/pieces")
        self.run, self.pieces = run, spark.read.parquet(f"{path}/pieces")
        # Which pieces are whole is told by the vector's presence; only its null mark is read.
        counted = self.pieces.select(*KEYS, "rows", "implausible", F.col("draws").isNotNull().alias("whole")).groupBy(*KEYS).agg(
            F.count("*").alias("pieces"), F.sum("rows").alias("rows"), F.sum("implausible").alias("implausible"),
            F.bool_and("whole").alias("whole"))
        counted.write.parquet(f"{path}/counted")
        self.counted = spark.read.parquet(f"{path}/counted")
        self.counted.filter("pieces > 1").select(*KEYS).write.parquet(f"{path}/split")
        #: Keys with several pieces: their size is known, so that joins with them are planned by it.
        self.split = spark.read.parquet(f"{path}/split")

    def _by_split(self, how):
        """The pieces of split keys (``left_semi``) or of all others (``left_anti``); nulls in keys are equal."""
        same = [F.col(f"p.{k}").eqNullSafe(F.col(f"s.{k}")) for k in KEYS]
        return self.pieces.alias("p").join(self.split.alias("s"), reduce(and_, same), how)

    def split_draws(self):
        """The draws of split cells, one by one."""
        some = self._by_split("left_semi")
        whole = some.filter("draws IS NOT NULL").select(*KEYS, F.posexplode("draws").alias("sample", "value"))
        loose = some.filter("draws IS NULL").select(*KEYS, F.inline("loose"))
        return whole.unionByName(loose)

    def profile(self):
        """What ``gates.cell_profile`` gives, from counts; only split cells are profiled by their draws."""
        single = self.counted.filter("pieces = 1").select(*KEYS, "rows", F.col("whole").alias("ordered"), "implausible")
        several = gates.cell_profile(gates.Run(self.split_draws(), self.run.headers, self.run.manifest, self.run.sidecar))
        return single.unionByName(several)

    def gate_rows(self):
        return gates.gate_rows(self.run, self.profile())

    def verdicts(self):
        return gates.verdict(gates.evaluated(self.gate_rows()))

    def whole_runs(self):
        """``run_id`` of the runs whose draws pass ``gates.WHOLE``: what assembly needs, whatever else is wrong with a run."""
        return (self.gate_rows().filter(F.col("gate").isin(*gates.WHOLE)).groupBy("run_id")
                .agg(F.bool_and("passed").alias("whole")).filter("whole").select("run_id"))

    def vectors(self, keys=("run_id", "target", MONTH, CELL), run_ids=None):
        """Vectors of the listed shards (of some runs), as ``assemble.to_vectors`` places them.

        A vector in one piece must have as many draws as its shard declares; it is not shuffled.
        """
        listed = gates.manifest_shards(self.run.manifest).select("run_id", "shard").distinct()
        declared = self.run.headers.select("run_id", "shard", "sample_count").join(listed, ["run_id", "shard"])
        if run_ids is not None:
            declared = declared.filter(F.col("run_id").isin(list(run_ids)))
        single = self._by_split("left_anti").join(declared, ["run_id", "shard"])
        kind = self.pieces.schema["draws"].dataType.simpleString()
        whole = F.when(F.col("draws").isNotNull() & (F.col("rows") == F.col("sample_count")), F.col("draws")).otherwise(
            F.raise_error(F.lit("a draw is missing or repeated, or not declared")).cast(kind))
        single = single.select(*keys, whole.alias("draws"))
        rest = to_vectors(self.split_draws().join(declared, ["run_id", "shard"]), keys)
        return single.unionByName(rest)

    def assemble(self, targets, run_ids=None, keys=("run_id", MONTH, CELL)):
        """The runs as posterior tables with geography: the vectors of a cell's targets meet here, in their only shuffle."""
        wide = widen(self.vectors(("target", *keys), run_ids), targets, keys)
        return zero_fill(wide, [PREDICTION_PREFIX + t for t in targets]).join(self.run.sidecar, CELL, "left")
