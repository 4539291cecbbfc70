"""Incremental ingest: new run manifests are picked up, gated, and published once."""

import json
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

from drawfield.operators.fused import Placed
from drawfield.schema import MANIFEST_SCHEMA
from drawfield.session import shared_dir
from drawfield.sources.writers import publish_runs

# The state function travels with its tasks, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MANIFESTS_PER_BATCH = 1000   # a backlog is split into batches of this size; nothing is dropped
CONFLICT = "CONFLICT"


def manifest_stream(spark, path):
    """A stream of manifests as they are delivered, one row each."""
    return (spark.readStream.schema(MANIFEST_SCHEMA).option("multiLine", True)
            .option("maxFilesPerTrigger", MANIFESTS_PER_BATCH)
            .option("pathGlobFilter", "*.json").json(path))


def arrival_stream(spark, path, pattern="*.parquet"):
    """``run_id``, ``name``: files as they arrive below ``path``/<run_id>/; their content is not read."""
    files = (spark.readStream.format("binaryFile")
             .schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True)
             .option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 100 * MANIFESTS_PER_BATCH).load(path))
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("run_id"), F.element_at(parts, -1).alias("name"))


def ingest_manifests(manifests, load_runs, base):
    """Gate the runs of one micro-batch together and publish those that are servable in one write.

    ``load_runs(manifests)`` gives the :class:`Run` of all of them. Their draws are scanned once, for the gates and
    for assembly. Only the verdicts, one row per run, come to the driver. Publication is idempotent by run id, so
    a batch repeated after a lost driver changes nothing. Two manifests of one run that differ are both refused.
    """
    text = F.to_json(F.struct(*manifests.columns))
    whole = F.struct(*[c for c in manifests.columns if c != "run_id"])
    told = manifests.groupBy("run_id").agg(F.min_by(whole, text).alias("m"), F.count_distinct(text).alias("versions"))
    conflicts = [r["run_id"] for r in told.filter("versions > 1").select("run_id").collect()]
    manifests = told.filter("versions = 1").select("run_id", "m.*")
    runs = load_runs(manifests)
    placed = Placed(runs, shared_dir(manifests.sparkSession, "ingest"))
    decided = manifests.select("run_id", "targets").join(placed.verdicts().select("run_id", "verdict"), "run_id", "left").collect()
    by_targets = {}
    for row in decided:
        if row["verdict"] == "SERVABLE":
            by_targets.setdefault(tuple(row["targets"]), []).append(row["run_id"])
    for targets, run_ids in by_targets.items():  # runs of one ensemble have the same targets: one write in general
        publish_runs(placed.assemble(list(targets), run_ids), base)
    return {row["run_id"]: row["verdict"] or "NOT SERVABLE" for row in decided} | dict.fromkeys(conflicts, CONFLICT)


def start_ingest(spark, path, load_runs, base, checkpoint):
    """Process everything delivered so far and stop; run it again when more has arrived."""
    return (manifest_stream(spark, path).writeStream
            .foreachBatch(lambda batch, _: ingest_manifests(batch, load_runs, base))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


# --- manifests that wait for their shards ------------------------------------------------

STATE = "manifest string, arrived array<string>, outcome string, deadline long"
OUTCOME = "run_id string, outcome string, manifest string, missing array<string>"


def waiting_runs(manifests, arrivals, wait_ms):
    """``run_id``, ``outcome``, ``manifest`` (JSON), ``missing``: what became of each manifest, told as it is known.

    manifests: a stream of manifests; arrivals: a stream of ``run_id``, ``name``. A run is ``complete`` once all files
    its manifest lists have arrived, in whatever order; ``late`` once ``wait_ms`` of processing time passed since its
    manifest came (a run that gets complete afterwards is told again); ``conflict`` once a second, different manifest
    came, and then nothing more. The state of a run is its manifest and the names that arrived.
    """
    told = manifests.select("run_id", F.lit("manifest").alias("kind"), F.to_json(F.struct(*manifests.columns)).alias("body"))
    came = arrivals.select("run_id", F.lit("file").alias("kind"), F.col("name").alias("body"))

    def step(key, frames, state):
        manifest, arrived, outcome, deadline = state.get if state.exists else (None, [], None, None)
        arrived, before, timed_out = set(arrived), outcome, state.hasTimedOut
        if not timed_out:
            for frame in frames:
                for kind, body in zip(frame["kind"], frame["body"]):
                    if kind == "file":
                        arrived.add(body)
                    elif manifest is None:
                        manifest = body
                    elif body != manifest:
                        outcome = "conflict"
        missing = []
        if manifest is not None and outcome != "conflict":
            if deadline is None:
                deadline = state.getCurrentProcessingTimeMs() + wait_ms
            run = json.loads(manifest)
            names = [s.get("name") for s in run.get("shards") or []] + [(run.get("sidecar") or {}).get("name")]
            missing = sorted({n for n in names if n} - arrived)
            if not missing:
                outcome = "complete"
            elif outcome is None and state.getCurrentProcessingTimeMs() >= deadline:
                outcome = "late"
        state.update((manifest, sorted(arrived), outcome, deadline))
        if manifest is not None and outcome is None:
            state.setTimeoutDuration(max(1, deadline - state.getCurrentProcessingTimeMs()))
        if outcome != before:
            yield pd.DataFrame({"run_id": [key[0]], "outcome": [outcome], "manifest": [manifest], "missing": [missing]})

    return told.unionByName(came).groupBy("run_id").applyInPandasWithState(step, OUTCOME, STATE, "append", "ProcessingTimeTimeout")


def run_waiting(outcomes, load_runs, base, checkpoint, seen=None, **trigger):
    """Publish the runs of a stream of :func:`waiting_runs` as they get complete.

    ``seen`` is called with what became known in a batch, by run id: a gate verdict, ``late`` or ``conflict``.
    """
    def batch(rows, _):
        rows = rows.persist()  # the state function runs once
        try:
            known = {r["run_id"]: r["outcome"] for r in rows.select("run_id", "outcome").collect()}  # a row per run
            if "complete" in known.values():
                complete = rows.filter("outcome = 'complete'").select(F.from_json("manifest", MANIFEST_SCHEMA).alias("m")).select("m.*")
                known |= ingest_manifests(complete, load_runs, base)
            if seen is not None and known:
                seen(known)
        finally:
            rows.unpersist()

    return (outcomes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "1 second"})).start())


def start_waiting_ingest(spark, manifests, arrivals, load_runs, base, checkpoint, wait_ms, seen=None, **trigger):
    """Ingest runs once their files are there: ``manifests`` and ``arrivals`` are the paths both are delivered to."""
    stream = waiting_runs(manifest_stream(spark, manifests), arrival_stream(spark, arrivals), wait_ms)
    return run_waiting(stream, load_runs, base, checkpoint, seen, **trigger)
