"""Session settings the library is planned for, and the shared scratch folder."""

import tempfile
import uuid

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The geography of the whole half-degree globe (259,200 cells) stays below this, a finer
    # grid does not: Catalyst and AQE compare the size and shuffle the join beyond it.
    "spark.sql.autoBroadcastJoinThreshold": "64MB",
    # Vectors decode to many times their compressed size: smaller splits keep a task's memory low.
    "spark.sql.files.maxPartitionBytes": "64MB",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def configure(builder):
    """Apply the settings to a session builder."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def shared_dir(spark, purpose):
    """A fresh path below the cluster's shared folder, ``spark.checkpoint.dir``.

    Without that setting the folder lies on the cluster's default file system. If that is the local disk,
    only a session of one machine may use it; others would write where no other machine can read.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        store = spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        local = store.startswith("file:")
        if local and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.gettempdir() + "/drawfield" if local else f"{store.rstrip('/')}/tmp/drawfield"
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
