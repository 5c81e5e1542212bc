"""Session helpers: the settings every plan in this package relies on.

Operators never create a session; they take DataFrames. These helpers are
for tests, the bench and command-line use.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the package depends on for correct results (UTC wall clock, so
# naive timestamps keep their hour) and for scale (AQE re-plans joins and
# coalesces / splits skewed shuffle partitions at runtime).
HUGE_METHOD = ("spark.sql.codegen.hugeMethodLimit", "8000")  # bytes of a method that HotSpot still compiles
BASE_CONF = {
    HUGE_METHOD[0]: HUGE_METHOD[1],
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoints of materialised intermediates are removed once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "gridcast", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the package settings.

    ``spark.checkpoint.dir`` is left to the cluster; only when nothing names
    it (local runs, tests) a fresh scratch folder is made for it.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    if master and master.startswith("local"):
        # Local mode: the driver JVM is the only executor.
        b = b.config("spark.driver.memory", conf.get("spark.driver.memory", "12g"))
    if master and master.startswith("local") and "spark.checkpoint.dir" not in conf:
        b = b.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="gridcast-ckpt-"))
        b = b.config("spark.driver.host", "127.0.0.1")
        b = b.config("spark.driver.bindAddress", "127.0.0.1")
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and written intermediate tables.

    Reads the session's ``spark.checkpoint.dir`` (or the context's checkpoint
    dir).  Only a local-mode session that names none gets a fresh scratch
    folder; on a cluster a machine-local folder is not safe, so an unset
    setting is an error there."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        d = tempfile.mkdtemp(prefix="gridcast-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def materialize(df):
    """Cut lineage with a reliable checkpoint into the shared checkpoint
    folder (eager).  Used where a plan is read twice (two-pass operators) so
    the expensive part is computed once and survives executor loss."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique sub-folder of the checkpoint dir for a written table."""
    import uuid
    return os.path.join(checkpoint_dir(spark).rstrip("/"), f"{name}-{uuid.uuid4().hex[:12]}")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder of our own through Hadoop's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def kept(df, *paths: str):
    """``df`` as a checkpointed table, with the scratch folders it was read
    from deleted: nothing written on the way stays behind."""
    out = materialize(df)
    for p in paths:
        drop_path(df.sparkSession, p)
    return out
