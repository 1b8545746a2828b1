"""Session construction and the shared folder for lineage cuts.

On a cluster the shared folder is whatever ``spark.checkpoint.dir`` names;
the library only falls back to a local scratch folder for a ``local[...]``
session without that setting (unit tests, a laptop).
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings the library's results depend on (exact decimals, UTC calendar
# days) and the adaptive execution it relies on for skew and join choice.
# Applied only where the job submission has not set them.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
# Extra defaults for a single-machine ``local[...]`` session (tests, bench).
# A cluster sizes its own shuffle partitions (with AQE coalescing, start
# high: thousands for tens of terabytes) and keeps its own UI policy.
LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.shuffle.partitions": "8",
}


def _is_local(master: str | None) -> bool:
    return bool(master) and master.startswith("local")


def defaults_to_apply(master: str | None, submitted) -> dict:
    """The library defaults a new session gets: session defaults always,
    local ones only for a ``local[...]`` master, and none that the job
    submission (``submitted``, a ``SparkConf``) already sets."""
    defaults = {**SESSION_DEFAULTS, **(LOCAL_DEFAULTS if _is_local(master) else {})}
    return {k: v for k, v in defaults.items() if not submitted.contains(k)}


def get_session(master: str | None = None, app_name: str = "parcelscope",
                extra: dict | None = None) -> SparkSession:
    """Session for the library.  Defaults never override a value the job
    submission (``--conf`` / ``spark-defaults.conf``) already set; ``extra``
    is applied as given."""
    from pyspark import SparkConf
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in defaults_to_apply(master, SparkConf()).items():
        builder = builder.config(k, v)
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder: ``spark.checkpoint.dir`` as the cluster
    names it.  Only a local-mode session without one gets a scratch folder;
    a cluster session without one is an error (a machine-local folder would
    not be shared by the executors)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not _is_local(sc.master):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder shared by all "
                               "executors (e.g. on the cluster file system)")
        configured = tempfile.mkdtemp(prefix="parcelscope-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def shared_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, the same for every
    session of the cluster (a checkpoint folder is one session's own); a
    local session without the setting has its own scratch folder."""
    own = ensure_checkpoint_dir(spark)
    return (spark.conf.get("spark.checkpoint.dir", None) or own).rstrip("/")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A path under the cluster-wide checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([base, "parcelscope", *parts])
