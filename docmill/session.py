"""SparkSession construction and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter for every docmill plan. AQE re-plans joins and
# coalesces/splits shuffle partitions at runtime (skew join included), so the
# static shuffle-partition count only needs to be in the right range.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "docmill", extra: dict | None = None) -> SparkSession:
    """Return the active session or build one with docmill defaults.

    On a cluster the session already exists (spark-submit) and its settings
    win; locally (tests, bench) we build a ``local[*]`` session.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        ship_package(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``docmill`` importable in Python workers (Arrow kernels, the HTML
    parser) when the session was not started with ``--py-files``: the package
    is zipped on the driver and added with ``addPyFile`` (Spark distributes
    it). Done once per SparkContext."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    if sc.getConf().get("spark.submit.pyFiles", ""):
        # deployed with spark-submit --py-files: the executors already have it
        _SHIPPED.add(key)
        return
    import shutil
    pkg_root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = tempfile.mkdtemp(prefix="docmill-pyfiles-")
    archive = shutil.make_archive(os.path.join(out, "docmill"), "zip", pkg_root, "docmill")
    sc.addPyFile(archive)
    _SHIPPED.add(key)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cutting lineage.

    Reads ``spark.checkpoint.dir`` from the session (set by the cluster). Only
    when it is unset and the master is local -- tests -- a scratch folder is
    created and registered; on a cluster an unset folder is an error, so
    executors never get a machine-local path.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="docmill-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return local


_WRITTEN: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a derived table of this application."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/docmill-{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove_scratch(spark: SparkSession) -> int:
    """Delete the tables that this application wrote at ``scratch_path``s, with
    whatever file system they are on. Call it when no result that reads them is
    needed any more; returns how many were there."""
    return sum(_delete(spark, path) for path in _WRITTEN.pop(spark.sparkContext.applicationId, []))


def remove_path(spark: SparkSession, path: str) -> bool:
    """Delete one ``scratch_path`` that nothing reads any more (a stream's batches
    would add up otherwise)."""
    _WRITTEN.get(spark.sparkContext.applicationId, [path]).remove(path)
    return _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True))
