"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on. AQE re-plans joins and coalesces shuffle
# partitions at runtime; skew-join splitting protects against a single hot
# station/year holding a large share of the rows.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def get_session(master: str | None = None, app_name: str = "stratus",
                shuffle_partitions: int | None = None,
                extra_conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must name a folder that every executor shares
    and is used as is. Only a local master, where there is one machine, gets
    a private folder when it is unset; any other master raises.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(
                f"spark.checkpoint.dir is unset: with master {master} it must name a folder "
                "that the driver and every executor share")
        current = tempfile.mkdtemp(prefix="stratus-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
        atexit.register(_clean_at_exit, spark)
    return current


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Operators that run Python on the executors import it there; a cluster
    whose executors have it installed, or get it by ``--py-files``, does not
    need this.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="stratus-ship-")
    archive = shutil.make_archive(os.path.join(folder, "stratus"), "zip", os.path.dirname(package),
                                  os.path.basename(package))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def scratch_root(spark: SparkSession) -> str:
    """This application's own folder inside the shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/stratus-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder for staged writes."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def clean_scratch(spark: SparkSession) -> None:
    """Delete everything this application has staged.

    Frames that read staged tables are void afterwards: call it when the
    results have been written or collected. It also runs when the program ends.
    """
    from .sources import files
    files.delete(spark, scratch_root(spark))


def _clean_at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have ended already
        clean_scratch(spark)


def materialize(df, label: str = "stage"):
    """Write ``df`` as Parquet under the shared checkpoint folder and return
    a frame that reads it back.

    Used for small intermediates that several branches of a plan read
    (per-value counts, station-year aggregates): the large input behind them
    is scanned once instead of once per branch, the lineage is cut (a lost
    executor re-reads files), and the written files give the optimizer a
    real size for its broadcast decisions. Unlike ``checkpoint()`` the plan
    is computed once (an RDD checkpoint re-runs it to write the files).
    ``clean_scratch`` removes the files.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
