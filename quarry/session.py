"""Session construction and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, partitions: int | None = None, app: str = "quarry") -> SparkSession:
    """A session for tests, benches and local runs.

    On a cluster, build the session with the cluster's own settings instead; nothing in the
    library depends on these values beyond AQE being on.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    partitions = partitions or int(cpus)
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@cache
def _local_folder() -> str:
    """One temporary folder for a local session, removed when the process ends."""
    folder = tempfile.TemporaryDirectory(prefix="quarry-ckpt-", ignore_cleanup_errors=True)
    _KEPT.append(folder)
    return folder.name


_KEPT: list[tempfile.TemporaryDirectory] = []


def scratch_dir(spark: SparkSession, name: str | None = None) -> str:
    """A fresh folder under the cluster's shared checkpoint location.

    The location comes from ``spark.checkpoint.dir`` (or the context's checkpoint dir). Only
    when neither is set *and* the master is local, as in a bare test session, is a local
    temporary folder chosen and installed as the checkpoint dir; on a cluster that is an
    error, since a node-local folder would not survive the loss of that node.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        try:
            sc = spark.sparkContext
        except Exception as e:  # noqa: BLE001 - e.g. a Spark Connect session has no context
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster") from e
        base = sc.getCheckpointDir()
        if not base:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
            base = _local_folder()
            sc.setCheckpointDir(base)
    base = base.rstrip("/")
    return f"{base}/quarry/{name or 'run'}-{uuid.uuid4().hex[:12]}"


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a small input over all cores when its scan yields fewer splits than
    cores (a single Parquet row group or a small text file is one task).

    Inputs with at least as many splits as cores, i.e. every large input, come back as they
    are, and so does everything but a plain scan: counting another plan's partitions could
    run its shuffles.
    """
    try:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        if any(word in plan for word in ("Aggregate", "Join", "Window", "Sort", "Repartition", "Distinct", "Limit", "Union")):
            return df
        want = df.sparkSession.sparkContext.defaultParallelism
        have = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD view (e.g. Spark Connect): leave the plan as is
        return df
    return df if have >= want else df.repartition(want)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint()`` usable: keep the cluster's ``spark.checkpoint.dir``;
    only when none is set (a bare local session) install a scratch folder."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - no context (Spark Connect): the server's setting applies
        return
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(scratch_dir(spark, "ckpt"))
