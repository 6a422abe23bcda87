"""Session helpers.

The library never creates a session on its own inside operators; jobs receive one.
``get_session`` is for tests, the benchmark and local runs.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "textlens") -> SparkSession:
    master = master or os.environ.get("TEXTLENS_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TEXTLENS_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    share_package(spark)
    return spark


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, whatever their
    working folder. (On a cluster without a shared source folder it is installed or sent
    with the job, as any package.)"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only when the setting is absent and the master is local (tests), a fresh scratch folder
    is taken; on a cluster a missing setting is an error, as executors could not read each
    other's tables from a machine-local folder."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        local = tempfile.mkdtemp(prefix="textlens-ckpt-", dir="/tmp")
        sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


#: Whether a job's shuffle files go at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_WRITTEN: list[str] = []  # tables that stay until the application ends
_SCOPE = threading.local()  # ``paths``: those of the enclosing ``scratch_tables`` of a thread


def table_scope() -> list[str]:
    """Where the tables that this thread materialises now are listed: the enclosing
    ``scratch_tables``, else the application."""
    paths = getattr(_SCOPE, "paths", None)
    return _WRITTEN if paths is None else paths


def materialize(df, scope: list[str] | None = None):
    """Cut the lineage of ``df`` by writing it as a parquet table under the cluster's
    shared checkpoint folder (``spark.checkpoint.dir``) and reading it back.

    Used where a result feeds several later branches (the fitted LM, pair probabilities),
    so they scan it instead of re-running its plan, and a lost executor costs a re-read, not
    a recomputation. One job computes and writes the table (an RDD checkpoint would run the
    plan twice unless cached). Its shuffle files go with it, not when the driver happens to
    collect garbage. Tables go when ``scratch_tables`` ends, or with the application.
    ``scope``: an outer ``table_scope`` that the table shall last as long as."""
    spark = df.sparkSession
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/textlens-tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    paths = table_scope() if scope is None else scope
    if paths is _WRITTEN and not _WRITTEN:
        atexit.register(drop_tables, spark, _WRITTEN)
    paths.append(path)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.parquet(path)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that ``materialize`` has written, and forget their paths."""
    if spark.sparkContext._jsc is None:  # the application is over
        return
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def scratch_tables(spark: SparkSession):
    """Tables that this thread materialises inside go at its end: for work whose result is
    written inside, such as a micro-batch or a job."""
    outer = getattr(_SCOPE, "paths", None)
    _SCOPE.paths = own = []
    try:
        yield
    finally:
        _SCOPE.paths = outer
        drop_tables(spark, own)
