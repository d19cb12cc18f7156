"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "ragscale", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; the cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for name, value in {**defaults, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. A temporary one only in local mode; elsewhere an unset folder is an error,
    because executors would each write to their own disk."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        path = _LOCAL_DIRS.get(app) or _LOCAL_DIRS.setdefault(app, tempfile.mkdtemp(prefix="ragscale-"))
    return path.rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/ragscale-{spark.sparkContext.applicationId}"


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear_work(spark: SparkSession) -> bool:
    """Remove all intermediates of this application, once no result that reads them is needed any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PATH = "_ragscale_path"


def materialize(df: DataFrame, name: str, block_bytes: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage and pins values that a retry could compute differently. The shuffle files that the write needed
    are removed after it; nothing else reads them. ``block_bytes`` bounds the row groups, of which a reader holds one at a time.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.write if block_bytes is None else df.write.option("parquet.block.size", block_bytes)).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    written = spark.read.schema(df.schema).parquet(path)
    setattr(written, _PATH, path)
    return written


def discard(*written: DataFrame) -> None:
    """Remove tables that ``materialize`` returned, once everything that reads them has been written itself."""
    for df in written:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(getattr(df, _PATH))
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
