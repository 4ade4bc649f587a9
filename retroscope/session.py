"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "retroscope", **extra: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# folders of local sessions that name none: the setting itself is fixed once a session runs
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that survives the loss of an executor.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session that names
    none gets a temporary folder of its own, which goes when Python ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = os.environ.get("RETROSCOPE_SCRATCH") or tempfile.mkdtemp(prefix="retroscope-")
        if not os.environ.get("RETROSCOPE_SCRATCH"):
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the plan starts afresh there
    and a lost executor costs a re-read, not a re-run of the loop so far."""
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove what ``cut_lineage`` wrote for these frames; nothing may be left that still reads them."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
