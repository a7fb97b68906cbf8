"""Session helpers: the shared scratch folder and the settings used for local runs."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUNS: dict[str, str] = {}  # by application: the folder that holds its scratch files


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees, as the cluster names it in ``spark.checkpoint.dir``.

    Only when it is unset, as in local tests, a folder of this machine is taken instead.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="foldline-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def _delete(spark: SparkSession, folder: str) -> None:
    jvm = spark.sparkContext._jvm or spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


def _delete_at_exit(spark: SparkSession, folder: str) -> None:
    try:
        _delete(spark, folder)
    except Exception:  # the session may be gone already; the folder's name says whose files these are
        pass


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses. It is deleted when the driver's program ends."""
    run = spark.sparkContext.applicationId
    if run not in _RUNS:
        _RUNS[run] = f"{shared_folder(spark)}/{run}-{uuid.uuid4().hex}"
        atexit.register(_delete_at_exit, spark, _RUNS[run])
    return f"{_RUNS[run]}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: worked out once, and kept if an executor is lost."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_session(cpus: int = 8, app: str = "foldline") -> SparkSession:
    """Session for tests and the local bench."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
