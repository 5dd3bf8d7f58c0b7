"""Session settings the operators rely on, and lineage cutting."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings an operator result depends on (time zone) or that the plans assume (AQE).
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Parsing a name costs far more than its bytes suggest: keep small shuffles parallel.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128KB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows may be whole pages: a batch that Python holds is bounded by its bytes, not by its rows alone.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4MB",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the session settings to a session somebody else created."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    A cluster names a shared folder in ``spark.checkpoint.dir``. Only a local
    session (tests) may fall back to a temporary folder of this machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current is not None:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors, unlike a local checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_FOLDERS: set[str] = set()


def _remove(spark: SparkSession, folder: str) -> None:
    """Delete the intermediate tables of an application when it ends."""
    with contextlib.suppress(Exception):  # the JVM may be gone
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate that several branches read, and read it back.

    A Parquet table in the shared folder is columnar, survives lost executors
    and gives the planner real sizes to choose join strategies from.
    """
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_remove, spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
