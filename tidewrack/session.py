"""Session settings and durable intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every job relies on (UTC, adaptive execution)."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to Python workers, for sessions whose workers do not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_tidewrack_shipped", None) == context.applicationId:
        return
    package = Path(__file__).resolve().parent
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="tidewrack-")), "tidewrack.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(target)
    context._tidewrack_shipped = context.applicationId


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir``, as the cluster sets it.

    Only a session of one process may fall back to a temporary folder; elsewhere an
    unset folder is an error, since executors would not share it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewrack-"))
    return spark.sparkContext.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the stored table.

    Used where a plan is read several times and must give the same rows each
    time (range partition numbers, iteration rounds). The table outlives lost
    executors, and later passes read only the columns they need.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``durable`` returned, once all that was built on them is stored."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def local_session(name: str = "tidewrack", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests, benchmarks and notebooks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return prepare(spark)


def with_instants(df: DataFrame) -> DataFrame:
    """Cast zone-less timestamp columns to instants; watermarks and epoch functions need them."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp").alias(f.name)
            if isinstance(f.dataType, T.TimestampNTZType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return with_instants(spark.read.parquet(f"{folder}/{name}.parquet"))
