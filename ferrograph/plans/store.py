"""Tables written to the shared folder, to cut the lineage of loops; and the package sent to the executors."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ferrograph.errors import ConfigError

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, so that their Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp()
        staged = Path(folder, "staged")
        shutil.copytree(package, staged / package.name, ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(f"{folder}/{package.name}-package", "zip", staged))
        shutil.rmtree(staged)
        _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. A temporary one stands in for it in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ConfigError("spark.checkpoint.dir must name a folder that all executors share", master=spark.sparkContext.master)
        folder = f"{tempfile.gettempdir()}/checkpoints"
    return folder.rstrip("/")


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/table-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder, and read back."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    forget_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Have a written folder deleted when the driver ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def forget(df: DataFrame) -> None:
    """Delete a saved table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._saved_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
