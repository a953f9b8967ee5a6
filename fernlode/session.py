"""Session helpers: a local session for tests and the folder that all executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fernlode")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", os.environ.get("FERNLODE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder of spark.checkpoint.dir. Where that is unset, a local session gets a local one; on a
    cluster a folder of one machine would not do, so there the setting is asked for."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    own = context._jsc.sc().getCheckpointDir()
    if not path:
        if own.isDefined():
            path = own.get()
        elif context.master.split("[")[0] == "local":
            path = f"file:///tmp/fernlode-shared-{os.getuid()}"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not own.isDefined():
        context.setCheckpointDir(path)
    return path.rstrip("/")


def _tables(spark: SparkSession) -> str:
    """Where this application's intermediate tables lie."""
    return f"{shared_dir(spark)}/fernlode-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to a table in the shared folder and read it again.

    Cuts the lineage, is computed once however often it is read, and survives the loss of
    executors. The folder has a fresh name for each call; release() removes all of them.
    """
    spark = df.sparkSession
    path = f"{_tables(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Removes this application's intermediate tables; results that were not yet computed lose what they rest on."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, if they see that path."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
