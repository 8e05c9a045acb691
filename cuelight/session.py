"""Session helpers and the one place where lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


#: the temporary folder of each local application without a named one
_LOCAL: dict[str, str] = {}


def local_session(cpus: str = "*", name: str = "cuelight", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a temporary one in local mode without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    app = spark.sparkContext.applicationId
    if spark.sparkContext.master.startswith("local"):
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        return _LOCAL[app]
    raise RuntimeError("set spark.checkpoint.dir to a shared folder")


def reliable(df: DataFrame) -> DataFrame:
    """``df`` written to a reliable checkpoint and read back, so that it survives lost executors."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
