"""Session settings and the cutting of lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = 8, memory: str = "8g", app: str = "vicinage") -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in (DEFAULTS | {"spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(cpus)}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a session that runs inside one JVM (``local[...]``) may fall back to a
    temporary folder; on a cluster an unset folder is an error, as executors
    could not read each other's files.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current is None:
        if named is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir is unset; it must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="vicinage-checkpoint-")
        context.setCheckpointDir(named)
        current = context.getCheckpointDir()
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there.

    The files outlive executors, so a lost one costs a read and no recomputation.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
