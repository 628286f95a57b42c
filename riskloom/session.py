"""Session helper, and the one way this library cuts lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only on one machine, where the session names no shared folder (tests).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def get_spark(app: str = "riskloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` wins over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    return builder.config(map=defaults | conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and every executor share; on a cluster the session has to name it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (folder or LOCAL_CHECKPOINTS).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` into the shared checkpoint folder and read it again.

    The result no longer depends on executors that may be lost, is computed once, and has exact file
    sizes, from which the planner decides whether it is small enough to broadcast.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/riskloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
