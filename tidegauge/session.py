"""Session settings and durable lineage cuts.

Iterative and order-sensitive operators need a result that is computed once and
then read many times. Executors may be lost at any moment, so such results are
written as parquet under the shared folder the session names in
``spark.checkpoint.dir``; a machine-local folder is used only on ``local``
masters, where driver and executors share one disk anyway.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app_name: str = "tidegauge", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # Wide contract expressions: methods the JVM would refuse to compile fall back to split projections.
        "spark.sql.codegen.hugeMethodLimit": "8000",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> None:
    """Instants are compared and bucketed in UTC everywhere."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for durable intermediates."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidegauge-"))
    return spark.sparkContext.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The result has no lineage to the inputs, survives executor loss and carries
    real file sizes, so later joins can choose a strategy from them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidegauge/{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Hint a broadcast only when a count proves the side is small.

    Beyond ``max_rows`` the frame is returned unhinted and the join shuffles.
    """
    counted = df.limit(max_rows + 1).count()
    return F.broadcast(df) if counted <= max_rows else df
