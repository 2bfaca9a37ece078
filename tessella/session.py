"""Session defaults and lineage cuts that survive the loss of executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "tessella", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this library's defaults; keyword settings use `__` for dots."""
    builder = SparkSession.builder.appName(app).config(map=DEFAULTS)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by spark.checkpoint.dir; where it is unset, one beside the warehouse.

    The warehouse is shared between the driver and the executors, a machine's own temporary
    folder is not.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and go on from the files: no lineage, no lost blocks."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
