"""SparkSession with the settings that the library expects."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(name: str = "turnstone", **more: str) -> SparkSession:
    return SparkSession.builder.appName(name).config(map=SETTINGS | more).getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the folder in spark.checkpoint.dir, with their lineage cut.

    Only where that is unset and driver and executors are one process a temporary folder is made and set.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="turnstone-")
        spark.sparkContext.setCheckpointDir(base)
    return df.checkpoint()
