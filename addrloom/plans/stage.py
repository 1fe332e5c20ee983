"""Stage boundaries: a frame written once to the shared folder and read back, where several later steps use it."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own(app: str) -> str:
    """A local folder for one application."""
    return "file://" + tempfile.mkdtemp(prefix="addrloom-")


def shared(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where that is unset, a local one in local mode, an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _own(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/addrloom"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the plan and survives lost executors."""
    path = f"{shared(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)
