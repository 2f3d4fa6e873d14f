"""Tables of intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only where that is unset and the master is local, as in tests, a temporary one is made."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="recollect-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/recollect-{name}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df without its lineage, by a reliable checkpoint: for small results that are read several times."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder; with `by`, dealt by that column and sorted by it, so that row groups can be skipped."""
    path = new_path(df.sparkSession, name)
    (df.repartition(by).sortWithinPartitions(by) if by else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
