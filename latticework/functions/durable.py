"""Cutting lineage with tables that every executor can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a new local one only in local mode where it is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="latticework-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


#: Folders of the tables that ``written`` has made, in order.
MADE: list[str] = []


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        if path in MADE:
            MADE.remove(path)


def written_at(df: DataFrame) -> tuple[DataFrame, str]:
    """``written``, and the folder, for tables that are to be dropped by ``discard``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    MADE.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back."""
    return written_at(df)[0]


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small table, cleaned by Spark when it is no longer in use."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


class Growing:
    """A table in the shared folder to which rounds add rows; ``table`` reads all that was added so far."""

    def __init__(self, spark: SparkSession, schema: str):
        self.spark, self.schema, self.path = spark, schema, f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
        spark.createDataFrame([], schema).write.parquet(self.path)
        MADE.append(self.path)

    def add(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)
