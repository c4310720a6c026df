"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset (tests on one machine), a temporary one."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(spark, "_ledgerlens_folder"):
        spark._ledgerlens_folder = "file://" + tempfile.mkdtemp(prefix="ledgerlens-")
    return spark._ledgerlens_folder


class Scratch:
    """Intermediate tables of one run in the shared folder: they cut lineage and survive lost executors.

    Shuffle files of a finished write are released at once, so the disk in use
    is that of one step and of the tables kept. Results are read from these
    tables, so they stay until release() is called.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        spark._ledgerlens_scratch = [*getattr(spark, "_ledgerlens_scratch", []), self.base]

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(setting, "false")
        self.spark.conf.set(setting, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(setting, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        _delete(self.spark, [f"{self.base}/{name}" for name in names])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Deletes all intermediate tables of a session: call it when its results have been read or written."""
    _delete(spark, getattr(spark, "_ledgerlens_scratch", []))
    spark._ledgerlens_scratch = []
