"""Tables that cut lineage: written to the folder that all machines share, and reread."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or what setCheckpointDir() was given; a local session without either gets a temporary one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    held = context._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="rastrel-"))
        held = context._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


class Written:
    """Tables of one computation, in a folder of their own; each is computed once. What is no longer read can go."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.count = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0

    def put(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, back: int) -> None:
        """Removes the table that was put `back` tables before the last one."""
        if self.count - back > 0:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{self.count - back}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
