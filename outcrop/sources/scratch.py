"""Tables in the folder that driver and executors share, written to cut lineage or to keep an index."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or one of our own where that is unset and all runs on one machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='outcrop-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """A table can be dropped as soon as a later one replaces it; the shuffle files of what is saved are deleted once it is."""

    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at, self.count = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.at}/{self.count}"
        before = self.spark.conf.get(self.CLEANUP, "false")
        self.spark.conf.set(self.CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(self.CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)  # type: ignore[attr-defined]
            path.getFileSystem(conf).delete(path, True)

    def drop_all_but(self, *frames: DataFrame) -> None:
        """Drops every table saved here that isn't one of these."""
        keep = {df._scratch_path for df in frames}  # type: ignore[attr-defined]
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.at).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for k in range(1, self.count + 1):
            if (at := f"{self.at}/{k}") not in keep:
                fs.delete(path(at), True)
