"""Derived tables that are built once and found again: in the shared folder, under a name that the state of their sources gives."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import shared_dir

DONE = "_COMPLETE"


def stamp(*sources: DataFrame) -> str:
    """A digest of the files that tables are read from: paths, sizes, times of change. No column of theirs is read."""
    out = []
    for df in sources:
        file = F.col("_metadata")
        files = df.select(file["file_path"].alias("p"), file["file_size"].alias("s"), file["file_modification_time"].alias("t")).distinct()
        hashed = F.xxhash64("p", "s", "t").bitwiseAND(F.lit((1 << 40) - 1))
        out.append("-".join(str(x or 0) for x in files.agg(F.count(F.lit(1)), F.sum(hashed)).first()))
    return "_".join(out)


def stored(spark: SparkSession, name: str, sources: list[DataFrame], build: Callable[[str], None]) -> str:
    """The folder of a derived table: made by build(folder) unless there already is one of these sources. It gets its name when it is complete, so
    a build that fails or loses its driver leaves nothing that a later one would read, and of two builders at once one's work is kept."""
    path = f"{shared_dir(spark)}/{name}-{stamp(*sources)}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(conf)
    if not fs.exists(at(f"{path}/{DONE}")):
        own = f"{path}.{uuid.uuid4().hex}"
        build(own)
        fs.create(at(f"{own}/{DONE}")).close()
        if not fs.exists(at(path)):
            fs.rename(at(own), at(path))
        # A rename onto a folder that another builder made meanwhile puts ours inside it or fails; what is there is complete either way.
        if fs.exists(at(own)):
            fs.delete(at(own), True)
    return path
