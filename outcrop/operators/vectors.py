"""Quantised vectors: windows, pooling, int8 rows, cosine, and the file they are kept in."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from outcrop.sources.scratch import Scratch

WINDOW, STRIDE = 254, 190
MAGIC = b"OUTCRVEC"


def token_windows(df: DataFrame, tokens: str = "tokens", size: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """A row for each window of an array: start (from 0) and the tokens; the last window reaches the end. An empty array has one empty window."""
    n = F.greatest(F.ceil((F.size(tokens) - size) / F.lit(stride)), F.lit(0)).cast("int")
    out = df.withColumn("start", F.explode(F.transform(F.sequence(F.lit(0), n), lambda i: i * stride)))
    return out.withColumn("window", F.slice(tokens, F.col("start") + 1, F.lit(size)))


def ordinals(df: DataFrame, *order: Column) -> DataFrame:
    """df with row_ord, its place from 0 in a total order: rows are dealt by ranges, a range's rows are numbered in its task, and the sizes of the ranges before are added."""
    # The ranges are written, so that no later read deals rows out anew.
    ranged = Scratch(df.sparkSession, "ordinals").save(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").count().selectExpr("_range", "coalesce(sum(count) over (order by _range rows between unbounded preceding and 1 preceding), 0) as _before")
    own = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_place", own).join(F.broadcast(sizes), "_range").withColumn("row_ord", (F.col("_before") + F.col("_place")).cast("bigint")).drop("_range", "_place", "_before")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero; within -1 and 1."""
    size = norm(a) * norm(b)
    return F.when(size > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size))).otherwise(0.0)


def quantise(v: Column) -> Column:
    """To -127..127 by the largest magnitude, halves away from zero; a zero vector stays zero, and one with a null or a value that isn't finite has no row: null."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))  # NaN is above infinity
    return F.when(finite, F.transform(v, lambda x: F.when(top > 0, F.round(x.cast("double") * 127 / top)).otherwise(0).cast("tinyint")))


def blob_sha1(content: Column) -> Column:
    """The name of a content as a git blob."""
    data = content.cast("binary")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(data).cast("string")), "UTF-8"), F.unhex(F.lit("00")), data))


def pooled(windows: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """(key, vector): the mean of a unit's normalised window vectors, normalised. Sums are of a vector's places, so they combine before the shuffle."""
    unit = windows.select(key, F.transform(vector, lambda x: x.cast("double") / norm(F.col(vector))).alias("u"))
    sums = unit.select(key, F.posexplode("u")).groupBy(key, "pos").agg(F.avg("col").alias("x"))
    rows = sums.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("m"))
    return rows.select(key, F.transform("m", lambda x: x / norm(F.col("m"))).alias("vector"))


def is_embedding(v: Column, dimension: int) -> Column:
    return (F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))) & (F.abs(norm(v) - 1) < 0.001)


def embed(units: DataFrame, encode: Callable[[list[str]], np.ndarray], cache: DataFrame, recipe: str, text: str = "text") -> DataFrame:
    """(hash, vector) of texts that the cache (hash, vector) doesn't have, made by encode in batches. Append it to the cache."""
    keyed = units.select(F.sha2(F.concat(F.lit(recipe), F.lit("\u0000"), F.col(text)), 256).alias("hash"), F.col(text).alias("t")).dropDuplicates(["hash"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"hash": frame["hash"], "vector": list(np.asarray(encode(frame["t"].tolist()), np.float32))})

    return keyed.join(cache, "hash", "left_anti").mapInPandas(run, "hash string, vector array<float>")


def pack(rows: np.ndarray) -> bytes:
    """A file of int8 rows: magic, dimension and version (16 bits each), number of rows (32 bits), rows."""
    if rows.dtype != np.int8 or (rows == -128).any():
        raise ValueError("rows are int8 from -127 to 127")
    return MAGIC + struct.pack("<HHI", rows.shape[1], 1, rows.shape[0]) + rows.tobytes()


def unpack(data: bytes) -> np.ndarray:
    dimension, version, n = struct.unpack_from("<HHI", data, 8)
    if data[:8] != MAGIC or version != 1 or len(data) != 16 + n * dimension:
        raise ValueError("not a vector file")
    rows = np.frombuffer(data, np.int8, offset=16).reshape(n, dimension)
    if (rows == -128).any():
        raise ValueError("-128 is not a value")
    return rows


def read_packed(spark, path: str) -> DataFrame:
    """(path, row_ord, vector) of vector files, one task a file."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, content in zip(frame["path"], frame["content"], strict=True):
                m = unpack(bytes(content))
                yield pd.DataFrame({"path": p, "row_ord": np.arange(len(m)), "vector": list(m)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "path string, row_ord bigint, vector array<tinyint>")
