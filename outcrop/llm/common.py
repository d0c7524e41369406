"""Helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outcrop.sources.scratch import Scratch  # noqa: F401

#: Words are runs of anything but these six white-space characters.
WORD_BREAK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def nested(df: DataFrame, **derived: Column) -> DataFrame:
    """The whole row as one struct `row`, beside derived columns: whatever the input's columns are called, nothing clashes."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in derived.items()])


def unnested(df: DataFrame, *more: Column) -> DataFrame:
    return df.select(*[F.col(f"row.`{f.name}`").alias(f.name) for f in df.schema["row"].dataType.fields], *more)
