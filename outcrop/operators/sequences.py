"""Rows in order, over groups of any length: what stands before a row, runs between restarts, numbers, and folds within a run.

A group's rows are dealt to tasks by ranges of (keys, order), so a long group is in several tasks. What a task can't see, the last row of the group before its range, comes from
a table with one row for each group and range. So no window is wider than a range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from outcrop.sources.scratch import Scratch


def ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with _range: the number of the range that a row is in. It is written, so that later reads see the same ranges."""
    return Scratch(df.sparkSession, "ranges").save(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a left join of a table with one row for each range and group; null keys are one group."""
    names = {k: f"_k{i}" for i, k in enumerate(["_range", *keys])}
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return a.join(b.withColumnsRenamed(names), on, "left").drop(*names.values())


def with_previous(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """df with previous_<column>: the columns of the row before in its group, null for the first; `order` is total. Keeps _range."""
    r = df if "_range" in df.columns else ranged(df, keys, order)
    own = W.partitionBy("_range", *keys).orderBy(*order)
    rows = r.withColumns({f"previous_{c}": F.lag(c).over(own) for c in columns} | {"_place": F.row_number().over(own)})
    ends = r.groupBy("_range", *keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_end"))
    before = ends.withColumn("_before", F.lag("_end").over(W.partitionBy(*keys).orderBy("_range"))).drop("_end")
    joined = _same(rows, before, keys)
    return joined.withColumns({f"previous_{c}": F.when(F.col("_place") == 1, F.col(f"_before.{c}")).otherwise(F.col(f"previous_{c}")) for c in columns}).drop("_place", "_before")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "n", counted: Column | None = None) -> DataFrame:
    """df with the number of a row in its group, from 1; or, given a condition, of how many rows up to it meet that."""
    r = df if "_range" in df.columns else ranged(df, keys, order)
    one = F.lit(1) if counted is None else F.coalesce(counted, F.lit(False)).cast("int")
    rows = r.withColumn("_one", one)
    sums = rows.groupBy("_range", *keys).agg(F.sum("_one").alias("_sum"))
    offset = F.coalesce(F.sum("_sum").over(W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = F.sum("_one").over(W.partitionBy("_range", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    joined = _same(rows.withColumn("_own", own), sums.withColumn("_offset", offset).drop("_sum"), keys)
    return joined.withColumn(name, (F.col("_own") + F.col("_offset")).cast("bigint")).drop("_one", "_own", "_offset")


def runs(df: DataFrame, keys: list[str], order: list[str], columns: list[str], restart: Column) -> DataFrame:
    """df with `run`: numbers of stretches of a group that begin where `restart`, a condition on columns and previous_<column>, is true, and at its first row."""
    p = with_previous(df, keys, order, columns)
    first = F.col(f"previous_{columns[0]}").isNull()
    begun = numbered(p.withColumn("_new", first | restart), keys, order, "run", F.col("_new"))
    return begun.drop("_new", "_range", *[f"previous_{c}" for c in columns])


def folded(df: DataFrame, keys: list[str], order: list[str], columns: list[str], step: Callable[[object, dict], tuple[object, list[dict]]], end: Callable[[object], list[dict]], schema: str) -> DataFrame:
    """One pass over each group (keys) in order, with a state that starts as None: step(state, row) gives the state and rows that are done, end(state) what is left. Rows go by as a
    stream: a task holds one batch and one state, however long a group is."""
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, some = None, None, False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                group = tuple(row[k] for k in keys)
                if some and group != now:
                    out += end(state)
                    state = None
                now, some = group, True
                state, done = step(state, row)
                out += done
            yield pa.RecordBatch.from_pylist(out, kind)
        if some:
            yield pa.RecordBatch.from_pylist(end(state), kind)

    return df.select(*keys, *order, *[c for c in columns if c not in keys + order]).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
