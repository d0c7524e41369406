"""Values under a key anywhere in nested documents of unknown schema, and tables of verses in order."""

from __future__ import annotations

import json

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from outcrop.functions.scripture import BOOKS
from outcrop.operators import sequences

from .archive import _Strings
from .scratch import Scratch

VIDEO_ID = r"^[A-Za-z0-9_-]{11}$"


@F.pandas_udf(StringType())
def _as_json(column: pd.Series) -> pd.Series:
    def plain(text: str) -> str | None:
        try:
            return json.dumps(yaml.load(text, _Strings))  # noqa: S506
        except yaml.YAMLError:
            return None

    return column.map(plain, na_action="ignore")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, json) of YAML files in any folder below path, every scalar a string; json is null for a file that can't be read."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.y*ml").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("file"), _as_json("value").alias("json"))


def values_of(documents: DataFrame, key: str, document: str, json_text: str) -> DataFrame:
    """(document, value) of every value that stands under `key` in JSON texts, however deep. Each step takes all values one level apart; what is under the key isn't
    entered. There are as many steps as the deepest document has levels."""
    scratch = Scratch(documents.sparkSession, "values")
    level = scratch.save(documents.where(F.col(json_text).isNotNull()).select(F.col(document), F.to_json(F.parse_json(json_text)).alias("v")))
    out = []
    while not level.isEmpty():
        rows = level.select(document, F.parse_json("v").alias("v")).lateralJoin(documents.sparkSession.tvf.variant_explode(F.col("v").outer()))
        parts = scratch.save(rows.select(document, F.col("key").eqNullSafe(F.lit(key)).alias("hit"), F.to_json("value").alias("v")))
        scratch.drop(level)
        text = F.when(F.col("v").startswith('"'), F.try_variant_get(F.parse_json("v"), "$", "string")).otherwise(F.col("v"))
        out.append(parts.where("hit").select(document, text.alias("value")))
        level = scratch.save(parts.where("not hit and (v like '{%' or v like '[%')").select(document, "v"))
    scratch.drop(level)
    found = documents.select(document, F.lit(None).cast("string").alias("value")).where(F.lit(False))
    for o in out:
        found = found.unionByName(o)
    return found


def known_ids(documents: DataFrame, uploads: DataFrame, document: str, json_text: str, key: str = "youtube_id") -> tuple[DataFrame, DataFrame]:
    """((id), (document, problem)): every id that documents or uploads (youtube_id) have, once, and the values that are none."""
    found = Scratch(documents.sparkSession, "ids").save(values_of(documents, key, document, json_text))
    good = F.col("value").rlike(VIDEO_ID)
    ids = found.where(good).select(F.col("value").alias("id")).union(uploads.where("youtube_id is not null").select("youtube_id")).distinct()
    return ids, found.where(~F.coalesce(good, F.lit(False))).select(document, F.concat(F.lit("invalid id "), F.coalesce("value", F.lit("null"))).alias("problem"))


# --- verses


def verse_lines(lines: DataFrame) -> DataFrame:
    """lines (line, value), of tab-separated `Book chapter:verse` and text, with book, book_ord (from 0, null for none), chapter, verse, text; these are null where a line is malformed."""
    form = r"^(.*?) ([1-9][0-9]*):([1-9][0-9]*)\t([^\t]*)$"
    at = lambda n: F.regexp_extract("value", form, n)
    ok = F.col("value").rlike(form)
    names = F.create_map(*[F.lit(x) for i, names in enumerate(BOOKS) for n in names for x in (n.lower().replace(" ", "").replace(".", ""), i)])
    rows = lines.select(*lines.columns, F.when(ok, at(1)).alias("book"), F.when(ok, at(2).try_cast("int")).alias("chapter"), F.when(ok, at(3).try_cast("int")).alias("verse"), F.when(ok, at(4)).alias("text"))
    return rows.withColumn("book_ord", names[F.regexp_replace(F.lower("book"), r"[\s.]", "")])


def read_verse_lines(spark: SparkSession, path: str, header: str) -> DataFrame:
    """verse_lines() of the lines after the header line of a text file."""
    text = F.split(F.regexp_replace(F.regexp_replace("value", "^﻿", ""), r"\s+$", ""), r"\r?\n")
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(text).alias("line", "value"))
    start = lines.where(F.col("value") == header).agg(F.min("line").alias("start"))
    return verse_lines(lines.crossJoin(F.broadcast(start)).where("line > start").drop("start"))  # start is one row


def verse_problems(rows: DataFrame, books: int | None = None, file: str | None = None) -> DataFrame:
    """(file, line, problem) of verses in the order of their lines, within each file if a column names it: malformed rows, unknown books, and each step that isn't the next verse, the first of the next chapter or the first of the next book, by what
    is missing, repeated or out of place. The row before the first of a range of lines comes from the range before. `books`: how many there must be."""
    keys = [file] if file else []
    malformed = rows.where("chapter is null or verse is null").select(*keys, "line", F.concat(F.lit("malformed row: "), F.left("value", F.lit(80))).alias("problem"))
    good = rows.where("chapter is not null and verse is not null")
    unknown = good.where("book_ord is null").select(*keys, "line", F.concat(F.lit("unknown book "), "book").alias("problem"))
    p = sequences.with_previous(good.where("book_ord is not null"), keys, ["line"], ["book_ord", "chapter", "verse"])
    b, c, v = (F.col(f"previous_{x}") for x in ("book_ord", "chapter", "verse"))
    first = F.col("book_ord") > F.coalesce(b, F.lit(-1))
    name = F.concat_ws(" ", "book", F.concat_ws(":", "chapter", "verse"))
    between = lambda low, high: F.when(high > low, F.concat(low.cast("string"), F.lit("-"), high.cast("string"))).otherwise(low.cast("string"))
    one = F.lit(1)
    problem = (
        F.when(F.col("book_ord") > F.coalesce(b, F.lit(-1)) + 1, F.concat(F.lit("missing books before "), "book"))
        .when(F.col("book_ord") < b, F.concat(F.lit("book out of order: "), name))
        .when(first & (F.col("chapter") > 1), F.concat(F.lit("missing chapters "), between(one, F.col("chapter") - 1), F.lit(" of "), "book"))
        .when(first & (F.col("verse") > 1), F.concat(F.lit("missing verses "), between(one, F.col("verse") - 1), F.lit(" of "), "book", F.lit(" "), "chapter"))
        .when(first, None)
        .when(F.col("chapter") > c + 1, F.concat(F.lit("missing chapters "), between(c + 1, F.col("chapter") - 1), F.lit(" of "), "book"))
        .when(F.col("chapter") < c, F.concat(F.lit("chapter out of order: "), name))
        .when((F.col("chapter") > c) & (F.col("verse") > 1), F.concat(F.lit("missing verses "), between(one, F.col("verse") - 1), F.lit(" of "), "book", F.lit(" "), "chapter"))
        .when(F.col("chapter") > c, None)
        .when(F.col("verse") == v, F.concat(F.lit("repeated verse "), name))
        .when(F.col("verse") < v, F.concat(F.lit("verse out of order: "), name))
        .when(F.col("verse") > v + 1, F.concat(F.lit("missing verses "), between(v + 1, F.col("verse") - 1), F.lit(" of "), "book", F.lit(" "), "chapter"))
    )
    out = malformed.unionByName(unknown).unionByName(p.select(*keys, "line", problem.alias("problem")).where("problem is not null"))
    if books:
        there = good.groupBy(*keys).agg(F.count_distinct("book_ord").alias("n")).where(F.col("n") != books)
        out = out.unionByName(there.select(*keys, F.lit(None).cast(rows.schema["line"].dataType).alias("line"), F.concat("n", F.lit(f" books instead of {books}")).alias("problem")))
    return out
