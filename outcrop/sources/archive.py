"""Readers of recordings (YAML), transcripts and captions, verse tables and feeds, and a writer that replaces a table in one step."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from outcrop.operators import sequences, timeline

from .scratch import Scratch

_POINTS = "array<struct<time:double,text:string>>"
_SECTION = f"id:string,title:string,kind:string,start:double,end:double,scripture:array<string>,points:{_POINTS}"
SCHEMA = f"id string, title string, service_date date, status string, description string, scripture array<string>, topics array<string>, uploads array<struct<youtube_id:string,duration:double,skip:double,unavailable:boolean,quirks:array<string>>>, chapters array<struct<{_SECTION},subchapters:array<struct<{_SECTION}>>>>, markers array<struct<time:double,end:double,note:string>>"


class _Strings(yaml.BaseLoader):
    """Every scalar a string, and no key twice: dates and clocks stay as written."""


def _mapping(loader, node):
    out = {}
    for key, value in node.value:
        k = loader.construct_object(key, deep=True)
        if k in out:
            raise yaml.constructor.ConstructorError(None, None, f"duplicate key {k}", key.start_mark)
        out[k] = loader.construct_object(value, deep=True)
    return out


_Strings.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, _mapping)


def _seconds(clock: str) -> float:
    out = 0.0
    for part in clock.split(":"):
        out = out * 60 + float(part)
    return out


# The fields of the files by what they become, clocks apart.
_NAMES = {
    "recordingTitle": "title", "serviceDate": "service_date", "status": "status", "sermonDescription": "description", "sermonScripture": "scripture", "sermonTopics": "topics", "uploads": "uploads",
    "chapters": "chapters", "markers": "markers", "youtubeId": "youtube_id", "uploadUnavailable": "unavailable", "uploadQuirks": "quirks", "chapterId": "id", "chapterTitle": "title", "chapterKind": "kind",
    "chapterScripture": "scripture", "points": "points", "subchapters": "subchapters", "pointText": "text", "markerNote": "note",
}
_CLOCKS = {"uploadDuration": "duration", "uploadSkip": "skip", "chapterStart": "start", "chapterEnd": "end", "pointTime": "time", "markerTime": "time", "markerEnd": "end"}


def _renamed(value):
    if isinstance(value, dict):
        unknown = [k for k in value if k not in _NAMES and k not in _CLOCKS]
        if unknown:
            raise ValueError(f"unknown field {unknown[0]}")
        return {(_CLOCKS.get(k) or _NAMES[k]): _seconds(v) if k in _CLOCKS else v == "true" if k == "uploadUnavailable" else _renamed(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_renamed(v) for v in value]
    return value


@F.pandas_udf(StructType([StructField("json", StringType()), StructField("problem", StringType())]))
def _parsed(content: pd.Series) -> pd.DataFrame:
    out = []
    for text in content:
        try:
            out.append((json.dumps(_renamed(yaml.load(text, _Strings))), None))  # noqa: S506
        except (yaml.YAMLError, ValueError, AttributeError) as e:
            out.append((None, " ".join(str(e).split())[:300]))
    return pd.DataFrame(out, columns=["json", "problem"])


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """A row for each YAML file, with `file`, the fields of SCHEMA and `problem`: what makes a file unreadable, else null."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+)\.ya?ml$", 1).alias("file"), _parsed("value").alias("p"))
    rows = files.select("file", "p.problem", F.from_json("p.json", SCHEMA).alias("r"))
    return rows.select("file", "problem", F.col("file").alias("id"), *[F.col(f"r.{f.name}").alias(f.name) for f in rows.schema["r"].dataType.fields if f.name != "id"])


def verse_counts(verses: DataFrame) -> dict[str, list[int]]:
    """{book: verses of each chapter} of (book, chapter, verse): a few thousand numbers for a whole Bible."""
    out: dict[str, list[int]] = {}
    for r in verses.groupBy("book", "chapter").agg(F.count(F.lit(1)).alias("n")).orderBy("book", "chapter").collect():
        out.setdefault(r.book, []).append(r.n)
    return out


def in_order(recordings: DataFrame) -> DataFrame:
    """Recordings with `place`, by the natural order of their ids: the date, then the number after it, which is 1 where there is none."""
    number = F.when(F.col("id").rlike(r"^\d{4}-\d\d-\d\d-\d+$"), F.regexp_extract("id", r"-(\d+)$", 1).try_cast("int"))
    keyed = recordings.withColumns({"_day": F.left("id", F.lit(10)), "_number": F.coalesce(number, F.lit(1))})
    return sequences.numbered(keyed, [], ["_day", "_number", "id"], "place").drop("_day", "_number", "_range")


def read_verses(spark: SparkSession, path: str) -> DataFrame:
    """(key, book, chapter, verse, text) of a text of tab-separated `Book chapter:verse` and verse."""
    rows = spark.read.text(path).select(F.split("value", "\t", 2).alias("c")).where(F.size("c") == 2)
    at = lambda n: F.regexp_extract(F.col("c")[0], r"^(.+) (\d+):(\d+)$", n)
    return rows.where(at(1) != "").select(F.col("c")[0].alias("key"), at(1).alias("book"), at(2).cast("int").alias("chapter"), at(3).cast("int").alias("verse"), F.trim(F.col("c")[1]).alias("text"))


_CUE = r"^\s*((?:\d+:)*\d+(?:[.,]\d+)?)\s*-->\s*((?:\d+:)*\d+(?:[.,]\d+)?)"


def _clock(c):
    return F.aggregate(F.split(F.translate(c, ",", "."), ":"), F.lit(0.0), lambda acc, x: acc * 60 + x.try_cast("double"))


def _clean(text):
    """Without tags and entities, white space as single spaces."""
    for pattern, to in ((r"<[^>]+>", ""), ("&lt;", "<"), ("&gt;", ">"), ("&#39;|&apos;", "'"), ("&quot;", '"'), ("&amp;", "&"), (r"(?U)\s+", " ")):
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def _cues(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, ord, start, end, text): a cue for each block with a time line and words."""
    blocks = files.select(key, F.posexplode(F.split(F.regexp_replace(F.regexp_replace(content, "^﻿", ""), "\r", ""), r"\n{2,}")).alias("ord", "b")).where(F.col("b").contains("-->"))
    rows = blocks.select(key, "ord", F.split("b", "\n").alias("rows")).select(key, "ord", "rows", F.array_position(F.transform("rows", lambda r: r.contains("-->")), True).cast("int").alias("at"))
    at = F.element_at("rows", F.col("at"))
    body = F.array_join(F.slice("rows", F.col("at") + 1, F.size("rows")), " ")
    out = rows.select(key, "ord", _clock(F.regexp_extract(at, _CUE, 1)).alias("start"), _clock(F.regexp_extract(at, _CUE, 2)).alias("end"), _clean(body).alias("text"), at.rlike(_CUE).alias("ok"))
    return out.where("ok and text <> ''").drop("ok")


def cues(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, start, end, text) of SRT and VTT texts: a cue for each block with a time line, tags and entities taken off."""
    return _cues(files, key, content).where("end >= start").drop("ord")


_TIMED = "array<struct<start:double,end:double,text:string>>"


def segments(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, start, end, text) of transcript JSON: `segments` in seconds, or `transcription` with offsets in milliseconds, or else clocks."""
    kind = f"struct<segments:{_TIMED},transcription:array<struct<offsets:struct<from:double,to:double>,timestamps:struct<from:string,to:string>,text:string>>>"
    j = files.select(key, F.from_json(content, kind).alias("j"))
    time = lambda t, side: F.coalesce(t["offsets"][side] / 1000, _clock(t["timestamps"][side]))
    spoken = F.transform("j.transcription", lambda t: F.struct(time(t, "from").alias("start"), time(t, "to").alias("end"), t["text"].alias("text")))
    rows = j.select(key, F.inline(F.coalesce("j.segments", spoken, F.array().cast(_TIMED)))).withColumn("text", _clean(F.col("text")))
    finite = lambda c: f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')"
    return rows.where(f"text <> '' and {finite('start')} and {finite('end')} and end >= start")


def transcripts(files: DataFrame, key: str, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """((key, start, end, text), (key, problem)) of transcript files of either kind, told apart by their text: what begins with a brace is JSON, what has an arrow is cues, whose repeats are folded in
    their order. A file that is neither, can't be read or has no timed line is a problem."""
    text = F.trim(F.regexp_replace(F.coalesce(content, F.lit("")), "^﻿", ""))
    kind = F.when(text.startswith("{"), "json").when(text.contains("-->"), "cues")
    own = files.select(key, text.alias("t"), kind.alias("kind"))
    said = timeline.rolled(_cues(own.where("kind = 'cues'"), key, "t"), key, order="ord").where("end >= start")
    rows = Scratch(files.sparkSession, "transcripts").save(segments(own.where("kind = 'json'"), key, "t").unionByName(said))
    is_json = F.col("kind") == "json"
    lists = F.get_json_object("t", "$.segments").startswith("["), F.get_json_object("t", "$.transcription").startswith("[")
    none = ~F.coalesce(lists[0], F.lit(False)) & ~F.coalesce(lists[1], F.lit(False))
    unread = F.when(F.col("kind").isNull(), "neither JSON nor cues").when(is_json & F.try_parse_json("t").isNull(), "not JSON").when(is_json & none, "no transcript segments")
    timed = rows.select(F.col(key).alias("_k")).distinct()
    held = own.join(timed, F.col(key).eqNullSafe(F.col("_k")), "left")
    problem = F.coalesce(unread, F.when(F.col("_k").isNull(), "no timed lines"))
    return rows, held.select(key, problem.alias("problem")).where("problem is not null")


_EVENTS = "struct<events:array<struct<tStartMs:double,dDurationMs:double,segs:array<struct<utf8:string>>>>>"


def _caption_events(files: DataFrame, key: str, duration: str, content: str) -> DataFrame:
    e = files.select(key, F.col(duration).cast("double").alias("_length"), F.inline(F.from_json(content, _EVENTS)["events"])).where(F.size("segs") > 0)
    start = F.col("tStartMs") / 1000
    words = F.trim(F.regexp_replace(F.array_join(F.transform("segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), ""), r"(?U)\s+", " "))
    return e.select(key, "_length", start.alias("start"), (start + F.col("dDurationMs") / 1000).alias("end"), words.alias("text"), F.exists("segs", lambda s: s["utf8"].isNull()).alias("_odd"))


def caption_problems(files: DataFrame, key: str, duration: str, content: str = "content") -> DataFrame:
    """(key, problem) of json3 captions that are refused as a whole: no list of events, pieces without text, times that are missing or below 0, events that begin after the duration or end more than two seconds after it."""
    e = _caption_events(files, key, duration, content)
    bad_time = F.col("start").isNull() | F.col("end").isNull() | F.isnan("start") | (F.col("start") < 0) | (F.col("end") < F.col("start"))
    beyond = (F.col("start") > F.col("_length")) | (F.col("end") > F.col("_length") + 2)
    problem = F.when(F.col("_odd"), "invalid text segments").when(F.col("text") == "", None).when(bad_time, "invalid timestamp").when(beyond, "beyond the duration")
    shape = files.where(F.from_json(content, _EVENTS)["events"].isNull()).select(key, F.lit("no caption events").alias("problem"))
    return e.select(key, problem.alias("problem")).where("problem is not null").distinct().unionByName(shape)


def captions(files: DataFrame, key: str, duration: str, content: str = "content") -> DataFrame:
    """(key, start, end, text) of json3 caption events: joined pieces, tails clipped to the duration, exact repeats once. Files that caption_problems() names have no rows."""
    refused = caption_problems(files, key, duration, content).select(F.col(key).alias("_k")).distinct()
    good = files.join(refused, F.col(key).eqNullSafe(F.col("_k")), "left_anti")
    rows = _caption_events(good, key, duration, content).withColumn("end", F.least("end", "_length")).select(key, "start", "end", "text")
    return rows.where("text <> '' and end > start").dropDuplicates([key, "start", "end", "text"])


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, title, published) of Atom feeds by Spark's XML source; equal entries once."""
    raw = spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", "true").schema("videoId string, title string, published string").load(path)
    zoned = F.col("published").rlike(r"(?:Z|[+-]\d\d:\d\d)$")
    return raw.where(zoned & F.col("videoId").isNotNull()).select(F.col("videoId").alias("video_id"), "title", F.to_timestamp("published").alias("published")).distinct()


def content_digest(df: DataFrame, leaf: int = 1024) -> str:
    """A digest of the rows of a table, whatever their order and partitioning: rows' digests with how often each comes, hashed in groups of about `leaf`, those again, and so on up."""
    scratch = Scratch(df.sparkSession, "digest")
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}), 256)
    level = scratch.save(df.select(row.alias("h")).groupBy("h").count().select(F.concat_ws(":", "h", "count").alias("h")))
    while (n := level.count()) > leaf:
        group = F.pmod(F.xxhash64("h"), F.lit(-(-n // leaf)))
        above = scratch.save(level.groupBy(group.alias("g")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ","), 256).alias("h")).select("h"))
        scratch.drop(level)
        level = above
    held = sorted(r["h"] for r in level.collect())
    scratch.drop(level)
    return hashlib.sha256(",".join([df.schema.json(), *held]).encode()).hexdigest()


def write_versioned(df: DataFrame, path: str) -> str:
    """Writes a new version beside the old ones and names it by its content; a failed write leaves the old versions as they are."""
    token = content_digest(df)[:16]
    df.write.mode("overwrite").parquet(f"{path}/{token}")
    return f"{path}/{token}"
