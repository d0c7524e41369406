"""Clocks of recordings in several uploads, as-of lookups, chunks and intervals. Every lookup has an equality on the recording, never a bare range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from outcrop.functions import captions

from . import sequences


def upload_spans(uploads: DataFrame, key: str, order: str, duration: str = "duration", skip: str = "skip") -> DataFrame:
    """uploads with span_start and span_end on the recording's clock: each lasts its duration less what it skips."""
    length = F.col(duration) - F.coalesce(F.col(skip), F.lit(0))
    upto = F.sum(length).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return uploads.withColumn("span_end", upto).withColumn("span_start", F.col("span_end") - length)


def locate(times: DataFrame, spans: DataFrame, key: str, at: str, order: str) -> DataFrame:
    """times with the upload that holds each: the first span that ends after it, else the recording's last. A recording's spans are
    one sorted array, so the join is on the recording alone."""
    packed = spans.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("span_end").alias("e"), F.col("span_start").alias("s")))).alias("_spans"))
    found = times.join(packed, key)
    hit = F.get(F.filter("_spans", lambda x: x["e"] > F.col(at)), F.lit(0))
    chosen = F.coalesce(hit, F.element_at("_spans", -1))
    return found.withColumns({"upload": chosen["o"], "local": F.col(at) - chosen["s"]}).drop("_spans")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left with the value of the last right row of its key at or before its time (null if none): one shuffle on key, one sorted pass."""
    both = left.withColumns({"_side": F.lit(1), "_value": F.lit(None).cast(right.schema[value].dataType)}).unionByName(right.select(key, at, F.col(value).alias("_value")).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    seen = F.last("_value", ignorenulls=True).over(W.partitionBy(key).orderBy(at, "_side").rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn(value, seen).where("_side = 1").drop("_side", "_value")


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, within, order: str) -> DataFrame:
    """left with the nearest right row's `order` within a distance (the first of equals), on buckets of that distance."""
    bucket = lambda c: F.floor(F.col(c) / within)
    r = right.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.col(order).alias("nearest")).withColumn("_b", F.explode(F.array(*[bucket("_t") + d for d in (-1, 0, 1)])))
    met = left.join(r, (F.col(key) == F.col("_k")) & (bucket(at) == F.col("_b")))
    gap = F.abs(F.col(at) - F.col("_t"))
    best = met.where(gap <= within).groupBy(key, at).agg(F.min_by("nearest", F.struct(gap, F.col("nearest"))).alias("nearest"))
    return left.join(best, [key, at], "left")


def chunks(start: Column, end: Column, size: int = 600, overlap: int = 45) -> Column:
    """[(start, end)] of overlapping chunks that cover a range."""
    stride = size - overlap
    n = F.greatest(F.ceil((end - start - size) / F.lit(stride)), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.struct((start + i * stride).alias("start"), F.least(start + i * stride + size, end).alias("end")))


def owner(start: Column, end: Column, origin: Column, size: int = 600, overlap: int = 45) -> Column:
    """The number of the chunk that owns a segment: by its midpoint, chunks meeting in the middle of their overlaps."""
    return F.greatest(F.floor(((start + end) / 2 - origin - overlap / 2) / (size - overlap)), F.lit(0)).cast("int")


def rolled(lines: DataFrame, key: str, start: str = "start", end: str = "end", text: str = "text", order: str = "start") -> DataFrame:
    """(key, start, end, text) of captions whose lines begin with what the line before them had: a line in the order of the cues loses the text that was last put out, where it begins with that, and a line
    that only repeats it makes the last one longer. Blank lines are none. What was put out is the end of the line before, from one of its words on; so where no beginning of a
    line is such an end, the fold starts anew, and runs between such lines are folded apart."""
    rows = lines.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").select(key, F.col(order).alias("_order"), F.col(start).cast("double").alias("start"), F.col(end).cast("double").alias("end"), F.col(text).alias("text"))
    # A caption is a few words: its beginnings are as many.
    w = F.split("text", " ")
    beginnings = F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.array_join(F.slice(w, F.lit(1), i), " "))
    met = F.exists(beginnings, lambda x: (F.col("previous_text") == x) | F.endswith(F.col("previous_text"), F.concat(F.lit(" "), x)))
    parts = sequences.runs(rows, [key], ["_order"], ["text"], ~met)

    def step(last, row):
        if last is not None and row["text"] == last["text"]:
            return last | {"end": max(last["end"], row["end"])}, []
        rest = row["text"][len(last["text"]) + 1 :] if last is not None and row["text"].startswith(last["text"] + " ") else row["text"]
        return {key: row[key], "start": row["start"], "end": row["end"], "text": rest}, [] if last is None else [last]

    return sequences.folded(parts, [key, "run"], ["_order"], ["start", "end", "text"], step, lambda last: [] if last is None else [last], f"{key} {lines.schema[key].dataType.simpleString()}, start double, end double, text string")


def islands(samples: DataFrame, key: str, order: str, quiet: Column, loud: Column, low: int = 2, high: int = 12) -> DataFrame:
    """(key, first, n): runs of low to high quiet samples between loud ones."""
    w = W.partitionBy(key).orderBy(order)
    rows = samples.select(key, order, quiet.alias("q"), loud.alias("l")).withColumns({"rn": F.row_number().over(w), "before": F.lag("l").over(w), "after": F.lead("l").over(w)})
    quiet_rows = rows.where("q").withColumn("run", F.col("rn") - F.row_number().over(w))
    runs = quiet_rows.groupBy(key, "run").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"), F.min_by("before", "rn").alias("b"), F.max_by("after", "rn").alias("a"))
    return runs.where(f"b and a and n between {low} and {high}").select(key, "first", "n")


def shingle_leaks(public: DataFrame, private: DataFrame, size: int = 12, least: int = 64) -> DataFrame:
    """(doc_id, n_shared): rows of public (doc_id, text) with runs of `size` words of at least `least` characters that are in private (text), as a reader
    sees them: without escapes, character references and tags, NFKC. Runs are compared by 64-bit hashes: a tenth of the shuffle that their texts would be."""

    def shingles(df: DataFrame, *cols: str) -> DataFrame:
        w = df.select(*cols, F.regexp_extract_all(F.lower(F.coalesce(captions.unescaped(F.col("text")), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("w"))
        # Runs by doubling would need a power of two; 12 = 8 + 4 words, each a join of neighbours.
        step = lambda c, k: F.zip_with(c, F.slice(c, F.lit(k + 1), F.greatest(F.size(c) - k, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
        w = w.select(*cols, F.size("w").alias("n"), step(F.col("w"), 1).alias("w2")).select(*cols, "n", step(F.col("w2"), 2).alias("w4")).select(*cols, "n", "w4", step(F.col("w4"), 4).alias("w8"))
        w12 = F.zip_with("w8", F.slice("w4", F.lit(9), F.greatest(F.size("w4") - 8, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
        kept = F.filter(F.array_distinct(F.slice(w12, F.lit(1), F.greatest(F.col("n") - (size - 1), F.lit(0)))), lambda x: F.length(x) >= least)
        return w.select(*cols, F.explode(F.transform(kept, lambda x: F.xxhash64(x))).alias("shingle"))

    if size != 12:
        raise ValueError("shingles have 12 words")
    known = shingles(private.select("text")).distinct()
    return shingles(public.select("doc_id", "text"), "doc_id").join(known, "shingle", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_shared"))


def recording_time(times: DataFrame, spans: DataFrame, keys: list[str], at: str, skip: str = "skip") -> DataFrame:
    """times in an upload (keys name recording and upload) with `recording_time`, null where the recording has no such upload. What an upload
    skips lies at its start."""
    own = spans.select(*keys, F.col("span_start"), F.coalesce(F.col(skip), F.lit(0)).alias("_skip"))
    return times.join(own, keys, "left").withColumn("recording_time", F.col("span_start") + F.greatest(F.col(at) - F.col("_skip"), F.lit(0))).drop("span_start", "_skip")


def gaps(spans: DataFrame, key: str, order: str, available: Column) -> DataFrame:
    """Spans that aren't available, with where the nearest ones before and after that are begin: before_start, after_start."""
    start = F.when(available, F.col("span_start"))
    w = W.partitionBy(key).orderBy(order)
    before = F.last(start, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    after = F.first(start, ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    return spans.withColumns({"before_start": before, "after_start": after, "_on": available}).where("not _on").drop("_on")


def containing(times: DataFrame, sections: DataFrame, key: str, at: str) -> DataFrame:
    """times with `section`: of the sections (key, id, depth, start, end) with start <= time < end the deepest, and of these the last; null if none.
    A recording's sections are one sorted array, so the join is on the recording alone."""
    packed = sections.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("depth", "start", "end", "id"))).alias("_sections"))
    hit = F.try_element_at(F.filter("_sections", lambda s: (s["start"] <= F.col(at)) & (F.col(at) < s["end"])), F.lit(-1))["id"]
    return times.join(packed, key, "left").withColumn("section", F.when(F.size("_sections") > 0, hit)).drop("_sections")


def clipped(sections: DataFrame, spans: DataFrame, key: str, upload: str, skip: str = "skip", duration: str = "duration") -> DataFrame:
    """(key, upload, id, local_start, local_end): the part of each section that lies in each upload, on the upload's clock."""
    s = spans.select(key, upload, "span_start", F.coalesce(F.col(skip), F.lit(0)).alias("_skip"), F.col(duration).alias("_length"))
    local = lambda c: F.least(F.col("_length"), F.greatest(F.lit(0), F.col("_skip") + F.col(c) - F.col("span_start")))
    return sections.join(s, key).select(key, upload, "id", local("start").alias("local_start"), local("end").alias("local_end")).where("local_end > local_start")


def absolute(segments: DataFrame, start: str, end: str) -> DataFrame:
    """Segments (start, end, text) of a chunk on the recording's clock: the chunk's start is added, and what passes its end is cut; to milliseconds."""
    rows = segments.withColumns({"_from": F.col(start) + F.col("start"), "_to": F.least(F.col(end).cast("double"), F.col(start) + F.col("end"))})
    return rows.where("_from < _to and trim(text) <> ''").withColumns({"start": F.round("_from", 3), "end": F.round("_to", 3), "text": F.trim("text")}).drop("_from", "_to")
