"""Evaluation of rankings, levels of audio samples, verses of references, and rows of a timeline."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sequences


def recording_ranks(results: DataFrame, case: str, recording: str, score: str) -> DataFrame:
    """(case, recording, rank): a recording ranks by its best unit, each recording once."""
    best = results.groupBy(case, recording).agg(F.max(score).alias("_score"))
    return best.selectExpr(case, recording, f"row_number() over (partition by {case} order by _score desc, {recording}) as rank")


def evaluated(ranks: DataFrame, accepted: DataFrame, case: str, recording: str, max_rank: int) -> DataFrame:
    """(case, rank, passed): the best rank of an accepted (case, recording), null where none was found."""
    met = accepted.join(ranks, [case, recording], "left").groupBy(case).agg(F.min("rank").alias("rank"))
    return met.select(case, "rank", F.coalesce(F.col("rank") <= max_rank, F.lit(False)).alias("passed"))


def case_reports(cases: DataFrame, accepted: DataFrame, results: DataFrame) -> DataFrame:
    """(case, kind, rank, n_results, passed) of many queries at once. cases: case, kind (rank, date or empty), max_rank, expected_date, reason (a prefix
    that one of the accepted recording's reasons must have, or null); accepted: (case, recording); results: case, recording, score, date, reasons.
    A rank or date case passes with an accepted recording within max_rank, a date case with nothing of another date besides, an empty one without results."""
    met = results.join(cases.select("case", "reason", "expected_date"), "case")
    reasoned = met.where(F.col("reason").isNull() | F.exists("reasons", lambda r: r.startswith(F.col("reason")))).select("case", "recording").distinct()
    best = accepted.join(recording_ranks(results, "case", "recording", "score"), ["case", "recording"]).join(reasoned, ["case", "recording"]).groupBy("case").agg(F.min("rank").alias("rank"))
    counts = met.groupBy("case").agg(F.count(F.lit(1)).alias("n_results"), F.count_if(~F.col("date").eqNullSafe(F.col("expected_date"))).alias("off"))
    rows = cases.join(best, "case", "left").join(counts, "case", "left").na.fill(0, ["n_results", "off"])
    found = F.coalesce(F.col("rank") <= F.col("max_rank"), F.lit(False))
    passed = F.when(F.col("kind") == "empty", F.col("n_results") == 0).when(F.col("kind") == "date", found & (F.col("off") == 0)).otherwise(found)
    return rows.select("case", "kind", "rank", "n_results", passed.alias("passed"))


def summary(reports: DataFrame) -> DataFrame:
    return reports.agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count(F.lit(1)).alias("total"))


def decibels(power: Column) -> Column:
    """Within -120 and 6."""
    return F.round(F.greatest(F.lit(-120.0), F.least(F.lit(6.0), 10 * F.log10(F.greatest(power, F.lit(1e-12))))), 3)


def audio_levels(frames: DataFrame, key: str, left: str, right: str, loud: float = 0.0056, clip: float = 0.995) -> DataFrame:
    """(key, left_db, right_db, active_fraction, clipped_fraction) of sample pairs; sums combine before the shuffle."""
    l, r = F.col(left), F.col(right)
    clipped = (F.abs(l) >= clip).cast("int") + (F.abs(r) >= clip).cast("int")
    sums = frames.groupBy(key).agg(F.avg(l * l).alias("l"), F.avg(r * r).alias("r"), F.avg((F.sqrt(F.greatest(l * l, r * r)) >= loud).cast("double")).alias("active"), (F.sum(clipped) / (2 * F.count(F.lit(1)))).alias("clipped"))
    return sums.select(key, decibels(F.col("l")).alias("left_db"), decibels(F.col("r")).alias("right_db"), F.round("active", 6).alias("active_fraction"), F.round("clipped", 6).alias("clipped_fraction"))


def audio_findings(dropouts: str = "dropouts") -> Column:
    """What the levels of stereo samples suggest: one side only, choppy, clipping."""
    high, low = F.greatest("left_db", "right_db"), F.least("left_db", "right_db")
    one_side = (high > -45) & (low < -65) & (high - low >= 30)
    return F.array_compact(F.array(F.when(one_side, F.when(F.col("left_db") > F.col("right_db"), "audio_left_only").otherwise("audio_right_only")), F.when(F.col(dropouts) >= 3, "audio_choppy"), F.when(F.col("clipped_fraction") >= 0.005, "audio_clipping")))


def best_audible(samples: DataFrame, key: str, location: str = "location") -> DataFrame:
    """(key, location): the most active sample that is loud enough."""
    ok = samples.where("active_fraction >= 0.15 and greatest(left_db, right_db) > -45")
    return ok.groupBy(key).agg(F.max_by(location, F.struct("active_fraction", location)).alias("location"))


def reference_verses(references: DataFrame, verses: DataFrame) -> DataFrame:
    """(canonical, ord, key) of references (canonical, book, lo, hi): each interval as its numbers, then an equi-join on verses (book, ord, key)."""
    numbers = references.select("canonical", "book", F.explode(F.sequence("lo", "hi")).alias("ord"))
    return numbers.join(verses.select("book", "ord", "key"), ["book", "ord"], "left").select("canonical", "ord", "key")


def sample_times(length: Column, step: int = 300, size: int = 30) -> Column:
    """[(start, end)] of a sample each `step` seconds, within the length."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((length - 1) / step), F.lit(0)).cast("int")), lambda i: F.struct((i * step).alias("start"), F.least(i * step + size, length).alias("end")))


def stacked(points: DataFrame, key: str, at: str, width: float, order: list[str] | None = None) -> DataFrame:
    """(key, at, *order, row): each point, by time and then by order, in the first row whose last point is at least `width` before it. Where a point is that far from the
    one before it every row is free, so stretches between such points are stacked apart; within one, rows that are free and rows that will be are two heaps."""
    order = order or []
    rows = points.select(key, F.col(at).cast("double").alias("_at"), *order).where("_at is not null")
    parts = sequences.runs(rows, [key], ["_at", *order], ["_at"], F.col("_at") - F.col("previous__at") >= width)

    def step(state, row):
        busy, free, n = state or ([], [], 0)
        while busy and busy[0][0] <= row["_at"]:
            heapq.heappush(free, heapq.heappop(busy)[1])
        place = heapq.heappop(free) if free else n
        heapq.heappush(busy, (row["_at"] + width, place))
        return (busy, free, max(n, place + 1)), [{key: row[key], at: row["_at"], **{c: row[c] for c in order}, "row": place}]

    kinds = [f"{c} {points.schema[c].dataType.simpleString()}" for c in order]
    return sequences.folded(parts, [key, "run"], ["_at", *order], [], step, lambda state: [], ", ".join([f"{key} {points.schema[key].dataType.simpleString()}", f"{at} double", *kinds, "row int"]))


def candidate_times(start: Column, end: Column, length: Column, seconds: float = 30) -> Column:
    """Up to three times at which to listen into a window: at three shares of it, a little before, each once and within it; null for a window that isn't in the recording."""
    latest = F.greatest(start, end - seconds)
    times = F.array(*[F.round(F.greatest(start, F.least(start + (end - start) * share - 3, latest)), 3) for share in (0.35, 0.5, 0.65)])
    return F.when((start >= 0) & (start < end) & (end <= length), F.array_distinct(times))


def in_view(points: DataFrame, at: str, begin: float, span: float, width: float, target: float = 24) -> DataFrame:
    """Points with `left`, where they are on a view of `width` pixels that shows `span` seconds from `begin`; those out of reach of it by more than half a target are left out. Stack
    them by (left, target + 2)."""
    left = (F.col(at) - begin) * width / span
    return points.withColumn("left", left).where((F.col("left") >= -target / 2) & (F.col("left") <= width + target / 2))
