"""What a result card and the browsing pages show: verses and references of a unit, its text, pages, outlines, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outcrop.functions import captions

from . import sequences


def best_verses(passages: DataFrame, scores: DataFrame) -> DataFrame:
    """(passage, key, score): of the verses (passage, ord, key) of a passage the one with the highest score above 0, the first of equals. scores: (key, score)."""
    found = passages.join(scores.where("score > 0"), "key")
    best = found.groupBy("passage").agg(F.max_by(F.struct("key", "score"), F.struct("score", -F.col("ord"))).alias("x"))
    return best.select("passage", "x.key", "x.score")


def shown_references(references: DataFrame, unit: str = "unit_id") -> DataFrame:
    """(unit, place, reference) in the order of a card: those that overlap the query first, then by best verse, then as cited; the leading
    one is narrowed to its best verse, and what then comes twice is shown once. references: unit, ord, reference, overlaps, best_key, best_score
    (no best verses where the query is a reference itself). A unit cites a few references, so its rows are one task's."""
    order = "order by cast(overlaps as int) desc, coalesce(best_score, 0) desc, ord"
    ranked = references.selectExpr(unit, "reference", "best_key", "best_score", f"row_number() over (partition by {unit} {order}) as k")
    narrowed = ranked.selectExpr(unit, "k", "case when k = 1 and best_score > 0 then best_key else reference end as reference")
    first = narrowed.groupBy(unit, "reference").agg(F.min("k").alias("k"))
    return first.selectExpr(unit, f"cast(row_number() over (partition by {unit} order by k) as int) as place", "reference")


def with_verse_text(units: DataFrame, cited: DataFrame, reference_verses: DataFrame, verses: DataFrame, unit: str = "unit_id") -> DataFrame:
    """units with verse_text: the texts of the verses that a unit cites, each verse once, in the order of the citations (unit, ord, reference) and of the
    verses (reference, pos, key) in them, joined by line ends; null where there are none. verses: (key, text)."""
    keys = cited.join(reference_verses, "reference").groupBy(unit, "key").agg(F.min(F.struct("ord", "pos")).alias("at"))
    texts = keys.join(verses.where("text <> ''"), "key").groupBy(unit).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n").alias("verse_text"))
    return units.drop("verse_text").join(texts, unit, "left")


def unit_text(title: Column, text: Column, topics: Column, scripture: Column, verse_text: Column) -> Column:
    """The words that a unit is about, as an encoder is given them; parts that are blank are left out."""
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws(". ", blank(title), blank(text), blank(F.array_join(topics, ", ")), blank(F.array_join(scripture, "; ")), blank(F.replace(verse_text, F.lit("\n"), F.lit(". "))))


def page(items: DataFrame, number: int, *order: Column, size: int = 20) -> DataFrame:
    """One page of items in order: a page is the feature, so only its rows and those before it are ordered, by a top-k."""
    return items.orderBy(*order).offset((number - 1) * size).limit(size)


def categories(items: DataFrame, **present: Column) -> DataFrame:
    """(category, available): whether any item has a value of a category; one pass."""
    row = items.agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(k) for k, c in present.items()])
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("category"), F.col(k).alias("available")) for k in present])))


def outline(items: DataFrame, key: str) -> DataFrame:
    """items (key, id, parent, start) with depth and place: parts in time order, each followed by its own. Two levels, as recordings have; an
    item whose parent isn't there is an orphan and left out."""
    top = items.where("parent is null").select(key, F.col("id").alias("parent"), F.col("start").alias("_top"))
    below = items.where("parent is not null").join(top, [key, "parent"]).withColumn("depth", F.lit(1))
    rows = items.where("parent is null").withColumns({"_top": F.col("start"), "depth": F.lit(0)}).unionByName(below)
    group = F.when(F.col("depth") == 0, F.col("id")).otherwise(F.col("parent"))
    return rows.withColumn("_group", group).selectExpr(*items.columns, "depth", f"cast(row_number() over (partition by {key} order by _top, _group, depth, start, id) as int) as place")


def history(searches: DataFrame, user: str, query: str, at: str, keep: int = 8, longest: int = 300) -> DataFrame:
    """(user, place, query): the last searches of each user, those alike but for case once; keeping `keep` is the feature."""
    text = F.left(F.trim(F.col(query)), F.lit(longest))
    rows = searches.select(user, at, text.alias(query)).where(F.col(query) != "")
    latest = rows.groupBy(user, F.lower(query).alias("_alike")).agg(F.max_by(query, F.struct(at, query)).alias(query), F.max(at).alias("_at"))
    return latest.selectExpr(user, f"cast(row_number() over (partition by {user} order by _at desc, {query}) as int) as place", query).where(f"place <= {keep}")


def cards(recordings: DataFrame, base: str = "/") -> DataFrame:
    """(recording_id, id, title, date, has_sermon, start, length, href, quirks, place): a card for each recording (see sources.archive.SCHEMA), newest first. It opens at its sermon, else at the
    start; quirks are those of its uploads, each kind once."""
    sermon = F.filter("chapters", lambda c: c["kind"] == "sermon")
    has = F.size(sermon) > 0
    length = F.aggregate("uploads", F.lit(0.0), lambda acc, u: acc + u["duration"] - F.coalesce(u["skip"], F.lit(0.0)))
    quirks = F.array_distinct(F.flatten(F.transform("uploads", lambda u: F.coalesce(u["quirks"], F.array().cast("array<string>")))))
    own = recordings.select(F.col("id").alias("recording_id"), F.get("uploads", F.lit(0))["youtube_id"].alias("id"), "title", F.col("service_date").alias("date"), has.alias("has_sermon"), F.when(has, F.get(sermon, F.lit(0))["start"]).otherwise(0.0).alias("start"), length.alias("length"), quirks.alias("quirks"))
    linked = own.withColumn("href", captions.watch_url(base, F.col("recording_id"), F.col("start")))
    newest = linked.withColumn("_old", F.datediff(F.lit("9999-12-31").cast("date"), F.col("date")))
    return sequences.numbered(newest, [], ["_old", "recording_id"], "place").drop("_old", "_range")


def in_series(cards_: DataFrame, series: DataFrame) -> DataFrame:
    """Cards of the pages of series (series_id, recording_id, ord), in the series' own order, with `context`: Part p of n of those that are shown."""
    shown = cards_.join(series.select("series_id", "recording_id", "ord"), "recording_id")
    ranked = sequences.numbered(shown, ["series_id"], ["ord", "recording_id"], "position").drop("_range")
    total = shown.groupBy("series_id").agg(F.count(F.lit(1)).alias("_n"))
    return ranked.join(total, "series_id").withColumn("context", F.concat(F.lit("Part "), "position", F.lit(" of "), "_n")).drop("_n")


def home(cards_: DataFrame, saved: DataFrame, user: str = "user", base: str = "/") -> DataFrame:
    """(user, recording_id, role, place, href): the home page of each user. Featured is what a user was in the middle of (saved: user, recording_id, time), at least two seconds before its end, else the
    newest recording with a sermon, else the newest; the others follow in order, the newest in the place of the one that is resumed."""
    latest = cards_.agg(F.min(F.struct((~F.col("has_sermon")).alias("other"), "place", "recording_id", "href")).alias("l")).select("l.*")  # one row
    users = saved.select(user).distinct()
    going = saved.join(cards_.select("recording_id", "length"), "recording_id").where("time > 0 and time < length - 2")
    going = going.groupBy(user).agg(F.max_by(F.struct("recording_id", "time"), F.struct("time", "recording_id")).alias("r")).select(user, F.col("r.recording_id").alias("resumed"), F.col("r.time").alias("time"))
    top = users.join(going, user, "left").crossJoin(F.broadcast(latest.select(F.col("recording_id").alias("newest"), F.col("href").alias("newest_href"))))
    resumed = F.col("resumed").isNotNull()
    featured = top.select(user, F.coalesce("resumed", "newest").alias("recording_id"), F.when(resumed, "resumed").otherwise("featured").alias("role"), F.lit(0).cast("bigint").alias("place"), F.when(resumed, captions.watch_url(base, F.col("resumed"), F.col("time"))).otherwise(F.col("newest_href")).alias("href"))
    others = top.select(user, "resumed", "newest", "newest_href").crossJoin(cards_.select("recording_id", "place", "href")).where("recording_id <> newest")  # a page shows every card
    swapped = F.col("recording_id") == F.col("resumed")
    return featured.unionByName(others.select(user, F.when(swapped, F.col("newest")).otherwise(F.col("recording_id")).alias("recording_id"), F.lit("card").alias("role"), "place", F.when(swapped, F.col("newest_href")).otherwise(F.col("href")).alias("href")))
