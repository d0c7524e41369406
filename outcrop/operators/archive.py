"""Validation, display and browsing of recordings, and the plans that merge changes into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outcrop.functions import captions

from . import sequences


# --- constraints: each returns rows (subject, problem), empty where all is well


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str, subject: str, what: str) -> DataFrame:
    found = child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")
    return found.select(F.col(subject).cast("string").alias("subject"), F.lit(f"unknown {what}").alias("problem")).distinct()


def duplicates(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.concat_ws("/", *keys).alias("subject"), F.lit(f"duplicate {what}").alias("problem"))


def violations(df: DataFrame, subject: str, rules: dict[str, Column]) -> DataFrame:
    """Rows for which a rule's condition isn't true, by name; every rule is a column of one pass."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(F.col(subject).cast("string").alias("subject"), F.explode(failed).alias("problem"))


def recording_violations(recordings: DataFrame) -> DataFrame:
    """The rules of one recording (see sources.archive.SCHEMA) on its nested arrays."""
    sections = F.concat("chapters", F.flatten(F.transform("chapters", lambda c: F.transform(F.coalesce(c["subchapters"], F.array().cast(recordings.schema["chapters"].dataType.elementType["subchapters"].dataType.simpleString())), lambda s: F.struct(s["id"].alias("id"), s["title"].alias("title"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["scripture"].alias("scripture"), s["points"].alias("points"), F.lit(None).cast(recordings.schema["chapters"].dataType.elementType["subchapters"].dataType.simpleString()).alias("subchapters"))))))
    length = F.aggregate("uploads", F.lit(0.0), lambda acc, u: acc + u["duration"] - F.coalesce(u["skip"], F.lit(0.0)))
    ids = F.transform(sections, lambda c: c["id"])
    videos = F.transform("uploads", lambda u: u["youtube_id"])
    inside = lambda p, c: (p["start"] >= c["start"]) & (p["end"] <= c["end"] + 1e-6)
    ordered = lambda xs: F.forall(F.sequence(F.lit(1), F.size(xs)), lambda i: (i == 1) | (F.get(xs, i - 1)["start"] >= F.get(xs, i - 2)["end"] - 1e-6))
    by_time = lambda xs: F.forall(F.sequence(F.lit(1), F.size(xs)), lambda i: (i == 1) | (F.get(xs, i - 1)["time"] >= F.get(xs, i - 2)["time"]))
    points = lambda c: F.coalesce(c["points"], F.array().cast("array<struct<time:double,text:string>>"))
    children = lambda c: F.coalesce(c["subchapters"], F.array().cast(recordings.schema["chapters"].dataType.elementType["subchapters"].dataType.simpleString()))
    markers = F.coalesce("markers", F.array().cast("array<struct<time:double,end:double,note:string>>")) if "markers" in recordings.columns else F.array().cast("array<struct<time:double,end:double,note:string>>")
    sermon = F.exists(sections, lambda c: c["kind"] == "sermon")
    points_ok = lambda c: F.forall(F.coalesce(c["points"], F.array().cast("array<struct<time:double,text:string>>")), lambda p: (p["time"] >= c["start"]) & (p["time"] < c["end"]))
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    draft = F.col("status") == "draft"
    return violations(recordings, "id", {
        "id begins with its date": F.col("id").startswith(F.date_format("service_date", "yyyy-MM-dd")),
        "status is draft or published": F.col("status").isin("draft", "published"),
        "section ids are unique": F.size(F.array_distinct(ids)) == F.size(ids),
        "uploads are unique": F.size(F.array_distinct(videos)) == F.size(videos),
        "every section ends after it starts": F.forall(sections, lambda c: c["end"] > c["start"]),
        "every section is within the recording": F.forall(sections, lambda c: (c["start"] >= 0) & (c["end"] <= length + 1e-6)),
        "chapters are in order and don't overlap": ordered(F.col("chapters")),
        "subchapters are within their chapter": F.forall("chapters", lambda c: F.forall(F.coalesce(c["subchapters"], F.array().cast(recordings.schema["chapters"].dataType.elementType["subchapters"].dataType.simpleString())), lambda s: inside(s, c))),
        "points are within their section": F.forall(sections, points_ok),
        "only later uploads skip, and less than they last": F.forall(F.sequence(F.lit(1), F.size("uploads")), lambda i: F.coalesce(F.get("uploads", i - 1)["skip"], F.lit(0.0)) * F.when(i == 1, 0).otherwise(1) + F.when(i == 1, F.coalesce(F.get("uploads", i - 1)["skip"], F.lit(0.0)) * 1e9).otherwise(0) < F.get("uploads", i - 1)["duration"]),
        "subchapters are in order and don't overlap": F.forall("chapters", lambda c: (F.size(children(c)) <= 1) | ordered(children(c))),
        "points are in time order": F.forall(sections, lambda c: (F.size(points(c)) <= 1) | by_time(points(c))),
        "markers are within the recording": F.forall(markers, lambda m: (m["time"] <= length) & (m["end"].isNull() | ((m["end"] > m["time"]) & (m["end"] <= length)))),
        "a published recording of a sermon has description, scripture and topics": draft | ~sermon | ~(F.col("description").isNull() | empty("scripture") | empty("topics")),
    })


# --- display and search units


def units(recordings: DataFrame, topics: DataFrame, series: DataFrame, drafts: bool = False) -> DataFrame:
    """A search unit for each recording, chapter, subchapter and point, as search.prepare() takes them. topics: (id, name); series: (series_id, series_title, ord, recording_id)."""
    shown = recordings if drafts else recordings.where("status = 'published'")
    names = shown.select("id", F.posexplode_outer("topics").alias("ord", "topic")).join(topics.select(F.col("id").alias("topic"), "name"), "topic", "left")
    named = names.where("topic is not null").groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.coalesce("name", "topic").alias("name")))), lambda x: x["name"]).alias("topic_names"))
    base = shown.join(named, "id", "left").join(series.select(F.col("recording_id").alias("id"), F.col("series_title").alias("series_name")), "id", "left")
    common = [F.col("id").alias("recording_id"), F.col("service_date").alias("date"), F.col("title").alias("service")]
    none, text = F.lit(None).cast("array<string>"), F.lit(None).cast("string")
    sermon = F.filter("chapters", lambda c: c["kind"] == "sermon")
    length = F.aggregate("uploads", F.lit(0.0), lambda acc, u: acc + u["duration"] - F.coalesce(u["skip"], F.lit(0.0)))
    whole = base.select(F.col("id").alias("unit_id"), *common, F.lit("recording").alias("kind"), "title", F.col("description").alias("summary"), F.coalesce(F.get(sermon, F.lit(0))["start"], F.lit(0.0)).alias("start"), F.coalesce(F.when(F.size(sermon) > 0, F.element_at(sermon, -1)["end"]), length).alias("end"), "scripture", F.col("topic_names").alias("topics"), F.col("series_name").alias("series"))
    chapters = shown.select(*common, F.explode("chapters").alias("c"))
    section = lambda df, kind: df.select(F.concat_ws("/", "recording_id", "c.id").alias("unit_id"), "recording_id", "date", "service", F.lit(kind).alias("kind"), F.col("c.title").alias("title"), text.alias("summary"), F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.col("c.scripture").alias("scripture"), none.alias("topics"), text.alias("series"))
    subs = chapters.select("recording_id", "date", "service", F.explode("c.subchapters").alias("c"))
    point = lambda df: df.select("recording_id", "date", "service", "c.id", F.posexplode("c.points").alias("n", "p")).select(F.concat(F.concat_ws("/", "recording_id", "id"), F.lit("/point-"), F.col("n") + 1).alias("unit_id"), "recording_id", "date", "service", F.lit("point").alias("kind"), F.col("p.text").alias("title"), text.alias("summary"), F.col("p.time").alias("start"), F.lit(None).cast("double").alias("end"), none.alias("scripture"), none.alias("topics"), text.alias("series"))
    return whole.unionByName(section(chapters, "chapter")).unionByName(section(subs, "subchapter")).unionByName(point(chapters)).unionByName(point(subs))


# --- browsing


def facets(items: DataFrame, by: str, item: str, *order: Column) -> DataFrame:
    """(by, n, items) with items in order, one row for each value of an array or scalar column: for values of few items. See facet_rows() for any number."""
    value = F.explode(by) if items.schema[by].dataType.typeName() == "array" else F.col(by)
    rows = items.select(value.alias(by), F.struct(*order, F.col(item).alias("_item")).alias("_o")).where(F.col(by).isNotNull())
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.transform(F.sort_array(F.collect_list("_o")), lambda x: x["_item"]).alias("items"))


def facet_rows(items: DataFrame, category: str, facet: Column, title: Column, facet_order: list[Column], item: str, item_order: list[Column]) -> DataFrame:
    """(category, facet, title, facet_rank, n, item, item_rank): the pages of a browse category, one row for each item of a facet. `facet` is a column or an array of ids, `title` the like; facets are
    ranked by facet_order, which sees facet, title and the columns of items, and an item once within its facet by item_order. No facet is an array or in one task: ranks come from ranges of rows and the
    counts of those before."""
    each = items.select(*items.columns, facet.alias("facet"), title.alias("title")).where("facet is not null")
    order = {f"_i{i}": c for i, c in enumerate(item_order)}
    rows = each.withColumns(order | {f"_f{i}": c for i, c in enumerate(facet_order)}).select("facet", "title", F.col(item).alias("item"), *order, *[f"_f{i}" for i in range(len(facet_order))])
    firsts = rows.groupBy("facet", "item").agg(F.min(F.struct(*order, "item")).alias("at"))
    ranked = sequences.numbered(firsts.select("facet", "at.*"), ["facet"], [*order, "item"], "item_rank").select(F.col("facet").alias("_facet"), "item", "item_rank")
    heads = rows.groupBy("facet").agg(F.min(F.struct(*[f"_f{i}" for i in range(len(facet_order))], "title")).alias("h"), F.count_distinct("item").alias("n")).select("facet", "n", "h.*")
    facets_ = sequences.numbered(heads, [], [*[f"_f{i}" for i in range(len(facet_order))], "facet"], "facet_rank")
    return facets_.join(ranked, F.col("facet") == F.col("_facet")).select(F.lit(category).alias("category"), "facet", "title", "facet_rank", "n", "item", "item_rank")


def drafts(recordings: DataFrame) -> DataFrame:
    """What isn't published yet, for those who edit it."""
    return recordings.where("status = 'draft'")


def top_values(items: DataFrame, by: str, n: int = 8) -> DataFrame:
    """The n commonest values, equals by name: the feature is the top n."""
    value = F.explode(by) if items.schema[by].dataType.typeName() == "array" else F.col(by)
    return items.select(value.alias(by)).where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by).limit(n)


# --- plans of changes


def upsert_plan(entries: DataFrame, known: DataFrame, issues: DataFrame, key: str, body: str = "body") -> DataFrame:
    """(key, action, number): create what has no issue, update open issues whose body differs, fail on several; known and closed are left alone."""
    fresh = entries.join(known.select(key).distinct(), key, "left_anti").select(key, F.col(body).alias("new_body"))
    held = issues.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("number"), F.min("state").alias("state"), F.min(body).alias("old_body"))
    plan = F.when(F.col("n").isNull(), "create").when(F.col("n") > 1, "fail").when((F.col("state") != "closed") & ~F.col("old_body").eqNullSafe(F.col("new_body")), "update")
    return fresh.join(held, key, "left").withColumn("action", plan).where("action is not null").select(key, "action", "number")


def three_way(base: DataFrame, current: DataFrame, edited: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, verdict): apply where only edited differs from base, conflict where current does too and not alike."""
    long = lambda df, name: df.select(key, F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields])))
    all_ = long(base, "b").join(long(current, "c"), [key, "field"], "full").join(long(edited, "e"), [key, "field"], "full")
    changed = all_.where(~F.col("e").eqNullSafe(F.col("b")))
    return changed.select(key, "field", F.when(F.col("c").eqNullSafe(F.col("b")), "apply").otherwise("conflict").alias("verdict"))


def merge_recordings(base: DataFrame, current: DataFrame, edited: DataFrame, fields: list[str], chapter_fields: list[str]) -> DataFrame:
    """(id, item, field, verdict) of what an edit of recordings (see sources.archive.SCHEMA) changes: apply, or conflict where the current version has changed there too. Chapters are merged one by
    one, item being the chapter's id, where all three versions have the same ones in the same order, else as a whole. An edit was made against the uploads it saw: if their ids, durations or skips have
    changed since, that alone is a conflict. An id with any conflict isn't applied."""
    clock = F.to_json(F.transform("uploads", lambda u: F.struct(u["youtube_id"], u["duration"], F.coalesce(u["skip"], F.lit(0.0)))))
    ids = F.to_json(F.transform("chapters", lambda c: c["id"]))
    side = lambda df, n: df.select("id", clock.alias(f"clock_{n}"), ids.alias(f"ids_{n}"), F.to_json("chapters").alias(f"chapters_{n}"))
    all_ = side(base, "b").join(side(current, "c"), "id").join(side(edited, "e"), "id")
    moved = all_.where("clock_b <> clock_c").select("id", F.lit(None).cast("string").alias("item"), F.lit("uploads").alias("field"), F.lit("conflict").alias("verdict"))
    text = lambda df: df.select("id", *[F.to_json(F.struct(f)).alias(f) for f in fields])
    own = three_way(text(base), text(current), text(edited), "id", fields).select("id", F.lit(None).cast("string").alias("item"), "field", "verdict")
    alike = all_.where("ids_b = ids_c and ids_b = ids_e").select("id")
    parts = lambda df: df.join(alike, "id").select("id", F.explode("chapters").alias("x")).select(F.struct("id", F.col("x.id").alias("item")).alias("k"), *[F.to_json(F.struct(F.col(f"x.{f}").alias(f))).alias(f) for f in chapter_fields])
    each = three_way(parts(base), parts(current), parts(edited), "k", chapter_fields).select("k.id", "k.item", "field", "verdict")
    whole = all_.where("not (ids_b = ids_c and ids_b = ids_e) and chapters_b <> chapters_e")
    whole = whole.select("id", F.lit(None).cast("string").alias("item"), F.lit("chapters").alias("field"), F.when(F.col("chapters_b") == F.col("chapters_c"), "apply").otherwise("conflict").alias("verdict"))
    return moved.unionByName(own).unionByName(each).unionByName(whole)


def described(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change): added, removed or changed."""
    digest = lambda df, name: df.select(key, F.xxhash64(*[F.col(f).cast("string") for f in fields], *[F.col(f).isNull() for f in fields]).alias(name))
    both = digest(before, "b").join(digest(after, "a"), key, "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select(key, F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("changed").alias("change"))


def quality_gate(segments: DataFrame, key: str, words: str, known: DataFrame, start: str, end: str, least_words: int = 40, rate: tuple = (20, 220), ratio: float = 0.9) -> DataFrame:
    """(key, n_words, n_known, reasons): a recording's words (an array, see captions.tokens) held against a dictionary (word), and their rate a minute. A word is known
    if the dictionary has it, or what is left of it without a contraction or possessive ending."""
    each = segments.select(key, start, end, F.explode_outer(words).alias("word")).groupBy(key, "word").agg(F.count("word").alias("n"), F.min(start).alias("s"), F.max(end).alias("e"))
    forms = each.select("word").distinct().select("word", F.explode(captions.dictionary_forms(F.col("word"))).alias("form"))
    held = forms.join(known.select(F.col("word").alias("form")).distinct(), "form", "left_semi").select("word", F.lit(1).alias("is_known")).distinct()
    met = each.join(held, "word", "left")
    sums = met.groupBy(key).agg(F.sum("n").alias("n_words"), F.sum(F.when(F.col("is_known") == 1, F.col("n")).otherwise(0)).alias("n_known"), F.min("s").alias("s"), F.max("e").alias("e"))
    per_minute = F.col("n_words") * 60 / (F.col("e") - F.col("s"))
    share = F.when(F.col("n_words") > 0, F.col("n_known") / F.col("n_words")).otherwise(0.0)
    why = F.array_compact(F.array(F.when(F.col("n_words") < least_words, "insufficient_words"), F.when(~F.coalesce(per_minute.between(*rate), F.lit(False)), "implausible_word_rate"), F.when(share < ratio, "dictionary_ratio_below_90_percent")))
    return sums.select(key, "n_words", "n_known", F.array_join(why, ",").alias("reasons"))
